import random
import re

from tarn.llm import licenses as L


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def grams(s):
    w = re.findall("[a-z0-9]+", s)
    return set(zip(w, w[1:]))


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    out = {}
    for s in [low, *low.split("\n"), *re.split("[.!?][ \t\r\f\n]+|\n", low)]:
        best = min(((-dice(grams(s), grams(t.lower())), k) for k, t in L.templates()), default=(0, ""))
        if -best[0] >= 0.8:
            out[" ".join(re.findall("[a-z0-9]+", s))] = (best[1], -best[0])
    return ",".join(sorted({k for k, _ in out.values()})), len(out), round(max((d for _, d in out.values()), default=0.0), 6)


def test_same_as_all_templates(spark):
    r = random.Random(3)
    known = [t for _, t in L.templates()]
    docs = [(0, None), (1, ""), (2, "Released under the MIT License."), (3, "x\nLicensed under CC BY-NC 4.0.\ny. This work is licensed under the GNU General Public License, version 3."), (4, "word " * 30_000), (5, "É mit license"), (5, "É mit license")]
    for i in range(10, 90):
        w = r.choice(known).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(["foo", "the", "License", "3"])
        docs.append((i, r.choice(["", "before. ", "a\n"]) + " ".join(w) + r.choice(["", ".", ". After that", "!\nb"])))
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, licenses int").repartition(3)
    rows = L.license_scan(df).collect()
    assert len(rows) == len(docs)
    want = {i: brute(t) for i, t in docs}
    assert {r["id"]: tuple(r)[1:] for r in rows} == want
    assert want[2][0] == "MIT" and want[3][0] == "CC-BY-NC-4.0,GPL-3.0"
    assert L.license_scan(df.limit(0)).collect() == []


def found(text):
    return sorted(k for k, _, _ in L.Passages(L.passages(), 80).scan(text))


def test_full_texts_wrapped_and_unwrapped():
    for path in (L.Path(L.__file__).parent / "license_texts").glob("*.txt"):
        words = path.read_text().split()
        for width in (4, 11, len(words)):
            lines = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
            assert found("Some project. Copyright 2020 me\n" + "\n".join(lines) + "\nafter it, code") == [path.stem], (path.stem, width)


def test_parts_of_licences_within_other_text(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    w = mit.split()
    docs = {
        1: (mit, "MIT"),
        2: ("\n# ".join(" ".join(w[i : i + 8]) for i in range(0, len(w), 8)), "MIT"),
        3: ("x Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. y", "Apache-2.0"),
        4: ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GPL-3.0"),
        5: ("The MIT License (MIT)", "MIT"),
        6: ("This project is released under the MIT License and may be reused freely by anyone", "MIT"),
        7: ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "BSD-2-Clause"),
        8: ("the MIT of the license is under the sea, and of this software the rights are as is " * 50, ""),
        9: ("", ""),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in docs.items()], "doc_id long, text string")
    got = {r["id"]: r for r in L.license_scan(df, parts=L.passages()).collect()}
    assert {i: r["licenses"] for i, r in got.items()} == {i: k for i, (_, k) in docs.items()}
    assert got[6]["n_segments"] == 1 and got[6]["best_dice"] == 1.0


def test_best_runs_are_those_of_all_runs():
    r = random.Random(5)
    known = [("a", "a b c d e f g", False), ("b", "c d a a b c", False), ("c", "e f", False)]
    matcher = L.Passages(known, 80)
    for _ in range(300):
        words = r.choices("abcdefg", k=r.randint(0, 25))
        for name, _, size, b, least in matcher.known:
            runs = [words[i : i + size] for i in range(max(1, len(words) - size + 1))]
            b = {x for x in b}
            want = max((dice({(x.encode(), y.encode()) for x, y in zip(w, w[1:])}, b) for w in runs), default=0.0)
            got = L.Passages([k for k in known if k[0] == name], 80).scan(" ".join(words))
            assert (got[0][1] if got else 0.0) == (want if want >= 0.8 else 0.0)
