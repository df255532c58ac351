import re
from collections import Counter

import brute

from tarn.llm import quality as Q


def counts(text):
    t = text or ""
    w = brute.WORD.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if brute.WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed)


def test_counts_and_hosts(spark):
    good = " ".join(f"w{i}é" for i in range(60))
    texts = [None, "", " \n\t", "a a a a a", "x\nx\ny\n\nx ", good, good + "\n" + good, "a b c " * 30, "#* $ <> &amp;\n" * 3, good + " #\x0b%\x0cz", "p q r s p q r s p q r"]
    docs = [(i, t, ["good", "bad", None][i % 3]) for i, t in enumerate(texts)]
    docs += [(100 + i, good + str(i), "good") for i in range(60)] + [(300 + i, "short", "bad") for i in range(90)] + [(500, good, "bad"), (500, good, "bad"), (501, good, "tiny")]
    df = spark.createDataFrame([(*d, 1, True) for d in docs], "doc_id long, text string, source string, n_words int, kept boolean").repartition(3)
    rows = Q.quality(df).collect()
    text, source = {d[0]: d[1] for d in docs}, {d[0]: d[2] for d in docs}
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:7] == counts(text[r["id"]])
        assert r["kept"] == (not r["base_failed"] and source[r["id"]] != "bad")


def hosts(spark, rates, size=200):
    """A table of hosts, each with a part of documents that fail by a rule."""
    good = " ".join(f"w{i}" for i in range(80))
    bad = {"base": "too short", "symbols": good + " #" * 20, "lines": good + "\nq" * 6}
    rows = [(len(rates) * i + h, bad[rule] if i < rate * size else f"{good} {h} {i}", f"host{h}") for h, (rule, rate) in enumerate(rates) for i in range(size)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_a_host_that_stands_out_goes_and_those_like_others_stay(spark):
    def kept(rates):
        df = hosts(spark, rates)
        rows = Q.quality(df).join(df.withColumnRenamed("doc_id", "id"), "id").collect()
        return {r["source"]: r["host_failed_by"] for r in rows}, rows

    by, rows = kept([("base", 0.05 + 0.01 * (i % 5)) for i in range(30)] + [("base", 0.6), ("symbols", 0.7), ("lines", 0.55)])
    assert {h: b for h, b in by.items() if b} == {"host30": "base", "host31": "symbols", "host32": "lines"}
    assert all(r["kept"] == (not r["base_failed"] and not r["host_failed_by"]) for r in rows)
    # a third of each host's documents fail: no host stands out, and none goes
    assert not any(kept([("base", 0.35)] * 20)[0].values())


def test_a_small_host_is_shrunk_to_the_mean(spark):
    df = hosts(spark, [("base", 0.1)] * 20).union(hosts(spark, [("base", 1.0)], 2).selectExpr("doc_id + 90000", "text", "'tiny'"))
    assert not any(r["host_failed_by"] for r in Q.quality(df).collect())


def test_empty_table(spark):
    assert Q.quality(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
