"""Licence scans: segments of normalised text compared to licence templates by the Dice coefficient of word bigrams.

Method. The lines, the sentences and the whole of a text are normalised to words of ASCII letters and digits in lower
case. A segment's distinct bigrams are looked up in an index of the templates' bigrams; a template whose number of
bigrams is too far from the segment's for the threshold is pruned unseen, as Dice is at most 2 min(a, b) / (a + b). Of
the templates that reach the threshold a segment has the best one, the first by name of equal ones.

Notices within a sentence and licences spread over lines are found as passages: runs of as many words as a template has,
wherever they start, against the notices, titles, paragraphs and full licence texts. A template is tried only where a text
has one of its rarest bigrams, of which any passage that reaches the threshold has at least one, and enough of all of
them. Of passages that overlap, a full text goes before a part, then the best one.

A text is one pass, with no shuffle at all, so hot sources and copies cost what their rows cost.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm import common as C

THRESHOLD_PERCENT = 80

#: Licence names as notices write them, by SPDX identifier; the words around them; first sentences of headers.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "ISC": ["the ISC License"],
    "MIT": ["the MIT License"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0"],
    "Unlicense": ["the Unlicense"],
}
FRAMES = ["Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This software is released under {}", "This program is distributed under the terms of {}"]
HEADERS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "Apache-2.0": "you may not use this file except in compliance with the License",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}

TITLES = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004"],
    "GPL-2.0": ["GNU General Public License Version 2, June 1991"],
    "GPL-3.0": ["GNU General Public License Version 3, 29 June 2007"],
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "MIT": ["The MIT License (MIT)"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
}
#: Words of the shortest paragraph of a licence text that names it.
PARAGRAPH = 12

_WORD = re.compile(rb"[a-z0-9]+")
_SENTENCE = re.compile(rb"[.!?][ \t\r\f\n]+|\n")


def templates() -> list[tuple[str, str]]:
    """(licence, template text) of all notices and headers."""
    return [(k, f.format(n)) for k, names in NAMES.items() for n in names for f in FRAMES] + list(HEADERS.items())


def passages() -> list[tuple[str, str, bool]]:
    """(licence, template text, whether it is a full text) of all notices, titles, licence texts and their paragraphs."""
    out = [(k, t, False) for k, t in templates()] + [(k, t, False) for k, titles in TITLES.items() for t in titles]
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text()
        out.append((path.stem, text, True))
        out += [(path.stem, x, False) for x in re.split(r"\n\s*\n", text) if len(_WORD.findall(x.encode().lower())) >= PARAGRAPH]
    return out


def bigrams(segment: bytes) -> frozenset[tuple[bytes, bytes]]:
    words = _WORD.findall(segment)
    return frozenset(zip(words, words[1:], strict=False))


class Matcher:
    def __init__(self, known: list[tuple[str, str]], percent: int):
        sets = sorted({(k, bigrams(t.encode().lower())) for k, t in known}, key=lambda x: (x[0], sorted(x[1])))
        self.names, self.sizes, self.percent = [k for k, _ in sets], [len(b) for _, b in sets], percent
        self.index: dict[tuple[bytes, bytes], list[int]] = {}
        for i, (_, b) in enumerate(sets):
            for x in b:
                self.index.setdefault(x, []).append(i)
        # a segment has at most so many distinct bigrams if it is like the largest template
        self.most = (200 - percent) * max(self.sizes, default=0) // percent

    def best(self, segment: bytes) -> tuple[str, float] | None:
        """(licence, Dice) of the best template that reaches the threshold."""
        b = bigrams(segment)
        n, p = len(b), self.percent
        if not n or n > self.most:
            return None
        shared: Counter[int] = Counter()
        for x in b & self.index.keys():
            shared.update(i for i in self.index[x] if p * (n + self.sizes[i]) <= 200 * min(n, self.sizes[i]))
        found = [(-2 * c / (n + self.sizes[i]), self.names[i]) for i, c in shared.items() if 200 * c >= p * (n + self.sizes[i])]
        return (min(found)[1], -min(found)[0]) if found else None

    def scan(self, text: str | None) -> dict[bytes, tuple[str, float]]:
        """The matches of a text by their normalised segment."""
        low = (text or "").encode().lower()
        out = {}
        for s in {low, *low.split(b"\n"), *_SENTENCE.split(low)}:
            hit = self.best(s)
            if hit:
                out[b" ".join(_WORD.findall(s))] = hit
        return out


class Passages:
    """Finds the templates in runs of words of their size."""

    def __init__(self, known: list[tuple[str, str, bool]], percent: int):
        self.percent = percent
        self.known: list[tuple[str, bool, int, frozenset[tuple[bytes, bytes]], int]] = []
        # one template for equal words, the first by name
        by_words = {tuple(_WORD.findall(t.encode().lower())): (k, full) for k, t, full in sorted(known, reverse=True)}
        held = Counter(x for words in by_words for x in set(zip(words, words[1:], strict=False)))
        self.anchors: dict[tuple[bytes, bytes], list[int]] = {}
        for words, (name, full) in by_words.items():
            b = frozenset(zip(words, words[1:], strict=False))
            if not b:
                continue
            # d distinct bigrams, s of them shared: 200 s >= percent (d + n) and d >= s
            least = -(-percent * len(b) // (200 - percent))
            for x in sorted(b, key=lambda x: (held[x], -len(x[0]) - len(x[1]), x))[: len(b) - least + 1]:
                self.anchors.setdefault(x, []).append(len(self.known))
            self.known.append((name, full, len(words), b, least))

    def scan(self, text: str | None) -> list[tuple[str, float, bytes]]:
        """(licence, Dice, normalised words) of the passages of a text that don't overlap better ones."""
        words = _WORD.findall((text or "").encode().lower())
        pairs = list(zip(words, words[1:], strict=False))
        have = set(pairs)
        tried = {i for x in have & self.anchors.keys() for i in self.anchors[x]}
        tried = [i for i in tried if len(have & self.known[i][3]) >= self.known[i][4]]
        if not tried:
            return []
        ids = {x: j for j, x in enumerate(have)}
        row = np.array([ids[x] for x in pairs])
        found = []
        for i in tried:
            name, full, size, b, least = self.known[i]
            best = self._best(row, np.array([ids[x] for x in have & b]), len(ids), min(size - 1, len(pairs)), len(b), least)
            if best:
                found.append((not full, -best[0], -len(b), name, best[1], best[1] + min(size, len(words))))
        out, taken = [], np.zeros(len(words), bool)
        for _, dice, _, name, at, to in sorted(found):
            if not taken[at:to].any():
                taken[at:to] = True
                out.append((name, -dice, b" ".join(words[at:to])))
        return out

    def _best(self, row: np.ndarray, shared: np.ndarray, n_ids: int, width: int, n: int, least: int) -> tuple[float, int] | None:
        """(Dice, start) of the best run of so many bigrams, the first of equal ones."""
        mine = np.zeros(n_ids, bool)
        mine[shared] = True
        hit = mine[row]
        sums = np.concatenate([[0], np.cumsum(hit)])
        starts = np.flatnonzero(sums[width:] - sums[:-width] >= least)
        counts, distinct, common, best = np.zeros(n_ids, np.int32), 0, 0, None
        at = to = 0  # counted are row[at:to]
        for start in starts.tolist():
            if start >= to:
                counts[:], distinct, common, at, to = 0, 0, 0, start, start
            for j in range(to, start + width):
                x = row[j]
                counts[x] += 1
                if counts[x] == 1:
                    distinct, common = distinct + 1, common + int(hit[j])
            to = start + width
            for j in range(at, start):
                x = row[j]
                counts[x] -= 1
                if counts[x] == 0:
                    distinct, common = distinct - 1, common - int(hit[j])
            at = start
            if 200 * common >= self.percent * (distinct + n):
                dice = 2 * common / (distinct + n)
                if best is None or dice > best[0]:
                    best = (dice, start)
        return best


def _scanned(batches: Iterator[pa.RecordBatch], known: list[tuple[str, str]], percent: int, parts: list[tuple[str, str, bool]]) -> Iterator[pa.RecordBatch]:
    matcher, runs = Matcher(known, percent), Passages(parts, percent)
    for batch in batches:
        found = []
        for t in batch.column("text").to_pylist():
            hits = matcher.scan(t)
            named = {k for k, _ in hits.values()}
            if parts:
                for k, dice, words in runs.scan(t):
                    if k not in named:
                        hits.setdefault(words, (k, dice))
            found.append(hits)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([",".join(sorted({k for k, _ in f.values()})) for f in found], pa.string()),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([round(max((d for _, d in f.values()), default=0.0), 6) for f in found], pa.float64()),
            ],
            names=["id", "licenses", "n_segments", "best_dice"],
        )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None, percent: int = THRESHOLD_PERCENT, parts: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """(id, licenses, n_segments, best_dice) of every row: the licences found, sorted and joined by commas, how many
    distinct segments matched, and the greatest Dice coefficient, 0 without a match. With parts (see passages), the best
    passages that are of licences no segment names count as segments, too.

    Null and empty texts match nothing. Repeated rows each have a row. An empty table gives an empty result; other
    columns aren't read.
    """
    C.arrow_rows(docs.sparkSession)
    known = templates() if known is None else known
    return C.inputs(docs, id=id_col, text=text_col).mapInArrow(lambda it: _scanned(it, known, percent, parts or []), "id long, licenses string, n_segments long, best_dice double")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), parts=passages()).withColumnRenamed("id", "doc_id")


def _values() -> str:
    return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in templates())


_BIGRAMS = "list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])))"
OP8_SQL = f"""
WITH t AS (SELECT DISTINCT name, {_BIGRAMS} AS b FROM (SELECT name, regexp_extract_all(lower(x), '[a-z0-9]+') AS ws FROM (VALUES {_values()}) AS v(name, x))),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
s AS (SELECT doc_id, x AS s FROM d UNION ALL SELECT doc_id, unnest(string_split(x, chr(10))) FROM d UNION ALL SELECT doc_id, unnest(regexp_split_to_array(x, '[.!?][ \\t\\r\\f\\n]+|\\n')) FROM d),
g AS (SELECT doc_id, array_to_string(ws, ' ') AS norm, {_BIGRAMS} AS b FROM (SELECT DISTINCT doc_id, regexp_extract_all(s, '[a-z0-9]+') AS ws FROM s) WHERE len(ws) >= 2),
m AS (SELECT doc_id, norm, name, 2 * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b)) AS dice FROM g JOIN t ON 80 * (len(g.b) + len(t.b)) <= 200 * least(len(g.b), len(t.b)) WHERE 200 * len(list_intersect(g.b, t.b)) >= 80 * (len(g.b) + len(t.b))),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY dice DESC, name) AS r FROM m),
o AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n, max(dice) AS best FROM f WHERE r = 1 GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_segments, round(coalesce(best, 0), 6) AS best_dice FROM documents LEFT JOIN o USING (doc_id)
"""
