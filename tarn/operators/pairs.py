"""Cosines of all pairs of queries with a corpus, to four digits: their numbers, and the greatest.

Queries (q, qv, kind) are sent to all tasks in batches of bounded size; a task takes its rows of the corpus (doc, dv, kind, asked) by
blocks, each one product of matrices, and keeps numbers or a few pairs, never the pairs. kind is 0 or 1, anything else for
neither; asked tells that a row is a query itself: a pair of two queries counts once, as that of the lesser id.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.retrieval import batches_of, digits, matrix_of, slices, tiles, unit

#: Ten-thousandths from -1 to 1 are numbered from 0; then come scores that are no number, and pairs without a score.
ONE, NAN, NONE = 10_000, 20_001, 20_002
KINDS = ["0-0", "1-1", "other"]


class _Counts:
    """Numbers of pairs by kind and score."""

    def __init__(self) -> None:
        self.n = np.zeros((3, NONE + 1), np.int64)

    def add(self, qs: np.ndarray, docs: np.ndarray, points: np.ndarray, kinds: np.ndarray, pairs: np.ndarray) -> None:
        for kind in range(3):
            self.n[kind] += np.bincount(points[pairs & (kinds == kind)], minlength=NONE + 1)

    def rows(self) -> Iterator[pa.RecordBatch]:
        kind, at = np.nonzero(self.n)
        score = pa.array(np.where(at == NAN, np.nan, (at - ONE) / ONE), mask=at == NONE)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(KINDS)[kind]), score, pa.array(self.n[kind, at])], ["kind", "s", "n"])


class _Greatest:
    """The first k pairs of one kind by score, greatest first, and ids."""

    def __init__(self, kind: int, k: int) -> None:
        self.kind, self.k, self.best = kind, k, np.zeros((3, 0), np.int64)

    def add(self, qs: np.ndarray, docs: np.ndarray, points: np.ndarray, kinds: np.ndarray, pairs: np.ndarray) -> None:
        least = self.best[2, -1] if self.best.shape[1] == self.k else 0
        c, r = np.nonzero(pairs & (kinds == self.kind) & (points >= least) & (points < NAN))
        found = np.concatenate([self.best, np.stack([qs[c], docs[r], points[c, r]])], axis=1)
        self.best = found[:, np.lexsort((found[1], found[0], -found[2]))[: self.k]]

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(self.best[0]), pa.array(self.best[1]), pa.array((self.best[2] - ONE) / ONE)], ["a", "b", "s"])


def _scored(queries: DataFrame, corpus: DataFrame, keeper: Callable[[], _Counts | _Greatest], schema: str) -> DataFrame:
    """The rows that the keeper of each task has in the end."""

    def one(part: DataFrame) -> DataFrame:
        table = part.select("q", "qv", "kind").toArrow()
        vectors, held = matrix_of(table.column("qv"))
        sent = part.sparkSession.sparkContext.broadcast((table.column("q").to_numpy(), unit(vectors), held, table.column("kind").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (qs, asked, held, kinds), keep = sent.value, keeper()
            for batch in slices(batches):
                docs, kind, twice = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "kind", "asked"))
                own, there = matrix_of(batch.column("dv"))
                own = unit(own) if there.any() else np.zeros((len(docs), asked.shape[1]))
                for some in tiles(len(qs), len(docs)):
                    q = qs[some][:, None]
                    cos = asked[some] @ own.T if held.any() else np.zeros((some.stop - some.start, len(docs)))
                    points = np.where(np.isnan(cos), NAN, digits(np.clip(np.nan_to_num(cos), -1, 1)) + ONE).astype(np.int32)
                    points[~held[some]] = NONE
                    points[:, ~there] = NONE
                    same = kinds[some][:, None] == kind[None, :]
                    both = np.where(same & (kind[None, :] >= 0) & (kind[None, :] < 2), kind[None, :], 2)
                    keep.add(qs[some], docs, points, both, (docs != q) & ~(twice & (docs < q)))
            yield from keep.rows()

        return corpus.select("doc", "dv", "kind", "asked").mapInArrow(run, schema)

    return functools.reduce(DataFrame.unionByName, map(one, batches_of(queries)))


def pair_counts(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(kind, s, n): how many pairs of a kind (0-0, 1-1 or other) have the score s, null where a vector is; some ten thousand rows a
    kind at most, whatever the pairs are."""
    return _scored(queries, corpus, _Counts, "kind string, s double, n long").groupBy("kind", "s").agg(F.sum("n").alias("n"))


def greatest_pairs(queries: DataFrame, corpus: DataFrame, kind: str, k: int) -> DataFrame:
    """(a, b, s): the k pairs of a kind with the greatest scores, equal ones by ids. k of each task are compared."""
    found = _scored(queries, corpus, lambda: _Greatest(KINDS.index(kind), k), "a long, b long, s double")
    return found.orderBy(F.desc("s"), "a", "b").limit(k)
