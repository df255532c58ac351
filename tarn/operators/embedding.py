"""Vectors for texts, fitted on the corpus itself: a truncated singular value decomposition of its tf-idf matrix.

Terms are hashed to BUCKETS columns. The right singular vectors are found by subspace iteration: a random basis is multiplied by
the matrix and its transpose, document by document where these are, and made orthogonal again. What a round brings to the driver is
one matrix of BUCKETS x (dims + OVER) numbers, summed up by the executors, whatever the corpus. Documents weigh terms by their
number and rarity, questions by rarity alone, as words of a question are seldom repeated on purpose.

Texts are cut into words and their buckets counted once, see counted(); rounds and vectors are made from these counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.sources.shared import checkpointed

#: Columns of the matrix, dimensions of a vector, columns of the basis besides them, and rounds.
BUCKETS, DIMS, OVER, ROUNDS = 1 << 15, 64, 16, 4
#: Rows that are weighed at once, and tasks of a round for each core at most: each task sends a matrix of sums.
BLOCK, TASKS = 500, 2


@dataclass(frozen=True)
class Model:
    """The weight of each bucket, and the directions (buckets, dims), strongest first."""

    idf: np.ndarray
    basis: np.ndarray


def buckets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ids, the bucket of each word of the text; null texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return docs.withColumn("ids", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends and starts of the rows: one more than there are, their values); null rows are empty."""
    lengths = np.fromiter((len(x) if x.is_valid else 0 for x in column), np.int64, len(column))
    return np.concatenate([[0], np.cumsum(lengths)]), column.flatten().to_numpy(zero_copy_only=False)


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with ids, its distinct buckets in order, and ns, how many words are in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                bounds, flat = _lists(part["ids"])
                cell, n = np.unique(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * BUCKETS + flat, return_counts=True)
                row, bucket = np.divmod(cell, BUCKETS)
                ends = pa.array(np.searchsorted(row, np.arange(len(bounds))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in rest), *(pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (bucket, n))], [*rest, "ids", "ns"])

    rest = [c for c in docs.columns if c != text]
    kinds = dict(docs.dtypes)
    rows = buckets(docs, text).select(*(f"`{c}`" for c in rest), "ids")
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "ids array<int>", "ns array<int>"]))


def _weighed(b: pa.RecordBatch, idf: np.ndarray, often: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bounds of the rows, buckets, weights) of blocks of counted rows, each of length 1."""
    for at in range(0, b.num_rows, BLOCK):
        bounds, ids = _lists(b["ids"].slice(at, BLOCK))
        weight = idf[ids]
        if often:
            weight = (1 + np.log(_lists(b["ns"].slice(at, BLOCK))[1])) * weight
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        norm = np.sqrt(np.bincount(row, weight**2, len(bounds) - 1))
        yield at, bounds, ids, weight / np.maximum(norm[row], 1e-300)


def fit(docs: DataFrame, dims: int = DIMS, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """The model of docs (text), or of what counted() makes of them, stored. An empty corpus gives one whose vectors are zeros."""
    rows = (docs if "ns" in docs.columns else checkpointed(counted(docs.select("text")))).select("ids", "ns")
    spark, width = rows.sparkSession, dims + OVER
    most = TASKS * spark.sparkContext.defaultParallelism
    rows = rows.coalesce(most)

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(_lists(b["ids"])[1], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["b", "df"])

    counts = rows.mapInArrow(holding, "b int, df long").groupBy("b").agg(F.sum("df").alias("df")).toArrow()  # BUCKETS rows at most
    df = np.zeros(BUCKETS)
    df[counts.column("b").to_numpy()] = counts.column("df").to_numpy()
    idf = np.where(df > 0, np.log((1 + rows.count()) / np.maximum(df, 1)), 0.0)
    # the matrices of sums that a round shuffles take no more bytes than the counts: small corpora have fewer tasks, but one
    rows = rows.coalesce(min(most, max(-(-int(df.sum()) // (BUCKETS * width)), 1)))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((BUCKETS, width)))[0]
    names = [f"c{i}" for i in range(width)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((idf, basis.astype(np.float32)))

        def product(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            idf, basis = sent.value
            basis = basis.astype(float)
            total = np.zeros(basis.shape)
            for b in batches:
                for _, bounds, ids, weight in _weighed(b, idf, True):
                    # one document's rows of the basis stay in the processor's cache, those of a block don't
                    for lo, hi in itertools.pairwise(bounds.tolist()):
                        if lo < hi:
                            bucket, w = ids[lo:hi], weight[lo:hi]
                            total[bucket] += np.multiply.outer(w, w @ basis[bucket])
            used = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(total[used, i]) for i in range(total.shape[1]))], ["b", *names])

        sums = rows.mapInArrow(product, ", ".join(["b int", *(f"{c} double" for c in names)])).groupBy("b").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
        image = np.zeros((BUCKETS, width))
        image[sums.column("b").to_numpy()] = np.stack([sums.column(c).to_numpy() for c in names], 1) if len(sums) else 0
        small, last = basis.T @ image, basis  # the square of the matrix, seen in the basis
        basis = np.linalg.qr(image)[0]
        sent.unpersist()
    if not rounds or not counts.num_rows:
        return Model(idf, np.zeros((BUCKETS, dims)))
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return Model(idf, last @ vectors[:, np.argsort(-values)[:dims]])


def embed(texts: DataFrame, model: Model, question: bool = False) -> DataFrame:
    """texts (id, text), or what counted() makes of them, as (id, vector): arrays of doubles of length 1; zeros for a text without a
    known word."""
    sent = texts.sparkSession.sparkContext.broadcast((model.idf, model.basis.astype(np.float32)))
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = sent.value
        basis = basis.astype(float)
        for b in batches:
            for at, bounds, ids, weight in _weighed(b, idf, not question):
                v = np.zeros((len(bounds) - 1, basis.shape[1]))
                for i, (lo, hi) in enumerate(itertools.pairwise(bounds.tolist())):
                    v[i] = weight[lo:hi] @ basis[ids[lo:hi]]
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                ends = pa.array((np.arange(len(v) + 1) * v.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b["id"].slice(at, len(v)), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["id", "vector"])

    return (texts if "ns" in texts.columns else counted(texts.select("id", "text"))).select("id", "ids", "ns").mapInArrow(run, f"id {kind}, vector array<double>")
