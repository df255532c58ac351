"""Best-fit packing of token pieces into sequences of fixed capacity by a grouping genetic algorithm on islands.

Method. An island is a hashed share of the pieces. Its individuals are assignments of pieces to bins, the first ones
by best fit over pieces in falling and in disturbed order. A child takes whole well-filled bins of one parent, drops the
other parent's bins that hold the same pieces, and best-fits the pieces so displaced; mutation empties the worst-filled
bins. Fitness is the mean square of fill, so that space gathers in few bins. After each era the full bins are settled;
the other bins of the best individual, its elite, migrate whole to islands of the next era, where bins from many islands
meet and breed. An island stops as soon as it has as few bins as its tokens can take.

Islands depend only on the number of pieces, so no task holds more than some ISLAND pieces, whatever their lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C
from tarn.llm.tokens import encoded

CAPACITY = 4096
ISLAND, ERAS = 8000, 3
POPULATION, GENERATIONS, PATIENCE = 6, 30, 8

PIECE = "id long, row long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int) -> Iterator[pa.RecordBatch]:
    """A row for each piece: documents longer than the capacity are cut at multiples of it."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    for keys, arrays in encoded(batches, path, "key"):
        out = []
        for key, tokens in zip(keys, arrays, strict=True):
            ids = tokens.astype("<u4")
            for n, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                out.append((key["id"], key["row"], n, start, len(part), zlib.crc32(part.tobytes())))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "row", "piece", "start", "length", "ids_crc32"])


def best_fit(lengths: list[int], order: list[int], bin_of: np.ndarray, room: list[int], capacity: int) -> None:
    """Put each piece into the fullest bin that takes it, or a new one; bin_of and room are changed in place."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has room r
    for b, r in enumerate(room):
        if r > 0:
            by_room[r].append(b)
            mask |= 1 << r
    for i in order:
        n = lengths[i]
        above = mask >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        r -= n
        room[b] = r
        bin_of[i] = b
        if r:
            by_room[r].append(b)
            mask |= 1 << r


def evolve(lengths: np.ndarray, capacity: int, rng: np.random.Generator, seeds: np.ndarray | None = None) -> np.ndarray:
    """The bin of each piece, from 0, in the best assignment found; seeds is an assignment that came from other islands."""
    n, least = len(lengths), -(-int(lengths.sum()) // capacity)
    as_list = lengths.tolist()

    def fitness(bin_of: np.ndarray) -> tuple[int, float]:
        fill = np.bincount(bin_of, lengths)
        return -len(fill), float(np.mean((fill / capacity) ** 2))

    def compact(bin_of: np.ndarray) -> np.ndarray:
        return np.unique(bin_of, return_inverse=True)[1]

    def filled(order: np.ndarray, bin_of: np.ndarray, room: list[int]) -> np.ndarray:
        best_fit(as_list, order.tolist(), bin_of, room, capacity)
        return compact(bin_of)

    def fresh(noise: float) -> np.ndarray:
        return filled(np.argsort(-lengths * (1 + noise * rng.random(n)), kind="stable"), np.full(n, -1), [])

    def child(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fill_b = np.bincount(b, lengths)
        good = np.flatnonzero(fill_b >= np.quantile(fill_b, 0.5))
        taken = np.isin(b, rng.choice(good, max(1, len(good) // 5), replace=False))
        hit = np.unique(a[taken])
        fill_a = np.bincount(a, lengths)
        worst = np.argsort(fill_a)[: max(1, len(fill_a) // 50)]
        gone = np.isin(a, np.concatenate([hit, worst]))
        out = np.where(taken, b + len(fill_a), a)
        out = np.unique(np.where(gone & ~taken, -1, out), return_inverse=True)[1] - int((gone & ~taken).any())
        loose = np.flatnonzero(gone & ~taken)
        room = (capacity - np.bincount(out[out >= 0], lengths[out >= 0])).astype(np.int64).tolist()
        return filled(loose[np.argsort(-lengths[loose], kind="stable")], out, room)

    people = [fresh(0.0)] + ([compact(seeds)] if seeds is not None else [])
    best = max(people, key=fitness)
    if best.max() + 1 <= least:
        return best
    people += [fresh(0.02 * (i + 1)) for i in range(POPULATION - len(people))]
    people.sort(key=fitness, reverse=True)
    still = 0
    for _ in range(GENERATIONS):
        before = fitness(people[0])
        x, y = rng.permutation(len(people))[:2]
        for a, b in ((x, y), (y, x)):
            people.append(child(people[a], people[b]))
        people = sorted(people, key=fitness, reverse=True)[:POPULATION]
        still = 0 if fitness(people[0]) > before else still + 1
        if people[0].max() + 1 <= least or still >= PATIENCE:
            break
    return people[0]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (id, row, piece, start, length, ids_crc32) with sequence_id and offset; lengths are 1 to capacity."""
    pieces = C.checkpointed(pieces)
    full = pieces.where(F.col("length") == capacity)
    open_ = pieces.where(F.col("length") < capacity).withColumn("bin", F.lit(None).cast("long"))
    schema = f"{PIECE}, bin long, settled boolean, island long"
    settled = None
    for era in range(ERAS):
        count = open_.count()
        islands, last = max(1, -(-count // ISLAND)), era == ERAS - 1 or count <= ISLAND

        def bred_island(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["row", "piece"], kind="stable").reset_index(drop=True)
            where = int(group["island"].iloc[0])
            lengths = group["length"].to_numpy()
            seeds = np.unique(group["bin"].to_numpy(), return_inverse=True)[1] if era else None
            bin_of = evolve(lengths, capacity, np.random.default_rng([era, where]), seeds)
            fill = np.bincount(bin_of, lengths)
            done = fill >= capacity * 0.999 if not last else np.ones(len(fill), bool)
            return group.assign(bin=(bin_of.astype(np.int64) * islands + where) * (ERAS + 1) + era, settled=done[bin_of])

        key = F.xxhash64("row", "piece") if era == 0 else F.xxhash64(F.lit(era), "bin")
        dealt = open_.withColumn("settled", F.lit(False)).withColumn("island", F.pmod(key, F.lit(islands)).cast("long"))
        bred = C.checkpointed(dealt.groupBy("island").applyInPandas(bred_island, schema))
        done = bred.where("settled").drop("settled")
        settled = done if settled is None else settled.unionByName(done)
        open_ = bred.where("not settled").drop("settled", "island")
        if last:
            break
    binned = settled.select("id", "row", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"))
    offsets = F.expr("sum(length) over (partition by sequence_id order by row, piece rows between unbounded preceding and 1 preceding)")
    binned = binned.withColumn("offset", F.coalesce(offsets, F.lit(0)).cast("long"))
    # sequences of one full piece are numbered below zero, apart from bins
    alone = full.select("id", "row", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return binned.unionByName(alone)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents: (id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    Null and empty texts are one end token. Repeated rows are separate documents. An empty table gives an empty result;
    other columns aren't read. Only documents longer than the capacity are cut.
    """
    C.arrow_rows(docs.sparkSession)
    rows = C.inputs(docs, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    keyed = rows.select(F.struct("id", "row").alias("key"), "text")
    return pack(keyed.mapInArrow(lambda it: _pieces(it, tokenizer, capacity), PIECE), capacity).drop("row")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs).withColumnRenamed("id", "doc_id")
