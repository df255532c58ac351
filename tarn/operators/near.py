"""Near duplicates within buckets by exact Jaccard, and the order-dependent choice among them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.retrieval import small
from tarn.sources.shared import checkpointed

#: Pairs with one least string up to which they stay in one cell, sets that are sketched in one go.
FREQUENT, GO = 1 << 17, 1000
#: Bits of the smallest bitmap, sets of the smallest block, and blocks that all sets make at most, besides one a bucket.
BITS, BLOCK, BLOCKS = 256, 1 << 13, 32
#: Rows and columns of bitmaps compared at once, strings of sets compared or gathered at once, bytes of sets in a cell.
ROWS, COLUMNS, STRINGS, CELL_BYTES = 16, 4096, 1 << 20, 16 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set (bucket, id, score, x) that isn't empty, 128 bits for the whole of it, its size, its least string, and the
    parities of its strings by their last bits: some two bits a string."""
    for batch in batches:
        batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column("x")), 0), 0))
        for from_ in range(0, batch.num_rows, GO):
            part = batch.slice(from_, GO)
            x = part.column("x")
            n, t = x.value_lengths().to_numpy().astype(np.int64), x.flatten().to_numpy().view(np.uint64)
            starts = np.cumsum(n) - n
            whole = np.add.reduceat(_mixed(t), starts), np.bitwise_xor.reduceat(_mixed(t ^ np.uint64(7)), starts)
            width = 1 << np.ceil(np.log2(np.maximum(1.75 * n, BITS))).astype(np.int64)
            ends = np.cumsum(width)
            at = np.repeat(ends - width, n) + (t & np.repeat(width - 1, n).view(np.uint64)).view(np.int64)
            bits = np.packbits((np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8))
            offsets = np.concatenate([[0], ends // 8]).astype(np.int32)
            maps = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(bits)])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("bucket", "id", "score")), *(pa.array(h.view(np.int64)) for h in whole), pa.array(n.astype(np.int32)), pa.array(np.minimum.reduceat(t.view(np.int64), starts)), maps], ["bucket", "id", "score", "h1", "h2", "n", "least", "bits"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of rows with equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(key).to_numpy()
        for a, b in pairwise([0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]):
            if held and b > a and held[0].column(key)[0].as_py() != k[a]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def _bitmaps(words: np.ndarray, first: np.ndarray, rows: slice, wide: int) -> np.ndarray:
    """The bitmaps of rows in order of size, a column each, folded to so many words: halves laid over each other keep parities."""
    width, parts = np.diff(first)[rows], []
    for w in np.unique(width):
        lo, hi = rows.start + np.searchsorted(width, w), rows.start + np.searchsorted(width, w, "right")
        some = words[first[lo] : first[hi]].reshape(hi - lo, w)
        while some.shape[1] > wide:
            half = some.shape[1] // 2
            some = some[:, :half] ^ some[:, half:]
        parts.append(some.T)
    return np.ascontiguousarray(np.concatenate(parts, axis=1))


def _pairs_of(n: np.ndarray, words: np.ndarray, first: np.ndarray, cut: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a tile that sizes and bitmaps allow: of rows before the cut with rows after it, no smaller ones, or
    among themselves if there is no cut. First some words of bitmaps of half the width are compared, as many as unlike sets need to
    differ enough, then for what is left whole ones."""
    own = cut == len(n)
    width = np.diff(first)
    x, c, three = np.empty((ROWS, COLUMNS), np.uint64), np.empty((ROWS, COLUMNS), np.uint8), np.empty((ROWS, COLUMNS), np.uint8)
    most = np.ceil(n * (100 - percent) / (100 + percent))
    kind = np.uint16 if 64 * width.max(initial=0) < 1 << 16 else np.int64
    most = most.astype(kind)
    for wide in np.unique(width[:cut]):
        from_, to = np.searchsorted(width[:cut], wide), np.searchsorted(width[:cut], wide, "right")
        begin = from_ if own else cut
        end = begin + np.searchsorted(n[begin:], 100 * n[to - 1] // percent, "right")
        if end == begin:
            continue
        a, b = _bitmaps(words, first, slice(from_, to), wide), _bitmaps(words, first, slice(begin, end), wide)
        a1, b1 = (m[: wide // 2] ^ m[wide // 2 :] for m in (a, b))
        for i in range(from_, to, ROWS):
            rows = slice(i, min(i + ROWS, to))
            last = begin + np.searchsorted(n[begin:end], 100 * n[rows.stop - 1] // percent, "right")
            if last == begin:
                continue
            # unlike sets differ in some 28 bits of a word, with a deviation of 4
            few = min(int(wide) // 2, math.ceil(((10 + math.sqrt(100 + 112.0 * (int(most[rows.stop - 1]) + int(most[last - 1])))) / 56) ** 2))
            for j in range(i if own else begin, last, COLUMNS):
                columns = slice(j, min(j + COLUMNS, last))
                shape = (rows.stop - i, columns.stop - j)
                d, (xs, cs, ts) = np.zeros(shape, kind), (m[: shape[0], : shape[1]] for m in (x, c, three))
                for w in range(few):
                    np.bitwise_xor(a1[w, i - from_ : rows.stop - from_, None], b1[w, None, j - begin : columns.stop - begin], out=xs)
                    np.bitwise_count(xs, out=cs if w % 3 else ts)
                    if w % 3:
                        np.add(ts, cs, out=ts)
                    if w % 3 == 2 or w == few - 1:
                        d += ts
                keep = d <= most[rows, None] + most[None, columns]
                if not keep.any():
                    continue
                p, q = np.nonzero(keep)
                p, q = p + i, q + j
                sized = (100 * n[p] >= percent * n[q]) & (100 * n[q] >= percent * n[p]) & ((p < q) | (not own))
                p, q = p[sized], q[sized]
                for k in range(0, len(p), max(1, STRINGS // wide)):
                    ps, qs = p[k : k + max(1, STRINGS // wide)], q[k : k + max(1, STRINGS // wide)]
                    differ = np.bitwise_count(a[:, ps - from_] ^ b[:, qs - begin]).sum(0, dtype=np.int64)
                    both = n[ps] + n[qs]
                    # each differing parity needs a string that one of them doesn't hold
                    good = differ <= both + 2 * (-percent * both // (100 + percent))
                    if good.any():
                        yield ps[good], qs[good]


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b), structs (id, least, n), of the rows of tiles."""
    for tile in _groups(batches, "tile"):
        ids, n, bits = _column(tile, "rep"), tile.column("n").to_numpy().astype(np.int64), _column(tile, "bits")
        offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
        words, first = np.frombuffer(bits.buffers()[2], np.uint64, offsets[-1] // 8), offsets // 8
        rank = ids.to_numpy(zero_copy_only=False)
        every = pa.StructArray.from_arrays([ids, _column(tile, "least"), _column(tile, "n")], ["id", "least", "n"])
        for p, q in _pairs_of(n, words, first, int(np.searchsorted(tile.column("side").to_numpy(), 1)), percent):
            later = (rank[p] > rank[q]).astype(bool)
            yield pa.RecordBatch.from_arrays([every.take(pa.array(np.where(later, q, p))), every.take(pa.array(np.where(later, p, q)))], ["a", "b"])


def _candidates(best: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the sketches (bucket, rep, n, least, bits) that sizes and bitmaps allow to be alike, each once.

    In order of size, sets of a bucket are dealt to blocks; a tile is two blocks whose sizes allow pairs. All sets make BLOCKS
    blocks, or smaller ones of BLOCK sets, so a sketch is moved to as many tiles at most, however many sets there are.
    """
    sizes = checkpointed(best.groupBy("bucket", "n").agg(F.count("*").alias("c")))
    block = max(BLOCK, -(-(sizes.agg(F.sum("c")).first()[0] or 0) // BLOCKS))
    before = F.sum("c").over(Window.partitionBy("bucket").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    starts = small(sizes.withColumn("before", F.coalesce(before, F.lit(0))))
    at = F.floor((F.col("before") + F.pmod(F.xxhash64("rep"), F.col("c"))) / block)
    placed = best.join(starts, ["bucket", "n"]).withColumn("at", at)
    spans = checkpointed(placed.groupBy("bucket", "at").agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    low, high = (spans.select("bucket", F.col("at").alias(c), F.col(e).alias(f"{c}_{e}")) for c, e in (("low", "hi"), ("high", "lo")))
    tiles = low.join(high, "bucket").where((F.col("low") <= F.col("high")) & (percent * F.col("high_lo") <= 100 * F.col("low_hi")))
    tiles = checkpointed(tiles.select("bucket", "low", "high", F.xxhash64("bucket", "low", "high").alias("tile")))
    sides = tiles.select("bucket", F.col("low").alias("at"), "tile", F.lit(0).alias("side")).union(tiles.where("low < high").select("bucket", "high", "tile", F.lit(1)))
    tasks = max(best.sparkSession.sparkContext.defaultParallelism, min(2 * tiles.count(), 2 * BLOCKS * BLOCKS))
    dealt = placed.join(small(sides), ["bucket", "at"]).select("tile", "side", "rep", "n", "least", "bits")
    end = f"struct<id:{dict(best.dtypes)['rep']},least:long,n:int>"
    return dealt.repartition(tasks, "tile").sortWithinPartitions("tile", "side", "n").mapInArrow(lambda it: _near(it, percent), f"a {end}, b {end}")


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of cells that are alike, by the sets (a, x) that come before them."""
    for cell in _groups(batches, "cell"):
        cut = int(np.searchsorted(cell.column("kind").to_numpy(), 1))
        sets, asked = cell.slice(0, cut), cell.slice(cut)
        x = _column(sets, "x")
        n, t = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), x.flatten().to_numpy()
        first, ids = np.cumsum(n) - n, _column(sets, "a").to_numpy(zero_copy_only=False)
        order = np.argsort(ids)
        a, b = (order[np.searchsorted(ids, _column(asked, c).to_numpy(zero_copy_only=False), sorter=order)] for c in ("a", "b"))
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for from_, to in pairwise([0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]):
            i = a[from_]
            own = np.sort(t[first[i] : first[i] + n[i]])
            step = max(1, STRINGS // int(n[b[from_:to]].max()))
            for k in range(from_, to, step):
                j = b[k : min(k + step, to)]
                m = n[j]
                starts = np.cumsum(m) - m
                other = t[np.repeat(first[j] - starts, m) + np.arange(m.sum())]
                both = np.add.reduceat((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).astype(np.int64), starts)
                either = n[i] + m - both
                alike = 100 * both >= percent * either
                found.append((np.full(int(alike.sum()), i), j[alike], (both / either)[alike]))
        p, q, jaccard = (np.concatenate(c) for c in zip(*found, strict=True))
        names = _column(sets, "a")
        for k in range(0, len(p), STRINGS):
            ps, qs = (pa.array(c[k : k + STRINGS]) for c in (p, q))
            yield pa.RecordBatch.from_arrays([_column(sets, "bucket").take(ps), names.take(ps), names.take(qs), pa.array(jaccard[k : k + STRINGS])], ["bucket", "a", "b", "jaccard"])


def near_classes(rows: DataFrame, percent: int, of: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """((bucket, a, b, jaccard), a < b; (bucket, rep, id)) of rows (bucket, id, x: distinct strings[, score]): the pairs with
    100 |x & y| >= percent |x | y| between representatives of equal sets, and the other members of each class. A class is
    represented by its greatest score, the least id of equal ones; without scores by its least id. Rows without strings are
    in no class.

    Strings are hashed to 64 bits with their bucket. What is kept of a set is a sketch of some hundred bytes; sketches are compared
    all with all that their sizes allow, tile by tile, and only pairs whose bitmaps allow it leave their task: no string and no
    pair that isn't near is moved. The sets of near pairs are made again from the rows, moved once to each cell that asks for
    them and compared there, never once a pair: near copies mostly share their least string, which makes the cell.
    of(ids) gives the rows (bucket, id, x) of some ids (id), where they can be picked before their strings are made. Members are
    joined to their class by a hash of 128 bits, and never gathered.
    """
    score = F.col("score") if "score" in rows.columns else F.lit(0)
    hashed = F.transform("x", lambda t: F.xxhash64("bucket", t)).alias("x")
    kinds = dict(rows.withColumn("score", score).dtypes)
    schema = f"bucket {kinds['bucket']}, id {kinds['id']}, score {kinds['score']}, h1 long, h2 long, n int, least long, bits binary"
    sketches = checkpointed(rows.select("bucket", "id", score.alias("score"), hashed).mapInArrow(_sketches, schema))
    key = ["bucket", "h1", "h2"]
    top = F.min_by(F.struct(F.col("id").alias("rep"), "n", "least", "bits"), F.struct((-F.col("score")).alias("s"), F.col("id")))
    best = checkpointed(sketches.groupBy(*key).agg(top.alias("top")).select(*key, "top.*"))
    members = sketches.select(*key, "id").join(best.select(*key, "rep"), key).where("id <> rep").select("bucket", "rep", "id")
    near = checkpointed(_candidates(best.drop("h1", "h2"), percent))

    ends = near.select(F.col("a").alias("e")).union(near.select("b")).select("e.id", "e.n").distinct()
    cells = max(rows.sparkSession.sparkContext.defaultParallelism, -(-8 * (ends.agg(F.sum("n")).first()[0] or 0) // CELL_BYTES))
    pairs = near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.least("a.least", "b.least").alias("t"))
    many = small(pairs.groupBy("t").agg(F.ceil(F.sqrt(F.count("*") / (FREQUENT + 1))).alias("k")).where("k > 1"))
    parts = [F.pmod(F.xxhash64(c), F.col("k")) for c in ("a", "b")]
    cell = F.when(F.col("k").isNull(), F.pmod("t", F.lit(cells))).otherwise(F.xxhash64("t", *parts))
    pairs = pairs.join(many, "t", "left").select(cell.alias("cell"), "a", "b")
    needs = checkpointed(pairs.select("cell", F.col("a").alias("id")).union(pairs.select("cell", "b")).distinct())
    asked = small(needs.select("id").distinct())
    held = of(asked) if of else rows.join(asked, "id", "left_semi")
    held = held.select("bucket", "id", hashed).join(small(needs), "id")
    both = held.select("cell", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(None).cast(kinds["id"]).alias("b"), "bucket", "x")
    both = both.unionByName(pairs.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(cells, "cell").sortWithinPartitions("cell", "kind")
    return both.mapInArrow(lambda it: _compared(it, percent), f"bucket {kinds['bucket']}, a {kinds['id']}, b {kinds['id']}, jaccard double"), members


def near_pairs(rows: DataFrame, percent: int, of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(bucket, a, b, jaccard) of rows (bucket, id, x): the pairs of representatives, the least ids of equal sets, and each
    other member with its own: as many as there are copies, not as their pairs."""
    pairs, members = near_classes(rows.select("bucket", "id", "x"), percent, of)
    return pairs.unionByName(members.select("bucket", F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard")))


def accepted_in_order(pairs: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id, accepted) of the ids in pairs (a, b), a < b: an id is refused if an accepted smaller one is paired with it.

    A round settles every id whose smaller partners are settled: one of them accepted refuses it, all refused accept it. The
    rounds are as many as the longest chain of partners, not as the ids.
    """
    pairs = checkpointed(pairs.distinct())
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    state = checkpointed(ids.join(pairs.select(F.col("b").alias("id")).distinct().withColumn("waits", F.lit(True)), "id", "left").select("id", F.when(F.col("waits").isNull(), True).alias("accepted")))
    for _ in range(rounds):
        if not state.where("accepted is null").limit(1).count():
            return state
        before = pairs.join(state.select(F.col("id").alias("a"), F.col("accepted").alias("was")), "a").groupBy(F.col("b").alias("id")).agg(F.bool_or("was").alias("some"), F.sum(F.col("was").isNull().cast("int")).alias("open"))
        verdict = F.when(F.col("some"), False).when(F.col("open") == 0, True)
        state = checkpointed(state.join(before, "id", "left").select("id", F.coalesce("accepted", verdict).alias("accepted")))
    raise RuntimeError(f"the order did not settle in {rounds} rounds")


def accepted(rows: DataFrame, percent: int, of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, accepted) of the rows (bucket, id, x) that are alike some other one, taken in order of ids: refused if one that
    was accepted before is alike. Whatever became of the first of equal sets, the others are refused with it or by it."""
    pairs, members = near_classes(rows.select("bucket", "id", "x"), percent, of)
    return accepted_in_order(pairs.select("a", "b")).unionByName(members.select("id", F.lit(False).alias("accepted")))
