"""N-gram Jaccard join: which documents share at least a given part of their word shingles.

Method. Every document becomes a set of 64-bit shingle hashes with a parity bitmap of about as many bits. Two sets with
Jaccard t share one of the first |x| - ceil(t|x|) + 1 shingles of a global order, and their sizes differ by a factor of 1/t
at most. With bands of sizes a factor of 1/t wide, tiles are keyed by (size band, shingle): a set is a member of the tiles
of its own band and a guest in those of the band below, and guests aren't compared with each other. Within a tile the bits
that differ between two bitmaps bound the overlap from above (each differing bit stands for a shingle that one set lacks),
and what passes is decided by intersecting sorted arrays.

Skew. Any global order gives the same links, so shingles that many documents hold (found by lossy counting over all
documents in bounded memory) go last in it. Equal sets are one node. Holders of a shingle are first linked to its first
holder only; after that, tiles hold only sets of different components, so groups of near copies stay linear. A tile that is
still large is cut into blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C

#: Bits of the smallest bitmap; larger sets have the next power of two.
LEAST_BITS = 512
#: Bits to which bitmaps are folded in tiles.
SHORT_BITS = 4096
#: Members up to which a tile stays whole.
TILE = 256
#: Shingles counted in a worker before those seen too rarely are forgotten.
BUCKET = 1_000_000
#: Documents with a shingle from which it goes to the end of the order, and how many such shingles there may be (2 MB).
FREQUENT, MOST_FREQUENT = 16, 1 << 18

SUMMARY = "kind int, id long, n long, sig1 long, sig2 long, bits array<long>, short array<long>"


def shingle_sets(words: C.Words, k: int) -> list[np.ndarray]:
    """For every text, its sorted distinct k-word shingle hashes; fewer words are one shingle, none are no shingle."""
    h = words.hashes(0)
    n = len(h)
    rolled = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + C.mix(h[i : n - k + 1 + i])
    rolled = C.mix(rolled)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for i in range(a, b):
                short = C.mix(short * np.uint64(0x9E3779B97F4A7C15) + C.mix(h[i : i + 1]))
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each of the bits, as 64-bit words."""
    bits = max(LEAST_BITS, 1 << max(len(s) - 1, 0).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(13)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray, most: int) -> np.ndarray:
    """A bitmap of at most `most` bits: halves are laid over each other, which keeps the parity."""
    while 64 * len(bits) > most:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two bitmaps differ, the longer folded: at most the number of shingles that only one set has."""
    least = 64 * min(len(a), len(b))
    a, b = folded(a, least), folded(b, least)
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def prefix_size(n: int, percent: int) -> int:
    """How many shingles of a set of n must be looked at so that a partner shows up among them."""
    return n - -(-percent * n // 100) + 1 if n else 0


def band(n: Column, percent: int) -> Column:
    """The size band of a set of n: two sets that link are in the same or in neighbouring bands."""
    # a little wider than the factor, so that rounding can't part two sets by more than one band
    return F.floor(F.log(n) / (math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9)).cast("int")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]).astype(np.int32)), pa.array(np.concatenate(arrays)))


def _summaries(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0: id, size, set hash, bitmap) for documents; rows (kind 1: shingle, count) for frequent shingles."""
    counts: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    waiting: list[np.ndarray] = []
    pending = 0

    def fold(keep_over: int) -> None:
        nonlocal counts, waiting, pending
        if waiting:
            x, n = np.unique(np.concatenate(waiting), return_counts=True)
            keys, at = np.unique(np.concatenate([counts[0], x]), return_inverse=True)
            n = np.bincount(at, np.concatenate([counts[1], n]), len(keys)).astype(np.int64)
            counts, waiting, pending = (keys[n > keep_over], n[n > keep_over] - (1 if keep_over else 0)), [], 0

    for batch in batches:
        for at, to, words in C.word_chunks(batch.column("text"), lower=True):
            sets = shingle_sets(words, k)
            for s in sets:
                if len(s):
                    waiting.append(s)
                    pending += len(s)
            if pending >= BUCKET:
                fold(1)
            rows = len(sets)
            sig = [(int(np.bitwise_xor.reduce(C.mix(s ^ np.uint64(77))) if len(s) else 0), int(np.add.reduce(C.mix(s))) if len(s) else 0) for s in sets]
            bits = [bitmap(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(rows, np.int32)), batch.column("id")[at:to], pa.array(np.array([len(s) for s in sets], np.int64))]
                + [C.as_long(np.array([x[i] for x in sig], np.uint64)) for i in (0, 1)]
                + [_lists(bits), _lists([folded(b, SHORT_BITS) for b in bits])],
                names=["kind", "id", "n", "sig1", "sig2", "bits", "short"],
            )
    fold(0)
    some = counts[1] > 1
    keys, n = counts[0][some], counts[1][some]
    none = np.zeros(len(keys), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), C.as_long(keys), pa.array(n), pa.array(none), pa.array(none), *[pa.nulls(len(keys), pa.list_(pa.int64()))] * 2], names=["kind", "id", "n", "sig1", "sig2", "bits", "short"])


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, percent: int, frequent) -> Iterator[pa.RecordBatch]:
    """(token, id): the first shingles of every set in the order of (frequent, hash)."""
    late = frequent.value
    for batch in batches:
        for at, to, words in C.word_chunks(batch.column("text"), lower=True):
            ids = batch.column("id").slice(at, to - at).to_numpy(zero_copy_only=False)
            tokens, owners = [], []
            for id_, s in zip(ids.tolist(), shingle_sets(words, k), strict=True):
                if not len(s):
                    continue
                p = prefix_size(len(s), percent)
                if len(late):
                    where = np.searchsorted(late, s)
                    where[where == len(late)] = 0
                    is_late = late[where] == s
                    s = np.concatenate([s[~is_late], s[is_late]])
                tokens.append(s[:p])
                owners.append(np.full(p, id_, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([C.as_long(np.concatenate(tokens)), pa.array(np.concatenate(owners))], names=["token", "id"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and id, each counted once, those whose token has more than one, with the first id of the
    token. Holds one batch."""
    last: tuple[int, int, bool] | None = None  # token, first id, whether its first row is out
    before: tuple[int, int] | None = None  # the last row
    for batch in batches:
        t, ids = batch.column("token").to_numpy(), batch.column("id").to_numpy()
        if not len(t):
            continue
        other = np.ones(len(t), bool)
        other[1:] = (t[1:] != t[:-1]) | (ids[1:] != ids[:-1])
        other[0] = before != (t[0], ids[0])
        before = (t[-1], ids[-1])
        t, ids = t[other], ids[other]
        if not len(t):
            continue
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        new[0] = last is None or t[0] != last[0]
        group = np.cumsum(new) - int(new[0])
        firsts = np.flatnonzero(new)
        lead = ids[firsts] if new[0] else np.concatenate([[last[1]], ids[firsts]])
        keep = ~new
        keep[:-1] |= ~new[1:]
        keep[-1] = not new[-1]
        out_t, out_i, out_l = t[keep], ids[keep], lead[group[keep]]
        if not new[0] and not last[2]:
            out_t, out_i, out_l = (np.concatenate([[x], y]) for x, y in ((last[0], out_t), (last[1], out_i), (last[1], out_l)))
        if len(out_t):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (out_t, out_i, out_l)], names=["token", "id", "lead"])
        last = (int(t[-1]), int(lead[group[-1]]), bool(keep[-1]))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, words in C.word_chunks(batch.column("text"), lower=True):
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), pa.array([s.tobytes() for s in shingle_sets(words, k)], pa.binary())], names=["id", "s"])


def _exact(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose sorted arrays intersect in enough shingles."""
    for batch in batches:
        x, y = batch.column("sa"), batch.column("sb")
        keep = np.zeros(len(batch), bool)
        for i in range(len(batch)):
            a, b = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
            c = np.sort(np.concatenate([a, b]))
            both = int(np.count_nonzero(c[1:] == c[:-1]))
            keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs that can link by the bits that differ: |x & y| <= (|x| + |y| - differing bits) / 2."""
    for batch in batches:
        x, y = batch.column("xbits"), batch.column("ybits")
        n = (batch.column("xn").to_numpy() + batch.column("yn").to_numpy()).tolist()
        keep = pa.array([(100 + percent) * (n[i] - differing(x[i].values.to_numpy(), y[i].values.to_numpy())) >= 2 * percent * n[i] for i in range(len(batch))], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _tile_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different components within a tile that can link by their sizes and the bits that differ.

    Rows come sorted by (token, band, low, high, n): in a tile, a set's partners in size follow it. Rows of a tile that
    spans batches are carried over; a tile has 2 * TILE rows or so.
    """
    seen: set[tuple[int, int]] = set()
    carry: pa.Table | None = None

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, band, low, high, n, rep, component, own = (table.column(c).to_numpy() for c in ("token", "band", "low", "high", "n", "rep", "component", "own"))
        guest = table.column("guest").to_numpy(zero_copy_only=False)
        bits = table.column("bits").combine_chunks()
        width = np.diff(bits.offsets.to_numpy())
        words, first = bits.values.to_numpy().view(np.uint64), bits.offsets.to_numpy()[:-1]
        rows, step = np.arange(len(n)), 0
        while len(rows):
            step += 1
            rows = rows[rows + step < len(n)]
            other = rows + step
            same = (token[rows] == token[other]) & (band[rows] == band[other]) & (low[rows] == low[other]) & (high[rows] == high[other]) & (percent * n[other] <= 100 * n[rows])
            rows = rows[same]
            other = rows + step
            use = (component[rows] != component[other]) & ~(guest[rows] & guest[other]) & ((low[rows] == high[rows]) | (own[rows] != own[other]))
            x, y = rows[use], other[use]
            keep = np.zeros(len(x), bool)
            equal = width[x] == width[y]
            for w in np.unique(width[x[equal]]):
                at = np.flatnonzero(equal & (width[x] == w))
                span = np.arange(w)
                d = np.bitwise_count(words[first[x[at]][:, None] + span] ^ words[first[y[at]][:, None] + span]).sum(1, dtype=np.int64)
                both = n[x[at]] + n[y[at]]
                keep[at] = (100 + percent) * (both - d) >= 2 * percent * both
            for i in np.flatnonzero(~equal):
                d = differing(*(words[first[j] : first[j] + width[j]].view(np.int64) for j in (x[i], y[i])))
                keep[i] = (100 + percent) * (n[x[i]] + n[y[i]] - d) >= 2 * percent * (n[x[i]] + n[y[i]])
            found = list(dict.fromkeys(zip(np.minimum(rep[x[keep]], rep[y[keep]]).tolist(), np.maximum(rep[x[keep]], rep[y[keep]]).tolist(), strict=True)))
            found = [f for f in found if f not in seen]
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(found)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([carry, table]) if carry is not None else table
        key = [table.column(c).to_numpy() for c in ("token", "band", "low", "high")]
        last = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from pairs(table.slice(0, cut).combine_chunks())
        carry = table.slice(cut)
    if carry is not None and len(carry):
        yield from pairs(carry.combine_chunks())


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, every_link: bool = False) -> dict[str, DataFrame]:
    """Join documents with 100 * |x & y| >= percent * |x | y| over sets of k-word shingles.

    Returns "documents" (id, n_shingles, component_id) with every input row, "classes" (representative, sig1, sig2) of
    equal sets, and "links" (a, b) between representatives: as many as make the components, or with every_link all.

    Null and empty texts have no shingle and stand alone. Repeated rows and equal texts fall into one class. Rows with a
    null id are rows of the result with the size of their set, linked with nothing. Rows with equal ids must have equal
    texts. An empty table gives empty results. Other columns of docs are not read, whatever their names.
    """
    C.arrow_rows(docs.sparkSession)
    spark = docs.sparkSession
    every = C.inputs(docs, id=id_col, text=text_col)
    docs = every.where("id is not null")
    read = C.checkpointed(docs.mapInArrow(lambda it: _summaries(it, k), SUMMARY))
    counts = read.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = np.sort(np.array([r[0] for r in counts.orderBy(F.desc("n"), "id").limit(MOST_FREQUENT).select("id").toLocalIterator()], np.int64).view(np.uint64))
    frequent = spark.sparkContext.broadcast(top)

    meta = read.where("kind = 0").drop("kind")
    classes = meta.where("n > 0").groupBy("sig1", "sig2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("short").alias("short"))
    classes = C.checkpointed(classes)
    # of equal sets one is looked at, so tokens and tiles are of classes from here on
    reps = classes.select(F.col("rep").alias("id"))
    rows = C.join_ids(docs, reps, "id", "left_semi").mapInArrow(lambda it: _prefixes(it, k, percent, frequent), "token long, id long")
    shared = rows.repartition("token").sortWithinPartitions("token", "id").mapInArrow(_shared, "token long, id long, lead long")
    shared = C.checkpointed(shared.select("token", F.col("id").alias("rep"), F.col("lead").alias("lead_rep")))
    del rows
    C.released(spark)  # the prefixes of all sets, the largest shuffle

    signed = classes.select("rep", "n", "bits", "short")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of representatives, those that link, by bits first and then exactly."""
        x, y = (signed.select(F.col("rep").alias(c), F.col("n").alias(f"{s}n"), F.col("bits").alias(f"{s}bits")) for c, s in (("a", "x"), ("b", "y")))
        sized = pairs.join(x, "a").join(y, "b").where(100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn"))
        near = C.checkpointed(sized.mapInArrow(lambda it: _bounded(it, percent), "a long, b long"))
        ids = C.checkpointed(near.select(F.col("a").alias("id")).union(near.select("b")).distinct())
        sets = C.join_ids(docs, ids, "id").dropDuplicates(["id"]).mapInArrow(lambda it: _sets(it, k), "id long, s binary")
        sets = C.checkpointed(sets)
        both = near.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        return C.checkpointed(both.mapInArrow(lambda it: _exact(it, percent), "a long, b long"))

    near_first = shared.where("rep <> lead_rep").groupBy(F.col("rep").alias("b")).agg(F.min("lead_rep").alias("a"))
    first = linked(near_first.where(F.lit(not every_link)))
    labels = C.components(first)
    placed = C.join_ids(shared.select("token", "rep"), labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = placed.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("token")
    sized = C.join_ids(placed.join(apart, "token"), signed.select("rep", "n"), "rep").withColumn("at", band(F.col("n"), percent))
    C.released(spark)
    sized = C.checkpointed(sized).withColumn("band", F.explode(F.array(F.col("at"), F.col("at") - 1))).withColumn("guest", F.col("band") < F.col("at")).drop("at")
    # a tile needs a member besides what else it has, from another component
    tile = sized.groupBy("token", "band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size"), F.bool_and("guest").alias("guests")).where("least <> most and not guests")
    blocks = F.ceil(F.col("size") / TILE).cast("int")  # a tile of many members becomes tiles of pairs of blocks
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    tiles = sized.join(tile.select("token", "band", blocks.alias("blocks")), ["token", "band"]).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("token", "band", "rep", "n", "component", "guest", "own", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high")).join(signed.select("rep", F.col("short").alias("bits")), "rep")
    tiles = tiles.repartition("token", "band", "low", "high").sortWithinPartitions("token", "band", "low", "high", "n", "rep")
    second = linked(tiles.mapInArrow(lambda it: _tile_pairs(it, percent), "a long, b long").distinct())
    links = first.union(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    whole = C.components(links) if second.limit(1).count() else labels
    named = classes.select("sig1", "sig2", "rep").join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("sig1", "sig2", F.coalesce("component", "rep").alias("component_id"))
    out = meta.select("id", F.col("n").alias("n_shingles"), "sig1", "sig2").join(named, ["sig1", "sig2"], "left").select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    nameless = every.where("id is null").mapInArrow(lambda it: _summaries(it, k), SUMMARY).where("kind = 0")
    out = out.unionByName(nameless.select("id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
    return {"documents": out, "classes": classes.select("rep", "sig1", "sig2"), "links": links}


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_join(docs)["documents"].select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""
