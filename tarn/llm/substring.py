"""Substring dedup: remove the words of every passage of `window` words that an earlier document already holds.

Method. A log-structured index of fingerprints. Each window of 50 words is represented by the least hash of its 8-word
grams (the rightmost of equal ones), so equal windows always have the same representative, and neighbouring windows
mostly share it: the windows of one representative form a span, and only spans are indexed. A batch's spans become one
immutable run, bucketed and sorted by representative. The batch's run is merge-joined with all runs, bucket by bucket, so
that only rows of the index whose representative the batch has are moved. A span whose fingerprint an earlier document has
goes whole, once a digest of its words equals that of the earlier document's words (verification, of the two texts); where
one representative has several different spans, digests of the words of their single windows are compared. Runs are
compacted once there are more than `fan`.

Skew. A span counts once per run however many documents hold it, so a passage in a third of all rows is one row; of
each distinct span only the first holder is looked at window by window. What is known of spans with many holders is
broadcast to them: there are few of those, as the holders are counted.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import common as C

GRAM = 8
#: Low bits of an order key that hold the position, for rightmost ties, and how many windows are ordered at once.
_POSITION = np.uint64((1 << 24) - 1)
STRETCH = 1 << 22
#: Spans with at least so many holders in a batch have many; with more than a batch's spans by MOST_HOT, so that they are few.
HOLDERS, MOST_HOT = 1000, 200_000
#: Bytes of a digest of words.
DIGEST = 16

SPAN = "anchor long, span long, id long, s int, e int"
RUN = "anchor long, span long, id long, last long, n long, s int, e int"
KNOWN = "anchor long, span long, id long, last long, n long, words binary, windows array<binary>"


def least_places(g: np.ndarray, wide: int) -> np.ndarray:
    """For every run of `wide` of the hashes g the place of the least, the rightmost of equal ones."""
    out = np.empty(max(len(g) - wide + 1, 0), np.int64)
    for a in range(0, len(out), STRETCH):
        part = g[a : a + STRETCH + wide - 1]
        low = (part & ~_POSITION) | (_POSITION - np.arange(len(part), dtype=np.uint64))
        reach = 1
        while reach * 2 <= wide:
            low = np.minimum(low[: len(low) - reach], low[reach:])
            reach *= 2
        if reach < wide:
            low = np.minimum(low[: len(low) - (wide - reach)], low[wide - reach :])
        out[a : a + len(low)] = (_POSITION - (low & _POSITION)).astype(np.int64) + a
    return out


def window_spans(words: C.Words, window: int) -> tuple[np.ndarray, ...]:
    """(text number, first window start, last window start, representative, span hash) of the spans of all texts.

    Starts are word numbers within their text.
    """
    h, n = words.hashes(0), len(words.starts)
    grams, wide = min(GRAM, window), window - min(GRAM, window) + 1
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    at = np.arange(n - grams + 1)
    g = C.ranges_hash(C.mix(h), at, at + grams, 0)
    pos = least_places(g, wide)  # of the representative, for each window start
    text = np.searchsorted(words.bounds, np.arange(n - window + 1), "right") - 1
    inside = np.flatnonzero(np.arange(n - window + 1) + window <= words.bounds[text + 1])
    if not len(inside):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    p, t = pos[inside], text[inside]
    cut = np.flatnonzero((p[1:] != p[:-1]) | (t[1:] != t[:-1])) + 1
    first, last = inside[np.concatenate([[0], cut])], inside[np.concatenate([cut - 1, [len(inside) - 1]])]
    t = text[first]
    span = C.ranges_hash(C.mix(words.hashes(1)), first, last + window, 1)
    base = words.bounds[t]
    return t, first - base, last - base, g[pos[first]], span


def _spans(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for at, _, words in C.word_chunks(batch.column("text")):
            t, s, e, anchor, span = window_spans(words, window)
            if len(t):
                yield pa.RecordBatch.from_arrays([C.as_long(anchor), C.as_long(span), pa.array(ids[at + t]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["anchor", "span", "id", "s", "e"])


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=DIGEST).digest()


def _known(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """For every span asked for, the digest of its words and, where its representative has several, of each window's."""
    for batch in batches:
        asked = batch.column("asked")
        rows = asked.flatten()
        n = asked.value_lengths().to_numpy()
        s, e, several = (rows.field(c).to_pylist() for c in ("s", "e", "several"))
        whole: list[bytes] = []
        single: list[list[bytes] | None] = []
        at = 0
        for text, m in zip(batch.column("text").cast(pa.binary()).to_pylist(), n.tolist(), strict=True):
            words = (text or b"").split()
            for k in range(at, at + m):
                whole.append(digest(words[s[k] : e[k] + window]))
                single.append([digest(words[j : j + window]) for j in range(s[k], e[k] + 1)] if several[k] else None)
            at += m
        ids = pa.array(np.repeat(batch.column("id").to_numpy(zero_copy_only=False), n))
        kept = {c: rows.field(c) for c in ("anchor", "span", "last", "n")}
        yield pa.RecordBatch.from_arrays([kept["anchor"], kept["span"], ids, kept["last"], kept["n"], pa.array(whole, pa.binary()), pa.array(single, pa.list_(pa.binary()))], names=["anchor", "span", "id", "last", "n", "words", "windows"])


def _cut(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Take the words of the windows s..e out of every text, if they are those of the digest that came with them."""
    for batch in batches:
        texts, cuts = batch.column("text").to_pylist(), batch.column("cuts")
        rows = cuts.flatten()
        starts, ends, digests = (rows.field(c).to_pylist() for c in ("s", "e", "words"))
        n, removed, sha, kept_texts = [], [], [], []
        at = 0
        for text, m in zip(texts, pc.fill_null(cuts.value_lengths(), 0).to_pylist(), strict=True):
            words = (text or "").encode().split()
            gone = 0
            kept = words
            if m:
                edge = np.zeros(len(words) + 1, np.int64)
                for k in range(at, at + m):
                    if digests[k] is None or digests[k] == digest(words[starts[k] : ends[k] + window]):
                        edge[starts[k]] += 1
                        edge[ends[k] + window] -= 1
                at += m
                keep = np.cumsum(edge[:-1]) == 0
                gone = len(words) - int(keep.sum())
                kept = [words[j] for j in np.flatnonzero(keep)]
            whole = b" ".join(kept)
            n.append(len(words))
            removed.append(gone)
            sha.append(hashlib.sha256(whole).hexdigest())
            if with_text:
                kept_texts.append(whole.decode() if gone else text)
        out = [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
        names = ["id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            out, names = [*out, pa.array(kept_texts, pa.string())], [*names, "kept_text"]
        yield pa.RecordBatch.from_arrays(out, names=names)


def _cut_out(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.select("id", "text", "cuts").mapInArrow(lambda it: _cut(it, window, with_text), schema)


#: Texts that keep all their words.
_UNCUT = "cast(null as array<struct<s:int,e:int,words:binary>>) cuts"


class FingerprintIndex:
    """Immutable runs of the spans of all documents so far: external tables in a folder that all executors share, bucketed
    by representative into as many buckets as the session has shuffle partitions when the index is made."""

    def __init__(self, spark: SparkSession, window: int = 50, fan: int = 2):
        self.spark, self.window, self.fan = spark, window, fan
        self.name = f"spans_{uuid.uuid4().hex}"
        self.path = C.shared_folder(spark, self.name)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.compacted = 0
        self._made = 0

    def _write(self, rows: DataFrame) -> str:
        """A run of rows (see RUN) that are not summed up by span yet; one file a bucket."""
        name = f"{self.name}_{self._made:05d}"
        self._made += 1
        first = F.min(F.struct("id", "s", "e"))
        rows = rows.repartition(self.buckets, "anchor").groupBy("anchor", "span").agg(first.alias("f"), F.max("last").alias("last"), F.sum("n").alias("n"))
        rows = rows.select("anchor", "span", "f.id", "last", "n", "f.s", "f.e")
        rows.write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _plain(self, name: str) -> DataFrame:
        """A run without its buckets, for unions: Spark 4.1 takes a union of bucketed tables for bucketed, but reads it as not."""
        return self.spark.read.schema(RUN).parquet(f"{self.path}/{name}")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        C.delete(self.spark, f"{self.path}/{name}")

    def compact(self) -> None:
        """Merge all runs into one; a span keeps its first holder."""
        if len(self.runs) > 1:
            rows = self._plain(self.runs[0])
            for name in self.runs[1:]:
                rows = rows.unionByName(self._plain(name))
            old, self.runs = self.runs, [self._write(rows)]
            self.compacted += 1
            for name in old:
                self._drop(name)

    def delete(self) -> None:
        """Remove the runs; what add() returned does not need them."""
        for name in self.runs:
            self._drop(name)
        C.delete(self.spark, self.path)
        self.runs = []

    def add(self, batch: DataFrame, seen: DataFrame, with_text: bool = False) -> DataFrame:
        """Dedupe a batch (id, text) against all earlier batches and itself, and index it.

        Ids must be greater than those of earlier batches. seen holds (id, text) of all documents up to and with this
        batch: texts are looked up there for verification. Returns (id, n_words, n_removed, kept_sha256[, kept_text]).
        """
        window = self.window
        spans = C.stored(batch.mapInArrow(lambda it: _spans(it, window), SPAN))
        # one shuffle of partial sums: a span with many holders is a row a task
        first = F.min(F.struct("id", "s", "e"))
        summed = spans.groupBy("anchor", "span").agg(first.alias("f"), F.max("id").alias("last"), F.count("*").alias("n"))
        new = self._write(summed.select("anchor", "span", "f.id", "last", "n", "f.s", "f.e"))
        rows, mine = self._plain(new).withColumn("now", F.lit(True)), self.spark.table(new).select("anchor")
        for name in self.runs:
            rows = rows.unionByName(self.spark.table(name).join(mine, "anchor", "left_semi").withColumn("now", F.lit(False)))
        self.runs.append(new)
        here = F.sum(F.when(F.col("now"), F.col("n")).otherwise(0))
        known = rows.groupBy("anchor", "span").agg(first.alias("f"), F.max("last").alias("last"), here.alias("n"))
        several = known.groupBy("anchor").agg(F.min("span").alias("low"), F.max("span").alias("high")).where("low <> high").select("anchor", F.lit(True).alias("several"))
        known = C.join_ids(known.select("anchor", "span", "f.id", "last", "n", "f.s", "f.e"), C.checkpointed(several), "anchor", "left").withColumn("several", F.coalesce("several", F.lit(False)))
        asked = known.where("several or id < last").groupBy("id").agg(F.collect_list(F.struct("anchor", "span", "last", "n", "s", "e", "several")).alias("asked"))
        asked = C.checkpointed(asked)
        texts = C.join_ids(seen.select("id", "text"), asked.select("id"), "id", "left_semi").join(asked, "id").dropDuplicates(["id"])
        found = C.stored(texts.mapInArrow(lambda it: _known(it, window), KNOWN))

        single = found.where("windows is not null").select("anchor", "span", "id", F.posexplode("windows").alias("rel", "w"))
        shared = single.groupBy("w").agg(F.min("id").alias("earliest"), F.max("id").alias("latest")).where("earliest < latest").drop("latest")
        holes = C.checkpointed(single.join(shared, "w").where("earliest < id").groupBy("anchor", "span").agg(F.collect_set("rel").alias("holes")))
        known = found.drop("windows").withColumnRenamed("id", "first").join(holes, ["anchor", "span"], "left").where("holes is not null or first < last").drop("last")
        known = C.checkpointed(known)

        hot = F.col("n") >= max(HOLDERS, spans.count() // MOST_HOT)
        often, keys = known.where(hot), ["anchor", "span"]
        hit = spans.join(F.broadcast(often), keys).unionByName(spans.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(known.where(~hot), keys))
        whole = hit.where("id > first").select("id", "s", "e", "words")
        part = hit.where("id = first and holes is not null").select("id", F.explode("holes").alias("rel"), "s").select("id", (F.col("s") + F.col("rel")).alias("s"), (F.col("s") + F.col("rel")).alias("e"), F.lit(None).cast("binary").alias("words"))
        cuts = C.checkpointed(whole.union(part).groupBy("id").agg(F.collect_list(F.struct("s", "e", "words")).alias("cuts")))
        if len(self.runs) > self.fan:
            self.compact()
        del rows, mine, texts, single, shared, holes, hit, whole, part, often, summed
        C.dropped(spans, found)
        touched = C.join_ids(batch, cuts.select("id"), "id", "left_semi").join(cuts, "id").select("id", "text", "cuts")
        rest = C.join_ids(batch, cuts.select("id"), "id", "left_anti").selectExpr("id", "text", _UNCUT)
        return _cut_out(touched.unionByName(rest), window, with_text)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, batches: int = 4, with_text: bool = False) -> DataFrame:
    """Remove from every document the words covered by a window that also starts in a document with a smaller id.

    The documents go through a FingerprintIndex in batches of ascending id, as they would arrive over time; the number
    of batches changes nothing in the result. Returns (id, n_words, n_removed, kept_sha256), with with_text also
    kept_text: the text itself where nothing goes, else the kept words joined by one space.

    Windows are judged on the input. Null, empty and short texts lose nothing (null counts as no words). Rows with a null
    id lose nothing and are no one's earlier document. Rows with equal ids must have equal texts and don't affect each
    other. An empty table gives an empty result; other columns are not read, whatever their names.
    """
    C.arrow_rows(docs.sparkSession)
    index = FingerprintIndex(docs.sparkSession, window)
    docs = C.inputs(docs, id=id_col, text=text_col)
    nameless = docs.where("id is null").selectExpr("id", "text", _UNCUT)
    docs = docs.where("id is not null")
    edges = docs.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(x) for x in edges})
    out = _cut_out(nameless, window, with_text)
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        upto = docs if high is None else docs.where(F.col("id") <= high)
        out = out.unionByName(index.add(upto if low is None else upto.where(F.col("id") > low), upto, with_text))
    index.delete()
    return out


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).withColumnRenamed("id", "doc_id")


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
cut AS (SELECT DISTINCT doc_id, i + o AS p FROM win JOIN f USING (h), range(0, 50) AS r(o) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
