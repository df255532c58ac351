"""A trie of conversations' turns: how many share each beginning, and what that would save.

Method. A turn is a digest of role and text. Rebuilt conversations are laid out in order over all tasks, and each turn gets
the hash of all turns up to it, two times 64 bits, which with its depth is its node. Each batch of a task becomes a partial
trie, a table of its nodes with their parents, members and least member, and of the runs of conversations that end there.
Partial tries are merged by hashes of their nodes, first those of a group, then those of all groups: members are summed, the
least member stays. End lists are merged as runs of bounded size, in order, so that a digest of any number of ends takes the memory
of one run. The rollup goes from the bottom up along the path of each node's least member: the nodes of which a
conversation is the least member are the lower end of its path, so every node is summed up on one path only, and what it
has reaches all nodes above it, in one pass for any depth.

Skew. A conversation with a third of all turns is spread over tasks by running(); a node that a third of all conversations
share is one row a partial trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C
from tarn.llm import scans

#: Conversations of one block share the beginning of its first; up to HEADS - 1 turns of it.
BLOCK, HEADS = 20, 4
#: Groups of partial tries that are merged each for itself, and then into one.
GROUPS = (256, 1)
#: A node has many children with this many, or with this share of all nodes: there are few of those.
CHILDREN, SHARE = 1000, 10_000
#: Conversations of an end list in one run.
RUN = 2048

NODE = ["depth", "a", "b"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, a, b, words): each turn's place from 0, the halves of its digest, and its words.

    Turns are in the order of `turn`, null first; equal ones in that of the digest. Texts are read once and not moved.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("long")
    words = F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long")
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", half(1).alias("a"), half(16).alias("b"), words.alias("words"))
    return scans.running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], ["a", "b", "words"])


def head_length():
    return F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS))


def rebuilt(turns: DataFrame, shared_heads: bool = True) -> DataFrame:
    """(conv_id, depth, a, b, words, and the hashes a_upto, b_upto) of every turn of the rebuilt conversations, and their
    root at depth 0. turns: as turns_of() makes them."""
    none = F.lit(0).cast("long")
    convs = turns.where("at = 0").select("conv_id")
    roots = convs.select("conv_id", F.lit(-1).cast("long").alias("place"), none.alias("a"), none.alias("b"), none.alias("words"))
    own = turns.withColumnRenamed("at", "place").select(*roots.columns)
    if shared_heads:
        base = F.col("conv_id") - F.col("conv_id") % BLOCK
        heads = turns.where((F.col("at") < HEADS - 1) & (F.col("conv_id") % BLOCK == 0)).withColumnRenamed("conv_id", "base")
        asked = convs.withColumn("base", base).withColumn("h", head_length()).where("h > 0")
        taken = asked.join(heads, "base").where("at < h").select("conv_id", F.col("at").alias("place"), "a", "b", "words")
        own = own.where(F.col("place") >= head_length()).unionByName(taken)
    return scans.running(own.unionByName(roots), "conv_id", [F.col("place")], ["a", "b", "words"], hashes=["a", "b"]).withColumnRenamed("at", "depth")


def partial_tries(paths: DataFrame) -> DataFrame:
    """(depth, a, b, up_a, up_b, words, conv_id, n, part): the nodes of each batch of rows; conv_id is the least member."""
    columns = ["depth", "a", "b", "up_a", "up_b", "words", "conv_id", "n", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = {c: b[c].to_numpy() for c in b.schema.names}
            order = np.lexsort([col["conv_id"], col["b_upto"], col["a_upto"], col["depth"]])
            key = np.stack([col[c][order] for c in ("depth", "a_upto", "b_upto")])
            first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            at = order[first]
            n = np.diff(np.append(first, len(order)))
            term = [_less(col[f"{c}_upto"][at], col[c][at], col["depth"][at]) for c in "ab"]
            part = int(np.uint64(C.mix(col["a_upto"].view(np.uint64)[:1] + col["conv_id"].view(np.uint64)[:1])[0]) >> np.uint64(44))
            out = [col["depth"][at], col["a_upto"][at], col["b_upto"][at], *term, col["words"][at], col["conv_id"][at], n, np.full(len(at), part)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], columns)

    return paths.select("conv_id", "depth", "a", "b", "words", "a_upto", "b_upto").mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def _less(upto: np.ndarray, x: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The hash of all turns but the last: the parent's."""
    return (upto.view(np.uint64) - C.mix(x.astype(np.int64).view(np.uint64)) * scans.base_power(depth)).view(np.int64)


def merged(tries: DataFrame) -> DataFrame:
    """One trie of many partial ones: those of a group become one, by hash of node and group, then those of the groups."""
    for groups in GROUPS:
        by = [*NODE] if groups == 1 else [*NODE, (F.col("part") % groups).alias("part")]
        same = [F.first(c).alias(c) for c in ("up_a", "up_b", "words")]
        tries = tries.groupBy(*by).agg(*same, F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
    return tries


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id, the least member of the parent. nodes (depth, a, b, up_a, up_b, conv_id, n_children).

    Nodes with many children are joined by broadcast; there are SHARE of them at most.
    """
    many = F.lit(max(CHILDREN, nodes.count() // SHARE))
    up = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = up.where(F.col("n_children") > many).select("depth", "up_a", "up_b", F.col("parent_conv_id").alias("_hot"))
    out = nodes.join(F.broadcast(hot), ["depth", "up_a", "up_b"], "left")
    # children of such a node are dealt by their own hash: they need nothing more
    out = out.withColumn("_a", F.when(F.col("_hot").isNull(), F.col("up_a")).otherwise(F.col("a"))).drop("up_a")
    rest = up.where(F.col("n_children") <= many).withColumnRenamed("up_a", "_a").drop("n_children")
    out = out.join(rest, ["depth", "_a", "up_b"], "left")
    return out.withColumn("parent_conv_id", F.coalesce("_hot", "parent_conv_id")).drop("_hot", "_a", "up_b")


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes at which conversations end. ends (depth, a, b, conv_id).

    Runs of ascending ids are made where the rows are, and the runs of a node are digested one by one, in order.
    """
    rows = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, ids = np.stack([b[c].to_numpy() for c in NODE]), b["conv_id"].to_pylist()
            change = np.flatnonzero((node[:, 1:] != node[:, :-1]).any(0)) + 1
            start = np.unique(np.concatenate([change, np.arange(0, len(ids), RUN)]))
            texts = [",".join(map(str, ids[x:y])) for x, y in zip(start, [*start[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[start]) for x in node), pa.array([ids[x] for x in start], pa.int64()), pa.array(texts, pa.string())], [*NODE, "least", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            out = []
            for *node, text in zip(*(b[c].to_pylist() for c in [*NODE, "ids"])):
                if node != now:
                    out += [(*now, sha.hexdigest())] if now else []
                    now, sha = node, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if out:
                yield _table(out)
        if now:
            yield _table([(*now, sha.hexdigest())])

    lists = rows.mapInArrow(runs, "depth long, a long, b long, least long, ids string")
    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "least").select(*NODE, "ids").mapInArrow(digests, "depth long, a long, b long, ends_sha256 string")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*NODE, "ends_sha256"])


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shared_heads: bool = True) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Null roles and texts are empty. Turns with equal numbers are in the order of the md5 of length of role, colon, role and
    text, repeated rows are turns of their own. Rows with a null conversation belong to none and are left out. An empty table gives
    an empty result. Texts may have any length: only their digests and numbers of words are moved. Other columns aren't
    read, whatever their names. With shared_heads=False conversations are taken as they are, without the rebuilding of heads.
    """
    named = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    turns = turns_of(named)
    paths = C.stored(rebuilt(turns, shared_heads))
    C.dropped(turns)
    nodes = C.stored(merged(partial_tries(paths)))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    whole = C.stored(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    C.dropped(nodes)
    own = whole.select("conv_id", "depth", ((F.col("n") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    # every row of a path with what its node has, where this path is that of the node's least member
    steps = paths.select("conv_id", "depth", F.col("a_upto").alias("a"), F.col("b_upto").alias("b")).join(own, ["conv_id", "depth"], "left").fillna(0, ["saved", "leaves"])
    upward = scans.running(steps, "conv_id", [F.col("depth").desc()], ["depth", "a", "b"], sums=["saved", "leaves"])
    below = upward.where("leaves_upto > 0 or saved_upto > 0").groupBy(*NODE).agg(F.sum("leaves_upto").alias("n_leaves"), F.sum("saved_upto").alias("saved_tokens"))
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", F.col("a_upto").alias("a"), F.col("b_upto").alias("b"))).alias("end"))
    ends = end_digests(last.select("end.*", "conv_id"))
    out = with_parents(whole).join(below, NODE).join(ends, NODE, "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = out.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    out = C.checkpointed(out)
    C.dropped(paths, whole, upward)
    return out


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT *, md5(length(role) || ':' || role || text) AS k FROM t),
o AS (SELECT c, k, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS pos FROM g),
h AS (SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END), CAST(4294967295 AS BIGINT)) % 4 AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT h.c, o.pos, o.k, o.words, 0 AS own FROM h JOIN o ON o.c = h.base AND o.pos < h.h UNION ALL SELECT o.c, o.pos, o.k, o.words, 1 FROM o JOIN h USING (c) WHERE o.pos >= h.h),
s AS (SELECT c, list(k ORDER BY own, pos) AS ks, list(words ORDER BY own, pos) AS ws FROM r GROUP BY c),
whole AS (SELECT h.c, coalesce(ks, []) AS ks, coalesce(ws, []) AS ws FROM h LEFT JOIN s USING (c)),
p AS (SELECT c, d, md5(array_to_string(ks[1:d], ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(ks[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words, d = len(ks) AS ends FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM whole)),
n AS (SELECT d, node, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, node),
kids AS (SELECT d - 1 AS d, up AS node, count(*) AS k FROM n WHERE d > 0 GROUP BY d, up),
m AS (SELECT n.*, coalesce(kids.k, 0) AS n_children FROM n LEFT JOIN kids ON kids.d = n.d AND kids.node = n.node),
b AS (SELECT p.d, p.node, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved FROM p JOIN m ON m.conv_id = p.c AND m.d >= p.d GROUP BY p.d, p.node)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, f.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN b ON b.d = m.d AND b.node = m.node LEFT JOIN m AS f ON f.d = m.d - 1 AND f.node = m.up
"""
