"""Mixing sources to target weights, by fixed-length blocks of words that are drawn into output shards.

Method. The words of a source, its documents in a hashed order, are one stream, cut into blocks of BLOCK words. Every
output shard of SHARD_SLOTS slots draws the source of each slot, so its counts by source are multinomial. A source has as
many slots in all as its target asks for: the draws of all its shards are scaled by what it should have over what it drew,
some thousandths more or less in every shard alike, and rounded so that the sum is right. The k-th slot of a source reads
block perm(k), where perm is a pseudorandom permutation of the source's blocks (swap-or-not, a bijection for any number of
blocks), another one for each pass over the source. Blocks are joined with documents by their index. All of it is
DataFrame functions.

Skew. A source may hold a third of all rows: it has as many hashed chunks as its documents need, its stream is numbered
by running sums over chunks and chunks of chunks, and all joins are on (source, block). Only tables with a row for each
source are handled in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import common as C

BLOCK = 64
SHARD_SLOTS = 4096
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents in a chunk of a source's stream, shards in a chunk of the draws, chunks that are summed up in one task.
CHUNK_DOCS, CHUNK_SHARDS, CHUNKS = 250, 10_000, 10_000
#: Slots that a task makes from the counts of sources and shards.
TASK_SLOTS = 50_000
ROUNDS = 10


def running(df: DataFrame, key: str, chunk: str, order: list[str], value: str, out: str, chunks: int) -> DataFrame:
    """out: the sum of value over the rows of a key before this one, by chunk (0 to before `chunks`) and then order. No
    task sees more than a chunk of a key, or CHUNKS sums of chunks."""
    sums = df.groupBy(key, chunk).agg(F.sum(value).alias("_sum"))
    if chunks > CHUNKS:
        upper = sums.withColumn(f"{chunk}_", F.floor(F.col(chunk) / CHUNKS))
        base = running(upper, key, f"{chunk}_", [chunk], "_sum", "_before", chunks // CHUNKS + 1).select(key, chunk, F.col("_before").alias("_base"))
    else:
        upto = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
        base = sums.select(key, chunk, F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(base, [key, chunk]).withColumn(out, F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(rank, source, docs, source_size, target): weights repeat over the sources by code point, null last; targets share
    `share` of all sizes by weight, but stop at `most` times the source's size, and what is over is reshared.

    With sources in the order of most * size / weight, the level at which the rest is shared is that of the first
    source which stays below its own limit.
    """
    by_source = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    name = Window.orderBy(F.col("source").isNull(), "source")  # one row for each source
    cycle = F.array(*(F.lit(w) for w in weights))
    ranked = by_source.withColumn("rank", F.row_number().over(name)).withColumn("weight", F.get(cycle, (F.col("rank") - 1) % len(weights)))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    rest = ranked.withColumn("limit", most * F.col("source_size")).select(
        "*",
        F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
        (share * F.sum("source_size").over(Window.partitionBy())).alias("budget"),
    )
    ratio, even = F.col("limit") / F.col("weight"), (F.col("budget") - F.col("full")) / F.col("open")
    first = F.min(F.when(ratio >= even, F.struct(ratio.alias("ratio"), F.col("rank"), even.alias("level")))).over(Window.partitionBy())
    level = F.coalesce(first["level"], F.max(ratio).over(Window.partitionBy()))
    return rest.select("rank", "source", "docs", "source_size", F.least(F.col("limit"), level * F.col("weight")).alias("target"))


def permuted(x: str, n: str, key: Column) -> Column:
    """Where x goes in a pseudorandom permutation of 0..n-1 that depends on key (swap-or-not, ROUNDS rounds).

    A round pairs every number with its mirror about a keyed point; a bit keyed by the greater of the two decides for
    both whether they swap, so every round is a bijection for any n.
    """

    def step(at: Column, i: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, i), F.col(n)) - at, F.col(n))
        return F.when(F.pmod(F.xxhash64(key, i, F.greatest(at, mirror)), F.lit(2)) == 1, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.col(x), step)


def draw(sources: DataFrame, seed: int, block: int) -> DataFrame:
    """(rank, shard, k, blocks): the slots of every source, k from 0 within the source; a slot's shard was drawn."""
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    want = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("long")
    wanted = sources.withColumn("blocks", blocks).withColumn("slots", want).where("slots > 0").select("rank", "blocks", "slots")
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # one row for each source
    wanted = C.checkpointed(wanted.withColumn("low", F.coalesce(F.sum("slots").over(before), F.lit(0))))
    total, n_sources = wanted.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    if not total:
        return wanted.select("rank", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("k"), "blocks").where("false")
    spark, cells = sources.sparkSession, max(1024, n_sources)
    per = -(-total // cells)
    owners = wanted.select("rank", "low", (F.col("low") + F.col("slots")).alias("high"), F.explode(F.sequence(F.floor(F.col("low") / per), F.floor((F.col("low") + F.col("slots") - 1) / per))).alias("cell"))
    drawn = spark.range(total).select((F.floor(F.col("id") / SHARD_SLOTS)).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(total)).alias("u")).withColumn("cell", F.floor(F.col("u") / per))
    counts = drawn.join(owners, "cell").where("u >= low and u < high").groupBy("rank", "shard").agg(F.count("*").alias("n"))
    counts = C.checkpointed(counts.withColumn("chunk", F.floor(F.col("shard") / CHUNK_SHARDS)))
    shards = -(-total // SHARD_SLOTS)
    placed = running(counts, "rank", "chunk", ["shard"], "n", "d0", shards // CHUNK_SHARDS + 1).join(counts.groupBy("rank").agg(F.sum("n").alias("got")), "rank").join(wanted.select("rank", "blocks", "slots"), "rank")
    exact = lambda d: F.expr(f"cast(({d}) * cast(slots as decimal(19,0)) div got as bigint)")
    scaled = placed.select("rank", "shard", "blocks", exact("cast(d0 as decimal(19,0))").alias("k0"), exact("cast(d0 + n as decimal(19,0))").alias("k1"))
    # a source that drew nothing has few slots: they share a shard
    none = wanted.join(counts.select("rank").distinct(), "rank", "left_anti").select("rank", F.pmod(F.xxhash64(F.lit(seed), "rank"), F.lit(shards)).alias("shard"), "blocks", F.lit(0).cast("long").alias("k0"), F.col("slots").alias("k1"))
    dealt = scaled.unionByName(none).where("k0 < k1").repartition(max(1, -(-total // TASK_SLOTS)))
    return dealt.select("rank", "shard", F.explode(F.sequence(F.col("k0"), F.col("k1") - 1)).alias("k"), "blocks")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 17, block: int = BLOCK) -> dict[str, DataFrame]:
    """Mix documents so that sources come in by weight. Returns "documents" (id, size, source_size, target, taken) with a
    row for every input row, and "parts" (row, id, shard, pass, first, n): which words of which document a shard takes.

    A size is the number of words, 0 for null and empty texts, which are never taken. A null source is a source of its
    own, last in order. Null ids are kept. No word is taken more than `most` times. Repeated rows are separate documents. Equal inputs
    give equal results, whatever their partitioning. An empty table gives empty results. Other columns aren't read.
    """
    rows = C.inputs(docs, id=id_col, text=text_col, source=source_col).select("id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long").alias("size"))
    sized = C.checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    sources = C.checkpointed(targets(sized, weights, share, float(most)))
    named = sized.join(sources.select("rank", "source", "docs"), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    named = named.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "id"), F.expr(f"docs div {CHUNK_DOCS} + 1"))).drop("docs")
    chunks = (sources.agg(F.max("docs")).first()[0] or 0) // CHUNK_DOCS + 1
    stream = running(named.where("size > 0"), "rank", "chunk", ["id", "size"], "size", "start", chunks)
    cover = stream.select("rank", "row", "id", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("index"))
    cover = cover.select("rank", "index", "row", "id", F.greatest(F.lit(0), F.col("index") * block - F.col("start")).alias("first"), F.least(F.col("size"), (F.col("index") + 1) * block - F.col("start")).alias("end"))
    slots = draw(sources, seed, block).withColumn("pass", F.floor(F.col("k") / F.col("blocks"))).withColumn("x", F.col("k") % F.col("blocks"))
    slots = slots.withColumn("key", F.xxhash64(F.lit(seed), "rank", "pass"))
    slots = slots.select("rank", permuted("x", "blocks", F.col("key")).alias("index"), "pass", "shard")
    # Spark takes the slots for as small as the counts they are made of, and would broadcast them
    parts = C.checkpointed(cover.join(slots.hint("merge"), ["rank", "index"]).select("row", "id", "shard", "pass", "first", (F.col("end") - F.col("first")).alias("n")))
    taken = parts.groupBy("row").agg(F.sum("n").alias("taken"))
    out = sized.join(taken, "row", "left").join(sources, sized["source"].eqNullSafe(sources["source"]))
    out = out.select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return {"documents": out, "parts": parts, "rows": sized}


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents (doc_id, text, lang, source, n_chars) as the mix takes them: one row for each pass that takes words of
    a document, its text the words taken, in order, joined by one space; a document taken whole keeps its text.

    Rows with equal ids must have equal texts: they are one document here. Rows without words, or with a null id, are not
    taken. Nulls in lang and source stay. An empty table gives an empty result.
    """
    keyed = docs.select("doc_id", "text", "lang", "source")
    parts = mix(keyed, **options)["parts"].groupBy("id", "row", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("parts"), F.sum("n").alias("n"))
    best = parts.groupBy("id", "pass").agg(F.min_by("parts", "row").alias("parts"), F.min_by("n", "row").alias("n"))
    words = C.words_of(F.col("text"))
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice("words", p["first"].cast("int") + 1, p["n"].cast("int")))), " ")
    joined = keyed.dropDuplicates(["doc_id"]).join(best, F.col("doc_id") == F.col("id")).withColumn("words", words)
    text = F.when(F.size("words") == F.col("n"), F.col("text")).otherwise(cut)
    return joined.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars")


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs)["documents"].withColumnRenamed("id", "doc_id")
