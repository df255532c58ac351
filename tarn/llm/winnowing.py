"""Document fingerprints by winnowing, and how far they survive an edit.

Method. Every word has a 64-bit hash, and every run of GRAM words one of its words' hashes; of every WINDOW consecutive runs
the one with the least start of its hash is chosen, the rightmost of equal ones, and its whole hash kept with its place. A run
of GRAM + WINDOW - 1 equal words in two texts gives both a common fingerprint. The least of all windows comes from the least of
pairs, fours and so on, each by one pass over the array before: about log2(WINDOW) comparisons a word. Texts of fewer than FEW
words keep the hashes of all their runs of words; those that have fewer than one window's words, as texts without white space,
have those of their runs of characters as well, of which only the chosen are kept when there are LONG characters or more. An
edited text, and the next document, are fingerprinted in the way of the text that they are compared with. All of it is
DataFrame functions; hashes are of words, because characters would take the same steps six times over and SQL has no
constant-time access to the characters of a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import common as C

GRAM, WINDOW = 5, 24
#: Words from which a text is winnowed, and below which it has runs of characters; characters of a run, and from which those are winnowed.
FEW, SPARSE, CHARS, LONG = 112, GRAM + WINDOW - 1, 3, 4096
WORDS, ALL_WORDS, ALL, CHARACTERS = 0, 1, 2, 3
#: Low bits of what runs are ordered by, which hold the place, counted down so that the least is the rightmost; above them
#: are the first bits of the hash. More places than that don't fit into one value of a table.
PLACE_BITS = 30
PLACES = (1 << PLACE_BITS) - 1
#: Stands for a null id where documents follow one another.
NO_ID = -(1 << 63)


def _least_with(step: int):
    return lambda v, i: F.least(v, F.get("_m", i + step))


def manner(words: Column, text: Column) -> Column:
    """How a text is fingerprinted."""
    n = F.size(words)
    return F.when(n >= FEW, WORDS).when(n >= SPARSE, ALL_WORDS).when(F.length(text) < LONG, ALL).otherwise(CHARACTERS)


def with_fingerprint(df: DataFrame, text: Column, out: str, gram: int = GRAM, window: int = WINDOW, how: Column | None = None, places: bool = True) -> DataFrame:
    """df with out and <out>_at: the chosen hashes of the text in order of place, and their places, in arrays of their own
    (pairs would take three times the room).

    A text is fingerprinted in the manner how, its own by default; without places there is no order either. A text of fewer words or characters than a run has
    one hash of all of them, without words none; with fewer hashes than a window holds, all are kept. Places of runs of
    characters are those of their first character, the words of the text joined by one space.
    """
    df = df.withColumn("_w", C.words_of(text)).withColumn("_how", manner(C.words_of(text), F.coalesce(text, F.lit(""))) if how is None else how)
    df = df.withColumn("_c", F.when(F.col("_how") >= ALL, F.filter(F.split(F.array_join("_w", " "), ""), lambda c: c != "")))
    df = df.withColumn("_w", F.transform("_w", lambda w: F.xxhash64(w)))

    def runs(units: str, k: int) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(units) - k), lambda i: F.xxhash64(*(F.get(units, i + j) for j in range(k))))
        few = F.when(F.size(units) > 0, F.array(F.xxhash64(units))).otherwise(F.array().cast("array<long>"))
        return F.when(F.size(units) >= k, grams).otherwise(few)

    placed = lambda hashes: F.transform(hashes, lambda h, i: F.struct(i.alias("place"), h.alias("hash")))
    both = F.concat(placed(runs("_w", gram)), placed(runs("_c", CHARS)))
    if places:
        both = F.array_sort(both, lambda a, b: a["place"] - b["place"])
    df = df.withColumn("_h", F.when(F.col("_how") == CHARACTERS, runs("_c", CHARS)).otherwise(runs("_w", gram)))
    whole = F.when(F.col("_how") == ALL, both).when((F.col("_how") == ALL_WORDS) | (F.size("_h") < window), placed(F.col("_h")))
    df = df.withColumn("_short", whole)
    df = df.withColumn("_m", F.when(F.col("_short").isNull(), F.transform("_h", lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS + 1), PLACE_BITS) + F.lit(PLACES) - i)))
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        df = df.withColumn("_m", F.transform(F.slice("_m", 1, F.size("_m") - step), _least_with(step)))
        reach += step
    df = df.withColumn("_at", F.transform(F.array_distinct("_m"), lambda v: (F.lit(PLACES) - v.bitwiseAND(F.lit(PLACES))).cast("int")))
    hashes_ = F.coalesce(F.transform("_short", lambda v: v["hash"]), F.transform("_at", lambda i: F.get("_h", i)))
    if places:
        df = df.withColumn(f"{out}_at", F.coalesce(F.transform("_short", lambda v: v["place"]), F.col("_at")))
    return df.withColumn(out, hashes_).drop("_w", "_c", "_how", "_h", "_m", "_short", "_at")


def shown(name: str) -> Column:
    """A fingerprint as text: place:hash, in order of place."""
    return F.array_join(F.zip_with(f"{name}_at", name, lambda i, h: F.concat(i.cast("string"), F.lit(":"), F.lower(F.hex(h)))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two columns with distinct hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def followers(ids: DataFrame) -> DataFrame:
    """ids (id, n, hows) with next_id and next_hows, those of the next greater id; the first follows the last.

    Ids are dealt out by range; each range links its own, and one row a range links the ranges.
    """
    ranged = C.checkpointed(ids.repartitionByRange("id").withColumn("chunk", F.spark_partition_id()))
    ends = ranged.groupBy("chunk").agg(F.min(F.struct("id", "hows")).alias("first"))
    over = Window.orderBy("chunk")  # one row a range
    ends = ends.select("chunk", F.coalesce(F.lead("first").over(over), F.min("first").over(Window.partitionBy())).alias("beyond"))
    inner = F.lead(F.struct("id", "hows")).over(Window.partitionBy("chunk").orderBy("id"))
    linked = ranged.withColumn("inner", inner).join(ends, "chunk").withColumn("next", F.coalesce("inner", "beyond"))
    return linked.select("id", "n", "hows", F.col("next.id").alias("next_id"), F.col("next.hows").alias("next_hows"))


def compared(hashes: Column | str) -> Column:
    """The distinct hashes by their last 32 bits, which is what two fingerprints are compared by: half the room where they move."""
    return F.array_sort(F.array_distinct(F.transform(hashes, lambda h: F.shiftright(F.shiftleft(h, 32), 32).cast("int"))))


def next_hashes(links: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, how, following): what the document after id is compared by, in each manner how that rows of id have.

    A document's row in kept (id, how, own, asked, other) has its fingerprint in its own manner, and in the manner asked if the
    document before is of another.
    """
    after = kept.withColumn("way", F.explode(F.array_compact(F.array(F.struct(F.col("how").alias("how"), F.col("own").alias("h")), F.when(F.col("asked").isNotNull(), F.struct(F.col("asked").alias("how"), F.col("other").alias("h")))))))
    after = after.select(F.col("id").alias("next_id"), "way.how", "way.h").join(links.select("next_id", "id", "hows"), "next_id").where("array_contains(hows, how)")
    return after.groupBy("id", "how").agg(F.min("h").alias("following"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, values, hashes): the chosen (place, hash) of every text, and the distinct hashes, a row for each row.

    Null and empty texts have none. Null ids are kept; other columns aren't read. An empty table gives an empty result.
    """
    docs = C.inputs(docs, id=id_col, text=text_col)
    pair = F.zip_with("h_at", "h", lambda i, h: F.struct(i.alias("place"), h.alias("hash")))
    return with_fingerprint(docs, F.col("text"), "h").select("id", pair.alias("values"), F.array_distinct("h").alias("hashes"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, whose last quarter is the start of the next document.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Null counts as empty;
    a single document follows itself. Of rows with equal ids each has its row, and the next document's text is the least of
    them (near_next: the least of their fingerprints). The next document is compared as fingerprinted in the text's manner. A null id comes before all others and stays null; the least long is
    not told from it. An empty table gives an empty result. Other columns aren't read, whatever their names.
    """
    docs = C.inputs(docs, id=id_col, text=text_col).select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("how", manner(C.words_of(F.col("text")), F.col("text")))
    ids = docs.select("id", "how", F.length("text").cast("long").alias("n")).groupBy("id").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("how")).alias("hows"))
    links = C.checkpointed(followers(ids))
    heads = C.join_ids(docs, links.select(F.col("next_id").alias("id"), F.col("id").alias("of"), F.floor(F.col("n") / 4).cast("int").alias("cut")), "id")
    heads = heads.select("of", F.expr("substring(text, 1, cut)").alias("head")).groupBy(F.col("of").alias("id")).agg(F.min("head").alias("head"))
    n, cut = F.length("text"), F.floor(F.length("text") / 4)
    edited = docs.join(heads, "id").select("id", "text", "how", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring("head", F.lit(1), cut.cast("int"))).alias("edited"))
    # the manners of the document before that this one isn't known in yet: a row for each, of which the first has the rest as well
    asked = links.select(F.col("next_id").alias("id"), F.filter("hows", lambda h: F.col("next_hows") != F.array(h)).alias("asked"))
    edited = edited.join(asked, "id").select("*", F.posexplode_outer("asked").alias("pos", "other_how")).withColumn("first", F.coalesce("pos", F.lit(0)) == 0)
    only = lambda c: F.when(F.col("first"), F.col(c))
    marked = with_fingerprint(with_fingerprint(edited, only("text"), "own", how=F.col("how")), only("edited"), "changed", how=F.col("how"))
    marked = with_fingerprint(marked, F.when(F.col("other_how").isNotNull(), F.col("text")), "other", how=F.coalesce("other_how", F.lit(WORDS)), places=False)
    sha = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    kept = C.stored(marked.select("id", "how", "first", "n_chars", sha, "own", "own_at", "changed", "changed_at", F.col("other_how").alias("asked"), compared("other").alias("other")))
    own = F.when(F.col("first"), compared("own"))
    following = next_hashes(links, kept.select("id", F.when(F.col("first"), F.col("how")).alias("how"), own.alias("own"), "asked", "other"))
    out = kept.where("first").join(following, ["id", "how"]).select("*", compared("own").alias("a"), compared("changed").alias("b"), F.col("following").alias("c"))
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("id"), "n_chars", "edited_sha256", shown("own").alias("fingerprint"), shown("changed").alias("edited_fingerprint"), likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"))


def op4_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return edit_likeness(docs).withColumnRenamed("id", "doc_id")
