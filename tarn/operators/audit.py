"""Evidence of test questions: how far questions, answers and facts are held by the text they cite, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators.retrieval import small

#: Least idf, least letters of a key that may match inside a word, weights of the score.
LEAST_IDF, INSIDE = 0.05, 5
FACTS, ANSWER, NUMBERS, SEVERAL, LENGTH, STRONG = 0.47, 0.15, 0.12, 0.10, 0.08, 0.08
LEXICAL = 0.70


def key_idf(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((key, df, idf) of all keys of a corpus, (n) its rows). Keys are made distinct in the row: one shuffle of (key, count)."""
    df = docs.select(F.explode(F.array_distinct(T.keys(F.array_distinct(T.content_tokens(F.col(text)))))).alias("key")).groupBy("key").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n"))
    idf = df.join(F.broadcast(total)).select("key", "df", F.greatest(F.log(F.col("n") / (1 + F.col("df"))) + 1, F.lit(LEAST_IDF)).alias("idf"))
    return idf, total


def parts(cases: DataFrame) -> DataFrame:
    """cases (id, question, answer, facts, gold) as rows (id, kind, n, text, gold, gold_low, gold_keys): kind q, a or f."""
    one = lambda kind, n, text: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"), text.alias("text"))
    all_ = F.concat(F.array(one("q", F.lit(0), F.col("question")), one("a", F.lit(0), F.col("answer"))), F.transform("facts", lambda f, i: one("f", i, f)))
    gold = F.coalesce("gold", F.lit(""))
    rows = cases.select("id", gold.alias("gold"), F.lower(gold).alias("gold_low"), F.array_distinct(T.keys(T.content_tokens(gold))).alias("gold_keys"), F.explode(all_).alias("p"))
    return rows.select("id", "p.*", "gold", "gold_low", "gold_keys")


def term_rows(rows: DataFrame, idf: DataFrame, total: DataFrame) -> DataFrame:
    """A row for each token of parts: (id, kind, n, at, token, w, held, exact, stemmed); the gold text stays where it is."""
    tokens = T.content_tokens(F.col("text"))
    zipped = F.zip_with(tokens, T.keys(tokens), lambda t, k: F.struct(t.alias("token"), k.alias("key")))
    marked = F.transform(zipped, lambda z, i: F.struct(i.alias("at"), z["token"].alias("token"), z["key"].alias("key"), F.contains(F.col("gold_low"), z["token"]).alias("exact"), F.array_contains(F.col("gold_keys"), z["key"]).alias("stemmed"), ((F.length(z["key"]) >= INSIDE) & F.contains(F.col("gold_low"), z["key"])).alias("inside")))
    terms = rows.select("id", "kind", "n", F.explode(marked).alias("m")).select("id", "kind", "n", "m.*")
    unseen = total.select(F.greatest(F.log("n") + 1, F.lit(LEAST_IDF)).alias("unseen"))
    joined = terms.join(small(idf.select("key", "idf")), "key", "left").join(F.broadcast(unseen))
    return joined.select("id", "kind", "n", "at", "token", F.coalesce("idf", "unseen").alias("w"), (F.col("stemmed") | F.col("inside")).alias("held"), "exact", "stemmed")


def coverage(terms: DataFrame) -> DataFrame:
    """(id, kind, n, coverage): the part of the tokens' idf that the gold text holds; tokens count as often as they occur."""
    held = F.sum(F.when(F.col("held"), F.col("w")).otherwise(0.0))
    return terms.groupBy("id", "kind", "n").agg(F.round(held / F.sum("w"), 6).alias("coverage"))


def _distinct(terms: DataFrame) -> DataFrame:
    return terms.groupBy("id", "kind", "n", "token").agg(F.min("at").alias("at"), F.first("w").alias("w"), F.first("exact").alias("exact"), F.first("stemmed").alias("stemmed"))


def lexical_overlap(terms: DataFrame) -> DataFrame:
    """(id, terms, overlap) of questions: of their 4 to 8 rarest distinct tokens, 1 for each that the gold text holds as it
    is and 0.6 for each whose key it holds."""
    by = Window.partitionBy("id")
    words = _distinct(terms.where("kind = 'q'")).withColumn("r", F.row_number().over(by.orderBy(F.desc("w"), "at"))).withColumn("of", F.count("*").over(by))
    hit = F.when(F.col("exact"), 1.0).when(F.col("stemmed"), 0.6).otherwise(0.0)
    return words.where("r <= greatest(4, least(8, of div 2 + 2))").groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum(hit) / F.count("*"), 6).alias("overlap"))


def anchor_support(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, kind, n, support): the part of a part's anchors that the gold text holds: addresses, numbers and names, else its
    eight rarest words. Of an English gold text only anchors with a digit or @ count, and none is full support."""
    held = lambda a: F.contains(F.col("gold_low"), F.lower(a)) | F.array_contains(F.col("gold_keys"), F.get(T.keys(F.array(F.lower(a))), F.lit(0)))
    english = T.is_english(F.col("gold"))
    hard = rows.select("id", "kind", "n", "gold_low", "gold_keys", english.alias("english"), T.hard_anchors(F.col("text")).alias("all")).withColumn("a", F.when(F.col("english"), F.filter("all", lambda a: a.rlike("[0-9@]"))).otherwise(F.col("all")))
    by = Window.partitionBy("id", "kind", "n").orderBy(F.desc("w"), "at")
    rare = _distinct(terms.where(~F.col("token").rlike("^[0-9]+$"))).withColumn("r", F.row_number().over(by)).where("r <= 8")
    rare = rare.groupBy("id", "kind", "n").agg((F.sum((F.col("exact") | F.col("stemmed")).cast("int")) / F.count("*")).alias("rare"))
    share = F.size(F.filter("a", held)) / F.size("a")
    shares = hard.select("id", "kind", "n", "english", F.size("all").alias("size"), F.when(F.size("a") > 0, share).alias("share"))
    support = F.when(F.col("share").isNotNull(), F.col("share")).when(F.col("english"), 1.0).when(F.col("size") == 0, F.coalesce("rare", F.lit(0.0))).otherwise(0.0)
    return shares.join(rare, ["id", "kind", "n"], "left").select("id", "kind", "n", F.round(support, 6).alias("support"))


def evidence(cases: DataFrame, idf: DataFrame, total: DataFrame) -> DataFrame:
    """Features of cases (id, question, answer, facts, gold, n_gold, missing): see the columns of the last select."""
    rows = parts(cases)
    terms = term_rows(rows, idf, total)
    each = rows.select("id", "kind", "n").join(coverage(terms), ["id", "kind", "n"], "left").join(anchor_support(rows, terms), ["id", "kind", "n"])
    fact = F.when(F.col("kind") == "f", F.greatest(F.coalesce("coverage", F.lit(0.0)), F.col("support")))
    answer = lambda c: F.coalesce(F.max(F.when(F.col("kind") == "a", F.col(c))), F.lit(0.0))
    sums = each.withColumn("fact", fact).groupBy("id").agg(
        F.round(F.coalesce(F.avg("fact"), F.lit(0.0)), 6).alias("fact_mean"), F.coalesce(F.min("fact"), F.lit(0.0)).alias("fact_min"), F.sum((F.coalesce("fact", F.lit(1.0)) < 0.45).cast("long")).alias("n_weak"), answer("coverage").alias("ans_cov"), answer("support").alias("ans_anchor")
    )
    english = T.is_english(F.col("gold"))
    n = lambda c: F.size(T.content_tokens(F.col(c))).cast("long")
    own = cases.select(
        "id", "n_gold", "missing", F.size("facts").cast("long").alias("n_facts"), english.alias("english"), F.round(F.when(english, 1.0).otherwise(T.number_support(F.col("answer"), F.col("gold"))), 6).alias("ans_numbers"), F.round(T.boilerplate(F.col("gold")), 3).alias("boilerplate"),
        F.col("question").rlike(T.CONTEXT_REFERENCE).alias("context_ref"), F.col("question").rlike(T.SELF_CITING).alias("self_cite"), (F.col("answer").rlike(T.METADATA_ONLY) & ~F.contains(F.lower(F.coalesce("gold", F.lit(""))), F.lit("tidak berlaku"))).alias("metadata_only"), n("question").alias("q_len"), n("answer").alias("ans_len"),
    )
    return own.join(sums, "id").join(lexical_overlap(terms).select("id", F.round("overlap", 3).alias("lex_overlap")), "id", "left").withColumn("lex_overlap", F.coalesce("lex_overlap", F.lit(0.0)))


def scored(e: DataFrame) -> DataFrame:
    """evidence() with score, flags (in order, joined by commas) and tier."""
    c = F.col
    strong = F.greatest("ans_anchor", "ans_cov")
    s = (
        FACTS * F.least(c("fact_mean") / 0.85, F.lit(1.0))
        + ANSWER * F.least(strong / 0.85, F.lit(1.0))
        + NUMBERS * c("ans_numbers")
        + SEVERAL * F.when(c("n_facts") >= 2, 1.0).when(c("n_facts") == 1, 0.4).otherwise(0.0)
        + LENGTH * F.least(c("q_len") / 12.0, F.lit(1.0))
        + STRONG * (1.0 - F.least(c("n_weak") / 3.0, F.lit(1.0)))
    )
    flags: list[tuple[str, Column]] = [
        ("gold_missing", c("missing") > 0),
        ("no_gold", c("n_gold") == 0),
        ("facts_ungrounded", c("fact_mean") < 0.45),
        ("facts_weak", (c("fact_mean") >= 0.45) & (c("fact_mean") < 0.60)),
        ("multi_weak_facts", c("n_weak") >= 2),
        ("answer_ungrounded", (c("ans_anchor") < 0.55) & (c("ans_cov") < 0.45) & (c("fact_mean") < 0.80)),
        ("answer_partly_supported", ~((c("ans_anchor") < 0.55) & (c("ans_cov") < 0.45) & (c("fact_mean") < 0.80)) & (c("ans_anchor") < 0.65) & (c("fact_mean") < 0.90)),
        ("english_gold", c("english")),
        ("boilerplate_gold", c("boilerplate") >= 0.45),
        ("metadata_only_answer", c("metadata_only")),
        ("context_reference", c("context_ref")),
        ("self_citing", c("self_cite")),
        ("unsupported_numbers", c("ans_numbers") < 1.0),
        ("no_facts", c("n_facts") == 0),
        ("question_too_short", c("q_len") < 4),
        ("answer_too_short", c("ans_len") < 4),
    ]
    out = e.withColumn("score", F.round(F.when((c("missing") > 0) | (c("n_gold") == 0), 0.2 * s).otherwise(s), 4)).withColumn("f", F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in flags))))
    some = lambda *names: F.arrays_overlap("f", F.array(*map(F.lit, names)))
    bad = some("facts_ungrounded", "answer_ungrounded", "multi_weak_facts", "boilerplate_gold", "metadata_only_answer", "context_reference")
    blocking = F.size(F.array_remove("f", "self_citing")) > 0
    tier = F.when(some("gold_missing", "no_gold", "no_facts"), "unusable").when(bad, "problematic").when((c("score") >= 0.88) & ~blocking, "high").when(c("score") >= 0.72, "acceptable").otherwise("problematic")
    return out.withColumn("tier", tier).withColumn("flags", F.array_join("f", ",")).drop("f")


def reclassified(e: DataFrame) -> DataFrame:
    """evidence() and labels (route, scope, label) as (id, qtype): complex by scope, else by the overlap of words."""
    c = F.col
    plain = F.when(c("lex_overlap") >= LEXICAL, "lexical").otherwise("semantic")
    several = (c("n_gold") >= 2) | (c("route") == "both") | c("scope").isin("multi", "cross_store")
    deep = c("label").isin("analytical", "multi_chunk", "cross_store", "negation_edge") & (c("n_facts") >= 3)
    return e.select("id", F.when(several | deep, "complex").otherwise(plain).alias("qtype"))
