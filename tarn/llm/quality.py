"""Quality rules of documents and of their hosts.

Method. Each document has some counts and three rules: base (few words, or mostly repeated ones), symbols, repeated lines.
The failures of each rule are summed by host (here: the source). A host's rate is shrunk towards the rate of all hosts with
a beta prior that is fitted to the hosts by moments, one for each rule: small hosts stay near the mean, large ones keep
their own rate. A host fails by a rule if its shrunk rate is over the prior's mean by DEVIATIONS of the prior's own
standard deviation, where that is between LEAST_RATE and MOST_RATE: if hosts are much alike, only one whose documents mostly
fail goes, and none does for a rate that others have, too. The verdicts are joined back to the documents. All of it is
DataFrame functions; the join back moves a few numbers a document, and Spark splits the rows of a hot host.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C

#: How far from the prior's mean, in its standard deviations, a shrunk rate fails; the least and the most rate that can.
DEVIATIONS, LEAST_RATE, MOST_RATE = 3.0, 0.3, 0.8
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: A document fails by symbols with more than one for so many words, by lines with more than so many percent repeated.
SYMBOL_WORDS, MOST_DUP_PERCENT = 10, 30
#: Strengths of the prior, in documents: of hosts that couldn't be more unlike, and of hosts that differ by chance alone.
WEAKEST, STRONGEST = 1.0, 1e6
RULES = ("base", "symbols", "lines")
GRAM = 3


def measured(docs: DataFrame) -> DataFrame:
    """docs (id, text, source) with the counts and whether each rule fails: <rule>_failed.

    Repeated windows are found by sorting their 64-bit hashes with their places, n log n for a text of any length.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    df = docs.select(
        "id",
        "source",
        C.words_of(F.col("text")).alias("words"),
        (F.length(text) - F.regexp_count(text, F.lit("[ \\t-\\r]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - GRAM), lambda i: F.xxhash64(*(F.get("words", i + j) for j in range(GRAM))))
    df = df.withColumn("grams", F.when(F.col("n_words") > GRAM, grams).otherwise(F.array().cast("array<long>")))
    placed = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    none = F.array().cast("array<struct<g:long,i:int>>")
    df = df.withColumn("placed", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), placed).otherwise(none))
    twin = F.transform("placed", lambda p, k: F.when((F.get("placed", k - 1)["g"] == p["g"]) | (F.get("placed", k + 1)["g"] == p["g"]), p["i"]))
    df = df.withColumn("at", F.sort_array(F.filter(twin, lambda i: i.isNotNull())))
    covers = F.transform("at", lambda i, k: F.least(F.lit(GRAM), F.coalesce(F.get("at", k + 1) - i, F.lit(GRAM))))
    df = df.withColumn("n_repeat_words", F.aggregate(covers, F.lit(0), lambda a, x: a + x).cast("long"))
    failed = {
        "base": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
        "symbols": SYMBOL_WORDS * F.col("n_symbols") > F.col("n_words"),
        "lines": 100 * F.col("n_dup_lines") > MOST_DUP_PERCENT * F.size("lines"),
    }
    return df.select("id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(c.alias(f"{r}_failed") for r, c in failed.items()))


def host_rates(measures: DataFrame) -> DataFrame:
    """(source, host_docs, host_failed, and for each rule <rule>_rate, <rule>_limit): the rate of each rule's failures by
    host, shrunk by a beta prior fitted by moments, and from what rate on the host fails.

    A prior's mean is the rate of all documents; its strength k makes the variance of host rates, beyond what chance gives
    hosts of these sizes, equal to mean * (1 - mean) / (k + 1). Two sums a rule and two counts reach the driver.
    """
    failures = [F.sum(F.col(f"{r}_failed").cast("long")).alias(f"{r}_n") for r in RULES]
    hosts = C.checkpointed(measures.groupBy("source").agg(F.count("*").alias("host_docs"), *failures))
    n = F.col("host_docs")
    all_ = hosts.agg(F.sum(n).alias("docs"), F.count("*").alias("hosts"), *(F.sum(f"{r}_n").alias(r) for r in RULES)).first()
    docs, means = all_["docs"] or 1, {r: (all_[r] or 0) / (all_["docs"] or 1) for r in RULES}
    spreads = hosts.agg(*(F.sum(n * F.pow(F.col(f"{r}_n") / n - means[r], F.lit(2.0))).alias(r) for r in RULES)).first()

    def rated(r: str) -> list[Column]:
        mean, even = means[r], means[r] * (1 - means[r])
        between = (spreads[r] or 0.0) / docs - even * all_["hosts"] / docs
        k = min(max(even / between - 1, WEAKEST), STRONGEST) if between > 0 else STRONGEST
        limit = min(max(mean + DEVIATIONS * math.sqrt(even / (k + 1)), LEAST_RATE), MOST_RATE)
        return [((F.col(f"{r}_n") + mean * k) / (n + k)).alias(f"{r}_rate"), F.lit(limit).alias(f"{r}_limit")]

    return hosts.select("source", "host_docs", F.col("base_n").alias("host_failed"), *(c for r in RULES for c in rated(r)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_failed_by) for every row.

    host_failed_by names the rules by which the document's host fails, joined by commas; kept is true if there are none and
    the base rule holds. Null and empty texts have no words and fail. Rows with a null source are one host, null ids and
    repeated rows are rows of their own. An empty table gives an empty result. Other columns aren't read, whatever their
    names.
    """
    measures = C.checkpointed(measured(C.inputs(docs, id=id_col, text=text_col, source=source_col)))
    by = F.concat_ws(",", *(F.when(F.col(f"{r}_rate") >= F.col(f"{r}_limit"), F.lit(r)) for r in RULES))
    hosts = host_rates(measures).select(F.col("source").alias("host"), by.alias("host_failed_by"))
    out = measures.join(hosts, measures["source"].eqNullSafe(F.col("host")))
    kept = ~F.col("base_failed") & (F.col("host_failed_by") == "")
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_failed_by")


def op6_host_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).drop("host_failed_by").withColumnRenamed("id", "doc_id")


OP6_SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(0, 3) AS r(o) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS all_, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, coalesce(lines.all_, 0) AS n_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
r AS (SELECT doc_id, source, unnest(['base', 'symbols', 'lines']) AS rule, unnest([base_failed, 10 * n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines]) AS failed FROM b),
h AS (SELECT source, rule, count(*) AS n, sum(failed::INT) AS f FROM r GROUP BY source, rule),
p AS (SELECT rule, sum(f) / sum(n) AS mean, sum(n) AS docs, count(*) AS hosts FROM h GROUP BY rule),
v AS (SELECT rule, mean, sum(n * (f / n - mean) ** 2) / any_value(docs) - mean * (1 - mean) * any_value(hosts) / any_value(docs) AS between_ FROM h JOIN p USING (rule) GROUP BY rule, mean),
k AS (SELECT rule, mean, CASE WHEN between_ > 0 THEN least(greatest(mean * (1 - mean) / between_ - 1, 1), 1e6) ELSE 1e6 END AS k FROM v),
bad AS (SELECT source, bool_or((f + mean * k) / (n + k) >= least(greatest(mean + 3 * sqrt(mean * (1 - mean) / (k + 1)), 0.3), 0.8)) AS fails FROM h JOIN k USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT fails AS kept
FROM b JOIN bad ON b.source IS NOT DISTINCT FROM bad.source
"""
