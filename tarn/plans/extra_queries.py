"""Flags, summaries, plans and caches that complete the inventory."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.plans.analytics_queries import _n
from tarn.operators import quantiles
from tarn.plans.registry import documents, query, table


@query("SELECT doc_id, len(ts) >= 20 AND len(list_filter(ts, lambda t: length(t) = 1)) / greatest(len(ts), 1) > 0.5 AS spaced FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS ts FROM documents)")
def charspaced_flag(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.is_charspaced(F.col("text")).alias("spaced"))


@query("""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda s: CASE WHEN len(list_filter(string_split(s, ' '), lambda t: t <> '')) >= 4
AND len(list_filter(string_split(s, ' '), lambda t: length(t) = 1)) / len(list_filter(string_split(s, ' '), lambda t: t <> '')) > 0.6
THEN array_to_string(list_filter(list_transform(regexp_split_to_array(s, '  +'), lambda w: replace(w, ' ', '')), lambda w: w <> ''), ' ') ELSE s END), chr(10)) AS despaced FROM documents""")
def despace_lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.despaced_lines(F.col("text")).alias("despaced"))


@query("SELECT event_type, count(*) AS n, round(avg(k), 6) AS mean, round(quantile_cont(k, 0.95), 6) AS p95, count(*) FILTER (k = 0) AS zeros FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def count_summary(spark, sf_dir):
    """Like a latency summary, but zeros count."""
    rows = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    stats = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("mean"), _n(F.col("k") == 0).alias("zeros"))
    p95 = quantiles.percentiles(rows, ["event_type"], "k", {"p95": 0.95}).select("event_type", F.round("p95", 6).alias("p95"))
    return stats.join(p95, "event_type", "left").select("event_type", "n", "mean", "p95", "zeros")


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN value END), 4) AS click, round(sum(CASE WHEN event_type = 'view' THEN value END), 4) AS view, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def latency_table(spark, sf_dir):
    """Stages as columns for each query."""
    of = lambda k: F.round(F.sum(F.when(F.col("event_type") == k, F.col("value"))), 4).alias(k)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(of("click"), of("view"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT conv_id, turn, CASE WHEN n <= 1 OR role <> 'user' THEN text ELSE 'Follow-up after ' || (n - 1) || ': ' || regexp_replace(text, '^[\"'']+|[\"'']+$', '', 'g') END AS rewritten FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)")
def followup_rewrite(spark, sf_dir):
    """A follow-up is rewritten by a fixed frame and stripped of quotes; a first turn stays."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("n", n)
    framed = F.concat(F.lit("Follow-up after "), (F.col("n") - 1).cast("string"), F.lit(": "), F.regexp_replace("text", "^[\"']+|[\"']+$", ""))
    return rows.select("conv_id", "turn", F.when((F.col("n") <= 1) | (F.col("role") != "user"), F.col("text")).otherwise(framed).alias("rewritten"))


@query("SELECT doc_id, CASE WHEN n_chars // 1000 = 0 THEN source ELSE source || '/' || (n_chars // 5000) END AS topic FROM documents")
def topic_of(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.when(F.expr("n_chars div 1000") == 0, F.col("source")).otherwise(F.concat("source", F.lit("/"), F.expr("n_chars div 5000").cast("string"))).alias("topic"))
