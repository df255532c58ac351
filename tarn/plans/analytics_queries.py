"""Evaluation analytics, audits, joins, sessions and traces."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators.containment import holders
from tarn.operators import quantiles
from tarn.plans.registry import query, table


def _n(cond):
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0))


_TRUTH = "WITH t AS (SELECT toxic, quality, toxic = 0 AND quality = 1 AS gold, doc_id % 7 <> 0 AS pred FROM labels), c AS (SELECT CAST(gold AS VARCHAR) AS gold, CAST(pred AS VARCHAR) AS pred, count(*) AS n FROM t GROUP BY 1, 2), k AS (SELECT unnest(['true', 'false']) AS label) "


def _outcomes(spark, sf_dir):
    """A truth (clean and good) and a fixed prediction for each labelled document."""
    gold = (F.col("toxic") == 0) & (F.col("quality") == 1)
    return table(spark, sf_dir, "labels").select(gold.cast("string").alias("gold"), (F.col("doc_id") % 7 != 0).cast("string").alias("pred"))


@query(_TRUTH + "SELECT a.label AS gold, b.label AS pred, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN c ON c.gold = a.label AND c.pred = b.label")
def confusion_matrix(spark, sf_dir):
    """Every pair of labels has its row, also those that don't occur: the four sums of one pass, unpivoted."""
    pairs = [(g, p) for g in ("true", "false") for p in ("true", "false")]
    sums = _outcomes(spark, sf_dir).agg(*(_n((F.col("gold") == g) & (F.col("pred") == p)).alias(f"{g}_{p}") for g, p in pairs))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gold"), F.lit(p).alias("pred"), F.col(f"{g}_{p}").alias("n")) for g, p in pairs))).alias("x")).select("x.*")


_PRF = _TRUTH + """, s AS (SELECT label, coalesce(sum(n) FILTER (gold = label AND pred = label), 0) AS hit, coalesce(sum(n) FILTER (gold = label), 0) AS support, coalesce(sum(n) FILTER (pred = label), 0) AS given FROM k, c GROUP BY label),
r AS (SELECT label, CAST(support AS BIGINT) AS support, round(coalesce(hit / nullif(given, 0), 0), 6) AS "precision", round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * hit / nullif(given + support, 0), 0), 6) AS f1 FROM s) """


@query(_PRF + 'SELECT label, support, "precision", recall, f1 FROM r')
def per_class_prf(spark, sf_dir):
    labels = ("true", "false")
    rows = _outcomes(spark, sf_dir).agg(*(x for c in labels for x in (_n((F.col("gold") == c) & (F.col("pred") == c)).alias(f"{c}_hit"), _n(F.col("gold") == c).alias(f"{c}_support"), _n(F.col("pred") == c).alias(f"{c}_given"))))
    rows = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), *(F.col(f"{c}_{x}").alias(x) for x in ("hit", "support", "given"))) for c in labels))).alias("x")).select("x.*")
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return rows.select("label", "support", ratio(F.col("hit"), F.col("given")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("given") + F.col("support")).alias("f1"))


@query(_PRF + "SELECT round(avg(f1), 5) AS macro_f1 FROM r")
def macro_f1(spark, sf_dir):
    return per_class_prf(spark, sf_dir).agg(F.round(F.avg("f1"), 5).alias("macro_f1"))


@query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value <> 0 GROUP BY event_type")
def latency_summary(spark, sf_dir):
    """Interpolated percentiles of each stage, over times that are not zero."""
    rows = table(spark, sf_dir, "events").where("value <> 0").select(F.col("event_type").alias("stage"), "value")
    means = rows.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    found = quantiles.percentiles(rows, ["stage"], "value", {"p50": 0.5, "p95": 0.95})
    return means.join(found.drop("n"), "stage").select("stage", "n", "mean", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT stage, value AS p95 FROM (SELECT event_type AS stage, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1")
def latency_p95_floor(spark, sf_dir):
    """The value at place int(0.95 * (n - 1)): another percentile than that of latency_summary."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), "value")
    return quantiles.percentiles(rows, ["stage"], "value", {"p95": 0.95}, floor=True).select("stage", "p95")


@query("SELECT l_returnflag AS metric, count(l_discount) AS n, round(avg(l_discount), 6) AS mean, round(median(l_discount), 6) AS median, round(coalesce(stddev_samp(l_discount), 0), 6) AS std, min(l_discount) AS least, max(l_discount) AS most FROM lineitem GROUP BY 1")
def metric_stats(spark, sf_dir):
    x, rows = F.col("l_discount"), table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("metric"), "l_discount")
    stats = rows.groupBy("metric").agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 6).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))
    middle = quantiles.percentiles(rows, ["metric"], "l_discount", {"median": 0.5}).select("metric", F.round("median", 6).alias("median"))
    return stats.join(middle, "metric", "left").select("metric", "n", "mean", "median", "std", "least", "most")


@query("SELECT round(avg(CAST(n_user > 1 AS INTEGER)), 6) AS re_retrieve_rate, round(avg(n), 6) AS avg_iterations, count(*) AS n FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id)")
def decision_rates(spark, sf_dir):
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), _n(F.col("role") == "user").alias("n_user"))
    return per.agg(F.round(F.avg((F.col("n_user") > 1).cast("int")), 6).alias("re_retrieve_rate"), F.round(F.avg("n"), 6).alias("avg_iterations"), F.count("*").alias("n"))


@query("SELECT lang, source, toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (toxic))")
def distribution_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.groupingSets([["lang"], ["source"], ["toxic"]], "lang", "source", "toxic").agg(F.count("*").alias("n")).select("lang", "source", "toxic", "n")


@query("SELECT count(*) FILTER (quality = 1) * 3 + count(*) FILTER (toxic = 0) * 2 AS calls, count(*) FILTER (quality = 1) AS eligible FROM labels")
def cost_estimate(spark, sf_dir):
    good = _n(F.col("quality") == 1)
    return table(spark, sf_dir, "labels").agg((good * 3 + _n(F.col("toxic") == 0) * 2).alias("calls"), good.alias("eligible"))


@query("SELECT source, max_by(text, doc_id) AS text, max(doc_id) AS doc_id FROM documents GROUP BY source")
def gold_index_last_wins(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max_by("text", "doc_id").alias("text"), F.max("doc_id").alias("doc_id"))


_TOKENS = r"WITH p AS (SELECT item_id, doc_id, list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+')) AS x, list_distinct(regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]+')) AS y FROM benchmark b JOIN documents d ON contains(d.text, b.text)), j AS (SELECT item_id, doc_id, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS jaccard FROM p) "


def _holders(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return holders(table(spark, sf_dir, "documents").select("doc_id", "text"), items)


def _jaccard(spark, sf_dir):
    rows = _holders(spark, sf_dir).select("item_id", "doc_id", T.words(F.col("item")).alias("x"), T.words(F.col("text")).alias("y"))
    return rows.select("item_id", "doc_id", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


@query(_TOKENS + "SELECT item_id, doc_id, jaccard FROM j")
def token_jaccard(spark, sf_dir):
    return _jaccard(spark, sf_dir)


@query("SELECT count(*) AS n, count(*) FILTER (text IS NULL OR text = '') AS empty, count(*) FILTER (length(text) <> n_chars) AS wrong_length, count(*) - count(DISTINCT doc_id) AS repeated, max(doc_id) - min(doc_id) + 1 - count(DISTINCT doc_id) AS missing FROM documents")
def quality_assertions(spark, sf_dir):
    x = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), _n(x == "").alias("empty"), _n(F.length("text") != F.col("n_chars")).alias("wrong_length"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated"), (F.max("doc_id") - F.min("doc_id") + 1 - F.count_distinct("doc_id")).alias("missing"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def gold_existence_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM documents d WHERE lower(trim(d.text)) = lower(trim(c.text)))")
def leakage_semi(spark, sf_dir):
    key = F.lower(F.trim("text")).alias("key")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", key).join(table(spark, sf_dir, "documents").select(key), "key", "left_semi").select("conv_id", "turn")


@query("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber > 2")
def missing_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").subtract(table(spark, sf_dir, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey")))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def stale_ids(spark, sf_dir):
    kept = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(kept, "l_orderkey", "left_anti").distinct()


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND lang = 'en'")
def resume_anti(spark, sf_dir):
    """What is left to do once good rows are done."""
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").join(done, "doc_id", "left_anti")


@query("SELECT doc_id AS id, 'documents' AS domain, NULL AS role FROM documents UNION ALL SELECT conv_id, 'conversations', role FROM conversations")
def union_sources(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("domain"))
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.lit("conversations").alias("domain"), "role")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT conv_id, turn, (SELECT string_agg(text, chr(10) ORDER BY turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.turn >= c.turn - 6) AS history FROM conversations c")
def history_window(spark, sf_dir):
    """The six turns before each turn."""
    before = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-6, -1)
    rows = table(spark, sf_dir, "conversations").withColumn("past", F.collect_list("text").over(before))
    return rows.select("conv_id", "turn", F.when(F.size("past") > 0, F.array_join("past", "\n")).alias("history"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4 GROUP BY conv_id")
def last_n_turns_context(spark, sf_dir):
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = table(spark, sf_dir, "conversations").withColumn("back", back).where("back <= 4")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session""")
def gap_sessions(spark, sf_dir):
    """Sessions end after more than an hour without an event."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(by) <= F.expr("INTERVAL 1 HOUR"), 0).otherwise(1)
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", new.alias("new")).withColumn("session", F.sum("new").over(by))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1, 2")
def trace_basic(spark, sf_dir):
    """Traces by day, with a field of their JSON."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("SELECT o.o_orderkey, count(*) AS n_chunks, round(max(l_extendedprice), 2) AS best FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderpriority LIKE '1%' GROUP BY 1")
def trace_full_join(spark, sf_dir):
    """Basic rows with their detail rows, by key."""
    basic = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").like("1%")).select("o_orderkey")
    full = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return basic.join(full, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n_chunks"), F.round(F.max("l_extendedprice"), 2).alias("best"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY first) AS cited, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN any_value(role) ELSE 'both' END AS collapsed FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def cited_sources(spark, sf_dir):
    """Distinct labels in order of first appearance; more than one collapse to both."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    rows = first.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "role"))), lambda x: x["role"]).alias("roles"))
    return rows.select("conv_id", F.array_join("roles", ",").alias("cited"), F.size("roles").cast("long").alias("n"), F.when(F.size("roles") == 1, F.col("roles")[0]).otherwise("both").alias("collapsed"))
