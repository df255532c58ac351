"""Joins of results with test sets, gold sets, records of runs, reports and resumption."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.operators import retrieval as R
from tarn.plans.registry import query, table
from tarn.plans.retrieval_queries import BM25_GLOBAL, _gold, bm25_topk
from tarn.sources.shared import checkpointed, folder


def _n(cond):
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0))


# --- test sets and results: benchmark passages are the test set, labelled documents the results of a run ---

_RUN = "run AS (SELECT doc_id AS id, quality, toxic, CASE WHEN toxic = 1 THEN 'RateLimit: slow down' WHEN quality = 0 THEN 'Timeout: ' || doc_id END AS error FROM labels), tests AS (SELECT item_id AS id, row_number() OVER (ORDER BY item_id) - 1 AS ordinal, text FROM benchmark)"


def _run(spark, sf_dir):
    error = F.when(F.col("toxic") == 1, "RateLimit: slow down").when(F.col("quality") == 0, F.concat(F.lit("Timeout: "), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic", error.alias("error"))


def _tests(spark, sf_dir):
    """The test set with its ordinal, the place of an item in the order of ids."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").alias("ordinal"), "text")


@query("SELECT r.id, CASE WHEN b.item_id IS NULL THEN 'unknown' ELSE 'matched' END AS status FROM (SELECT doc_id AS id FROM labels) r FULL JOIN benchmark b ON b.item_id = r.id WHERE r.id IS NOT NULL UNION ALL SELECT item_id, 'missing' FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def testset_join(spark, sf_dir):
    """What a run's join with its test set meets: matched, unknown (which aborts the evaluation) and missing ids."""
    run, tests = _run(spark, sf_dir).select("id", F.lit(True).alias("ran")), _tests(spark, sf_dir).select("id", F.lit(True).alias("known"))
    return run.join(tests, "id", "full").select("id", F.when(F.col("ran") & F.col("known"), "matched").when(F.col("ran"), "unknown").otherwise("missing").alias("status"))


@query("SELECT count(*) AS n_testset, count(l.doc_id) AS matched, count(*) FILTER (l.doc_id IS NULL) AS missing FROM benchmark LEFT JOIN labels l ON l.doc_id = item_id")
def testset_coverage(spark, sf_dir):
    run = _run(spark, sf_dir).select("id", F.lit(1).alias("ran"))
    return _tests(spark, sf_dir).join(run, "id", "left").agg(F.count("*").alias("n_testset"), F.count("ran").alias("matched"), _n(F.col("ran").isNull()).alias("missing"))


@query("SELECT d.doc_id AS id, coalesce(b.item_id, 1000000000 + d.doc_id) AS place FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def testset_order(spark, sf_dir):
    """The place of every record in the order of the test set; extras come last."""
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return records.join(_tests(spark, sf_dir).select("id", "ordinal"), "id", "left").select("id", F.coalesce("ordinal", F.lit(10**9) + F.col("id")).alias("place"))


@query("SELECT DISTINCT item_id AS id FROM benchmark")
def testset_ids(spark, sf_dir):
    return _tests(spark, sf_dir).select("id").distinct()


@query(f"WITH {_RUN} SELECT split_part(error, ':', 1) AS reason, count(*) AS n FROM run WHERE error IS NOT NULL GROUP BY 1 ORDER BY n DESC")
def error_reasons(spark, sf_dir):
    """Failed records by what stands before the colon of their error, most first."""
    failed = _run(spark, sf_dir).where("error is not null")
    return failed.groupBy(F.split_part("error", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(f"WITH {_RUN} SELECT count(*) FILTER (error IS NULL) AS valid, count(*) FILTER (error IS NOT NULL) AS failed, count(*) FILTER (error IS NULL AND id % 7 = 0) AS none_route, count(*) FILTER (error IS NULL AND id % 7 <> 0) AS routed FROM run")
def record_partitions(spark, sf_dir):
    """Records that failed, and of the others those without a route."""
    ok, none = F.col("error").isNull(), F.col("id") % 7 == 0
    return _run(spark, sf_dir).agg(_n(ok).alias("valid"), _n(~ok).alias("failed"), _n(ok & none).alias("none_route"), _n(ok & ~none).alias("routed"))


@query(f"WITH {_RUN} SELECT id FROM run WHERE id IN (1, 2, 3, 5, 8, 13, 21) AND error IS NULL ORDER BY id LIMIT 5")
def id_subset(spark, sf_dir):
    """Of some ids asked for, the first five that are valid, in order."""
    return _run(spark, sf_dir).where(F.col("id").isin(1, 2, 3, 5, 8, 13, 21) & F.col("error").isNull()).select("id").orderBy("id").limit(5)


@query(f"WITH {_RUN} SELECT id, CASE WHEN error IS NOT NULL THEN 'fatal: ' || split_part(error, ':', 1) END AS faithfulness, CASE WHEN error IS NOT NULL THEN 'fatal: ' || split_part(error, ':', 1) WHEN id % 7 = 0 THEN 'no contexts' END AS context_recall, CASE WHEN error IS NOT NULL THEN 'fatal: ' || split_part(error, ':', 1) WHEN id % 5 = 0 THEN 'no expected answer' END AS similarity FROM run")
def metric_blockers(spark, sf_dir):
    """For each metric why a record can't be judged; null where it can."""
    fatal = F.concat(F.lit("fatal: "), F.split_part("error", F.lit(":"), F.lit(1)))
    why = lambda *more: next(iter([F.when(F.col("error").isNotNull(), fatal)])) if not more else F.when(F.col("error").isNotNull(), fatal).when(*more)
    return _run(spark, sf_dir).select("id", why().alias("faithfulness"), why(F.col("id") % 7 == 0, "no contexts").alias("context_recall"), why(F.col("id") % 5 == 0, "no expected answer").alias("similarity"))


# --- gold sets ---

_GOLDS = "g AS (SELECT doc_id, 'd' || (doc_id % 4) AS domain, ['d' || (doc_id % 4) || ':page:' || (doc_id // 10), 'd' || (doc_id % 4) || ':page:' || (doc_id // 20), 'd' || (doc_id % 4) || ':page:' || (doc_id // 10)] AS ids FROM documents)"


def _golds(spark, sf_dir):
    """Gold ids with their domain in front, some of them twice."""
    domain = F.concat(F.lit("d"), (F.col("doc_id") % 4).cast("string"))
    gid = lambda by: F.concat(domain, F.lit(":page:"), F.expr(f"doc_id div {by}").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", domain.alias("domain"), F.array(gid(10), gid(20), gid(10)).alias("ids"))


@query(f"WITH {_GOLDS} SELECT doc_id, domain, CASE WHEN doc_id // 10 = doc_id // 20 THEN 'page:' || (doc_id // 10) ELSE 'page:' || (doc_id // 10) || ',page:' || (doc_id // 20) END AS gold FROM g")
def gold_chunks(spark, sf_dir):
    """Gold ids without their domain, each once, in order of first appearance."""
    bare = F.array_distinct(F.transform("ids", lambda x: F.substring(x, F.length("domain") + 2, F.length(x))))
    return _golds(spark, sf_dir).select("doc_id", "domain", F.array_join(bare, ",").alias("gold"))


@query(f"WITH {_GOLDS} SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(ids, lambda x: x))), ',') AS gold FROM g")
def gold_set(spark, sf_dir):
    """A map of domains to ids as one flat set of ids with their domain."""
    maps = _golds(spark, sf_dir).select("doc_id", F.create_map("domain", F.transform("ids", lambda x: F.substring(x, F.length("domain") + 2, F.length(x)))).alias("m"))
    flat = F.flatten(F.transform(F.map_entries("m"), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(":"), v))))
    return maps.select("doc_id", F.array_join(F.array_sort(F.array_distinct(flat)), ",").alias("gold"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN n_chars IS NOT NULL THEN 'dukcapil:page:' || (doc_id // 10) END WHEN 1 THEN 'opd:nomor:' || doc_id WHEN 2 THEN 'perizinan:id:' || doc_id ELSE 'sosial:id:' || source || CASE doc_id % 5 WHEN 0 THEN '#pasal:' || (doc_id % 9) WHEN 1 THEN '#penjelasan:' || (doc_id % 9) WHEN 2 THEN '#preamble' WHEN 3 THEN '#narr:' || (doc_id % 9) ELSE '#p' || (doc_id // 10) END || CASE WHEN doc_id % 8 = 7 THEN '.' || (doc_id % 3) ELSE '' END END AS gold_id FROM documents")
def gold_id(spark, sf_dir):
    """The id of a chunk by the rule of its domain: page, number, id, or id with the kind of chunk and its part."""
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    kind = F.when(i % 5 == 0, F.concat(F.lit("#pasal:"), s(i % 9))).when(i % 5 == 1, F.concat(F.lit("#penjelasan:"), s(i % 9))).when(i % 5 == 2, "#preamble").when(i % 5 == 3, F.concat(F.lit("#narr:"), s(i % 9))).otherwise(F.concat(F.lit("#p"), s(F.expr("doc_id div 10"))))
    part = F.when(i % 8 == 7, F.concat(F.lit("."), s(i % 3))).otherwise("")
    legal = F.concat(F.lit("sosial:id:"), "source", kind, part)
    page = F.when(F.col("n_chars").isNotNull(), F.concat(F.lit("dukcapil:page:"), s(F.expr("doc_id div 10"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(i % 4 == 0, page).when(i % 4 == 1, F.concat(F.lit("opd:nomor:"), s(i))).when(i % 4 == 2, F.concat(F.lit("perizinan:id:"), s(i))).otherwise(legal).alias("gold_id"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'own:' || doc_id END, CASE WHEN doc_id % 5 = 0 THEN 'page:' || doc_id END, CASE WHEN lang = 'en' THEN 'nomor:' || doc_id END) AS gold_id FROM documents")
def probed_gold_id(spark, sf_dir):
    """By a document's own source, else the first domain, in order, whose rule gives an id."""
    s = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("own:"), s)), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("page:"), s)), F.when(F.col("lang") == "en", F.concat(F.lit("nomor:"), s))).alias("gold_id"))


_JUDGED = "j AS (SELECT v.vec_id, v.label, CASE WHEN label % 4 = 0 THEN 'both' WHEN label % 4 = 1 THEN 'none' ELSE 's' || (label % 4) END AS expected, CASE WHEN vec_id % 6 = 0 THEN ['s2', 's3'] WHEN vec_id % 6 = 1 THEN [] ELSE ['s' || (2 + vec_id % 2)] END AS used FROM embeddings v)"


@query(f"WITH {_JUDGED} SELECT vec_id, CASE WHEN expected = 'none' THEN NULL WHEN expected = 'both' THEN len(used) >= 2 ELSE list_contains(used, expected) END AS store_correct FROM j")
def store_correct(spark, sf_dir):
    """Whether the stores that were searched include the expected one, two of them for both; null if none was expected."""
    k = F.col("label") % 4
    expected = F.when(k == 0, "both").when(k == 1, "none").otherwise(F.concat(F.lit("s"), k.cast("string")))
    u = F.col("vec_id") % 6
    used = F.when(u == 0, F.array(F.lit("s2"), F.lit("s3"))).when(u == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("s"), (2 + F.col("vec_id") % 2).cast("string"))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", expected.alias("expected"), used.alias("used"))
    return rows.select("vec_id", F.when(F.col("expected") == "both", F.size("used") >= 2).when(F.col("expected") != "none", F.array_contains("used", F.col("expected"))).alias("store_correct"))


@query("SELECT event_type AS subtype, count(*) AS n, round(avg(CASE WHEN coalesce(CASE WHEN event_id % 11 <> 0 THEN CASE WHEN value > 50 THEN 'valid' ELSE 'invalid' END END, 'valid') = 'invalid' THEN 1.0 ELSE 0.0 END), 6) AS recall FROM events GROUP BY 1")
def invalid_recall_by_type(spark, sf_dir):
    """Of invalid questions of each kind, how many were refused; a record without a prediction counts as valid."""
    predicted = F.coalesce(F.when(F.col("event_id") % 11 != 0, F.when(F.col("value") > 50, "valid").otherwise("invalid")), F.lit("valid"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("subtype")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(predicted == "invalid", 1.0).otherwise(0.0)), 6).alias("recall"))


@query("SELECT label, count(*) AS n, round(avg(CASE WHEN list_contains(CASE WHEN vec_id % 7 = 0 THEN [label, (label + 1) % 10] ELSE [label] END, (label + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END) % 10) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM embeddings GROUP BY label")
def routing_accuracy(spark, sf_dir):
    """Routes held against sets of labels that are all accepted, by label."""
    accepted = F.when(F.col("vec_id") % 7 == 0, F.array(F.col("label"), (F.col("label") + 1) % 10)).otherwise(F.array("label"))
    routed = (F.col("label") + F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0)) % 10
    rows = table(spark, sf_dir, "embeddings").select("label", F.array_contains(accepted, routed).alias("ok"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query("SELECT user_id, round(avg(least(value, k)), 6) AS low, round(avg(greatest(value, k)), 6) AS high FROM (SELECT user_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY user_id")
def paired_extremes(spark, sf_dir):
    """The mean of the lesser and of the greater of two columns."""
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf_dir, "events").select("user_id", "value", k.alias("k"))
    return rows.groupBy("user_id").agg(F.round(F.avg(F.least("value", "k")), 6).alias("low"), F.round(F.avg(F.greatest("value", "k")), 6).alias("high"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(s, 'SCORE: [012]') THEN CAST(regexp_extract(s, 'SCORE: ([012])', 1) AS INTEGER) / 2.0 END AS score, CASE WHEN regexp_matches(upper(s), '\\bYES\\b') THEN TRUE WHEN regexp_matches(upper(s), '\\bNO\\b') THEN FALSE END AS refused FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'SCORE: 2 because' WHEN 1 THEN 'SCORE: 1 and yes' WHEN 2 THEN 'no, SCORE: 0' ELSE 'unclear' END AS s FROM conversations)")
def judge_replies(spark, sf_dir):
    """Scores 0, 1, 2 as 0, a half, 1, and YES or NO, read from a judge's reply; null where it says neither."""
    t = F.col("turn") % 4
    said = F.when(t == 0, "SCORE: 2 because").when(t == 1, "SCORE: 1 and yes").when(t == 2, "no, SCORE: 0").otherwise("unclear")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("s"))
    mark = F.regexp_extract("s", r"SCORE: ([012])", 1)
    return rows.select("conv_id", "turn", F.when(mark != "", mark.cast("int") / 2.0).alias("score"), F.when(F.upper("s").rlike(r"\bYES\b"), True).when(F.upper("s").rlike(r"\bNO\b"), False).alias("refused"))


@query(r"""WITH a AS (SELECT c.conv_id, unnest(list_filter(string_split(c.text, '. '), lambda s: s <> '')) AS claim FROM conversations c WHERE role = 'assistant'),
g AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS words FROM conversations WHERE role = 'user' GROUP BY conv_id),
s AS (SELECT a.conv_id, list_distinct(regexp_extract_all(lower(claim), '[a-z0-9]+')) AS c, coalesce(words, []) AS words FROM a LEFT JOIN g USING (conv_id))
SELECT conv_id, count(*) AS claims, count(*) FILTER (len(c) > 0 AND 2 * len(list_intersect(c, words)) >= len(c)) AS supported, round(count(*) FILTER (len(c) > 0 AND 2 * len(list_intersect(c, words)) >= len(c)) / count(*), 6) AS faithfulness FROM s GROUP BY conv_id""")
def faithfulness_proxy(spark, sf_dir):
    """Sentences of the answers of which half the words or more are in what was asked, over all: no judge, a stand-in."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    rows = table(spark, sf_dir, "conversations")
    claims = rows.where("role = 'assistant'").select("conv_id", F.explode(F.filter(F.split("text", r"\. "), lambda s: s != "")).alias("claim")).select("conv_id", words(F.col("claim")).alias("c"))
    given = rows.where("role = 'user'").select("conv_id", F.explode(words(F.col("text"))).alias("w")).groupBy("conv_id").agg(F.collect_set("w").alias("words"))
    both = F.size(F.array_intersect("c", F.coalesce("words", F.array().cast("array<string>"))))
    ok = _n((F.size("c") > 0) & (2 * both >= F.size("c")))
    return claims.join(given, "conv_id", "left").groupBy("conv_id").agg(F.count("*").alias("claims"), ok.alias("supported"), F.round(ok / F.count("*"), 6).alias("faithfulness"))


# --- caches, resumption, reports ---


@query("SELECT d.doc_id, m AS model, metric, CASE WHEN l.doc_id IS NOT NULL AND l.doc_id % 4 <> 0 AND m = 'm1' THEN CASE metric WHEN 'faithfulness' THEN l.quality ELSE 1 - l.toxic END END AS score FROM documents d CROSS JOIN (SELECT unnest(['m1', 'm2']) AS m) CROSS JOIN (SELECT unnest(['faithfulness', 'relevance']) AS metric) LEFT JOIN labels l ON l.doc_id = d.doc_id")
def score_cache_lookup(spark, sf_dir):
    """Scores by a key of id, metric, hash of the answer and model; what isn't cached, or failed for now, is null."""
    key = lambda: F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), "metric", F.sha1(F.coalesce("text", F.lit(""))), "model")).alias("key")
    metrics = F.explode(F.array(F.lit("faithfulness"), F.lit("relevance"))).alias("metric")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.join(table(spark, sf_dir, "labels"), "doc_id").where("doc_id % 4 <> 0").select("doc_id", "text", "quality", "toxic", F.lit("m1").alias("model"), metrics)
    cache = known.select(key(), F.when(F.col("metric") == "faithfulness", F.col("quality")).otherwise(1 - F.col("toxic")).alias("score"))
    asked = docs.select("doc_id", "text", F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("model")).select("*", metrics)
    return asked.select("doc_id", "model", "metric", key()).join(cache, "key", "left").select("doc_id", "model", "metric", "score")


@query("SELECT vec_id, vec_id % 3 = 0 AND vec_id % 6 <> 3 AND vec_id % 7 <> 0 AS cached, 64 = len(embedding) AS fits FROM embeddings")
def embedding_cache(spark, sf_dir):
    """Vectors found in a cache by model, length, id and the whole content; an entry of another model, or one whose last number
    was another, is no hit. fits: of the one length that all vectors must have."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dim"), "embedding")
    v = v.withColumn("text", F.to_json("embedding"))
    key = lambda model: F.sha1(F.concat_ws("|", model, F.col("dim").cast("string"), F.col("vec_id").cast("string"), "text"))
    changed = F.concat(F.slice("embedding", 1, F.size("embedding") - 1), F.array(F.element_at("embedding", -1) + F.lit(1).cast("float")))
    old = v.withColumn("text", F.when(F.col("vec_id") % 7 == 0, F.to_json(changed)).otherwise(F.col("text")))
    cache = old.where("vec_id % 3 = 0").select(key(F.when(F.col("vec_id") % 6 == 3, "old").otherwise("new")).alias("key"), F.lit(True).alias("hit"))
    return v.withColumn("key", key(F.lit("new"))).join(cache, "key", "left").select("vec_id", F.coalesce("hit", F.lit(False)).alias("cached"), (F.col("dim") == 64).alias("fits"))


@query("SELECT CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS added, count(*) AS n FROM documents")
def roundtrip_except(spark, sf_dir):
    """Rows written as Parquet and as JSON, read back and compared both ways, by hashes of whole rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = folder(spark, "roundtrip")
    docs.write.parquet(f"{path}/parquet")
    docs.write.option("ignoreNullFields", False).json(f"{path}/json")
    marked = lambda df: df.select(F.sha2(F.to_json(F.struct("doc_id", "text", "source"), {"ignoreNullFields": "false"}), 256).alias("row"))
    a, b = marked(spark.read.parquet(f"{path}/parquet")), marked(spark.read.schema("doc_id long, text string, source string").json(f"{path}/json"))
    was = marked(docs)
    count = lambda x, name: x.agg(F.count("*").alias(name))
    return count(was.exceptAll(a).unionAll(was.exceptAll(b)), "lost").join(count(a.exceptAll(was).unionAll(b.exceptAll(was)), "added")).join(count(a, "n"))


@query("SELECT doc_id AS id, CASE WHEN length(coalesce(text, '')) < 300 THEN 'scan_or_partial' END AS reason, count(*) FILTER (length(coalesce(text, '')) < 300) OVER () AS total FROM documents QUALIFY reason IS NOT NULL")
def skip_log(spark, sf_dir):
    """What was rejected, why, and how many in all."""
    rows = table(spark, sf_dir, "documents").where(F.length(F.coalesce("text", F.lit(""))) < 300).select(F.col("doc_id").alias("id"), F.lit("scan_or_partial").alias("reason"))
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("SELECT d.doc_id, coalesce(nullif(d.source, ''), 'unknown') AS kind FROM documents d WHERE md5('u' || d.doc_id) NOT IN (SELECT md5('u' || doc_id) FROM labels WHERE quality = 1)")
def scrape_resume(spark, sf_dir):
    """Pages that aren't stored yet by the hash of their address, with a type filled in where it is missing."""
    url = F.md5(F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("url")
    done = table(spark, sf_dir, "labels").where("quality = 1").select(url)
    return table(spark, sf_dir, "documents").select("doc_id", "source", url).join(done, "url", "left_anti").select("doc_id", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("kind"))


_ABLATION = BM25_GLOBAL + """, gold AS (SELECT item_id AS q, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
k AS (SELECT unnest([1, 3, 5]) AS k), r AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM padded),
x AS (SELECT k, g.q, count(DISTINCT r.doc) FILTER (h.doc IS NOT NULL) AS found, count(DISTINCT r.doc) AS n FROM k CROSS JOIN (SELECT DISTINCT q FROM gold) g JOIN r ON r.q = g.q AND r.rank <= k LEFT JOIN gold h ON h.q = r.q AND h.doc = r.doc GROUP BY k, g.q),
s AS (SELECT q, count(*) AS size FROM gold GROUP BY q)"""


@query(_ABLATION + " SELECT CAST(k AS INTEGER) AS k, round(avg(found / size), 6) AS recall, round(avg(found / n), 6) AS \"precision\" FROM x JOIN s USING (q) GROUP BY k")
def ablation_grid(spark, sf_dir):
    """Recall and precision of the same search at several depths: a table of configurations times questions."""
    ranked = bm25_topk(spark, sf_dir).select("q", "doc", "rank")
    gold = checkpointed(_gold(spark, sf_dir))
    cells = ranked.withColumn("k", F.explode(F.array(*map(F.lit, (1, 3, 5))))).where("rank <= k")
    found = cells.join(gold.withColumn("hit", F.lit(1)), ["q", "doc"], "left").groupBy("k", "q").agg(F.count("hit").alias("found"), F.count("*").alias("n"))
    rows = found.join(gold.groupBy("q").agg(F.count("*").alias("size")), "q")
    return rows.groupBy("k").agg(F.round(F.avg(F.col("found") / F.col("size")), 6).alias("recall"), F.round(F.avg(F.col("found") / F.col("n")), 6).alias("precision"))


@query("SELECT lang, source, CAST(grouping_id(lang, source) AS BIGINT) AS level, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, n_chars FROM documents) GROUP BY GROUPING SETS ((lang), (source), ())")
def breakdown_grouping_sets(spark, sf_dir):
    """By any dimension, missing as ?, and by none; level tells what is summed up (null) from what is missing (?)."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source"), "n_chars")
    return docs.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum("n_chars").alias("chars")).select("lang", "source", "level", "n", "chars")


@query("SELECT a.label, b.label AS other, count(*) AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.label <> b.label GROUP BY 1, 2")
def cross_domain_pairs(spark, sf_dir):
    """Every row paired with the next one where that is of another domain."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    partner = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("other"))
    return v.join(partner, "vec_id").where("label <> other").groupBy("label", "other").agg(F.count("*").alias("n"))


@query("SELECT conv_id, round(avg(CAST(n_user > 1 AS INTEGER)), 6) AS re_retrieve, count(*) AS n FROM (SELECT conv_id % 5 AS conv_id, n_user FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id)) GROUP BY conv_id")
def decision_rates_by_mode(spark, sf_dir):
    """How often each mode searched again."""
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(_n(F.col("role") == "user").alias("n_user"))
    return per.groupBy((F.col("conv_id") % 5).alias("conv_id")).agg(F.round(F.avg((F.col("n_user") > 1).cast("int")), 6).alias("re_retrieve"), F.count("*").alias("n"))


@query("SELECT conv_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, text FROM conversations")
def ranked_documents(spark, sf_dir):
    """Lists of documents with ranks from 1, without what only the search needed."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("rank"), "text")
