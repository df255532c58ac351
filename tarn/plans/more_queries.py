"""Near duplicates, token runs, selections, round trips and rounds of search."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import chunking, quotas, selection
from tarn.operators import retrieval as R
from tarn.plans.analytics_queries import _holders, token_jaccard
from tarn.plans.registry import query, table
from tarn.plans.retrieval_queries import _vectors


@query()
def recursive_chunks(spark, sf_dir):
    return chunking.recursive_chunks(table(spark, sf_dir, "documents"))


def _picks(n: int) -> str:
    """The greedy choice step by step, all buckets at once."""
    out = "c AS (SELECT lang AS bucket, doc_id AS id, source AS grp, round(least(1.0, n_chars / 5000), 4) AS score FROM documents), s0 AS (SELECT bucket, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS grps FROM c GROUP BY bucket)"
    for k in range(1, n + 1):
        value = "round(score - 0.25 * len(list_filter(grps, lambda g: g = grp)), 6)"
        out += f", b{k} AS (SELECT c.bucket, arg_max(struct_pack(id := id, grp := grp), ROW({value}, -id)) AS x FROM c JOIN s{k - 1} s ON s.bucket = c.bucket WHERE NOT list_contains(ids, id) GROUP BY c.bucket), s{k} AS (SELECT s.bucket, CASE WHEN x IS NULL THEN ids ELSE list_append(ids, x.id) END AS ids, CASE WHEN x IS NULL THEN grps ELSE list_append(grps, x.grp) END AS grps FROM s{k - 1} s LEFT JOIN b{k} b ON b.bucket = s.bucket)"
    return f"WITH {out} SELECT bucket, unnest(ids) AS id, CAST(unnest(range(1, len(ids) + 1)) AS INTEGER) AS place FROM s{n}"


@query(_picks(10))
def greedy_selection(spark, sf_dir):
    """Ten documents of each language, spread over sources."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("bucket"), F.col("doc_id").alias("id"), F.col("source").alias("grp"), F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000), 4).alias("score"))
    return selection.greedy_selection(docs, 10)


@query()
def quota_selection(spark, sf_dir):
    """Documents as test questions: languages are buckets, sources evidence, and sizes the types whose quotas all share.

    A repeated text is redundant, a poor one problematic, an empty one never picked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.length("text").alias("n"), F.xxhash64("text").alias("same"), T.char_ratio(F.col("text")).alias("good"))
    first = F.min("doc_id").over(Window.partitionBy("same", "n"))
    size = F.when(F.col("n") < 500, "lexical").when(F.col("n") < 2000, "semantic").otherwise("complex")
    tier = F.when(F.col("good") >= 0.95, "high").when(F.col("good") >= 0.8, "acceptable").when(F.col("n") > 0, "problematic")
    ease = F.when(F.col("n") < 1000, "easy").when(F.col("n") < 4000, "medium").otherwise("hard")
    score = F.round(F.least(F.lit(1.0), F.col("n") / 5000), 4)
    value = quotas.own_value(score, tier, ease, F.col("doc_id") > first, F.lit(False), F.col("lang") != "en")
    rows = docs.select(F.col("lang").alias("bucket"), F.col("doc_id").alias("id"), size.alias("qtype"), F.col("source").alias("evidence"), F.floor(F.least(F.col("n"), F.lit(20000)) / 1000).alias("topic"), value.alias("value"))
    return quotas.quota_selection(rows, {"en": 25, "de": 25, "fr": 25, "es": 25}, {"lexical": 40, "semantic": 40, "complex": 20})


def _rounds(n: int) -> str:
    out = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), a1 AS (SELECT vec_id AS q, e FROM v WHERE vec_id % 20 = 0)"
    for k in range(1, n + 1):
        cos = "round(list_cosine_similarity(a.e, v.e), 4)"
        out += f", f{k} AS (SELECT q, {k} AS round, v.vec_id AS doc, {cos} AS score, row_number() OVER (PARTITION BY q ORDER BY {cos} DESC, v.vec_id) AS rank FROM a{k} a JOIN v ON q <> v.vec_id)"
        out += f", a{k + 1} AS (SELECT a.q, list_transform(list_zip(a.e, v.e), lambda p: p[1] + p[2]) AS e FROM a{k} a JOIN f{k} f ON f.q = a.q AND f.rank = 1 AND f.score < 0.35 JOIN v ON v.vec_id = f.doc)"
    return f"WITH {out} SELECT q, CAST(round AS INTEGER) AS round, doc, score, CAST(rank AS INTEGER) AS rank FROM (" + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(1, n + 1)) + ") WHERE rank <= 5"


@query(_rounds(3))
def agent_rounds(spark, sf_dir):
    """Searches that go on for the questions whose best document is weak: three rounds at most."""
    asked, corpus = _vectors(spark, sf_dir)
    return selection.search_rounds(asked, corpus)


_RUNS = r"""WITH p AS (SELECT item_id, doc_id, regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+') AS x, regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]+') AS y FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
x AS (SELECT item_id, doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS t FROM p), y AS (SELECT item_id, doc_id, unnest(range(1, len(y) + 1)) AS j, unnest(y) AS t FROM p),
m AS (SELECT item_id, doc_id, i, i - j AS d FROM x JOIN y USING (item_id, doc_id, t)),
g AS (SELECT item_id, doc_id, d, i - row_number() OVER (PARTITION BY item_id, doc_id, d ORDER BY i) AS island FROM m),
runs AS (SELECT item_id, doc_id, max(n) AS run FROM (SELECT item_id, doc_id, count(*) AS n FROM g GROUP BY item_id, doc_id, d, island) GROUP BY item_id, doc_id)"""


@query(_RUNS + " SELECT * FROM runs")
def verbatim_run(spark, sf_dir):
    """The longest run of equal tokens of a passage and a text: matches on a diagonal, in islands of consecutive places."""
    pairs = _holders(spark, sf_dir).select("item_id", "doc_id", T.words(F.col("item")).alias("x"), T.words(F.col("text")).alias("y"))
    x = pairs.select("item_id", "doc_id", F.posexplode("x").alias("i", "t"))
    y = pairs.select("item_id", "doc_id", F.posexplode("y").alias("j", "t"))
    m = x.join(y, ["item_id", "doc_id", "t"]).withColumn("d", F.col("i") - F.col("j"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("item_id", "doc_id", "d").orderBy("i"))
    runs = m.withColumn("island", island).groupBy("item_id", "doc_id", "d", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("item_id", "doc_id").agg(F.max("n").alias("run"))


@query(_RUNS + ", j AS (SELECT item_id, doc_id, len(list_intersect(list_distinct(x), list_distinct(y))) AS both_, len(list_distinct(x)) + len(list_distinct(y)) AS all_ FROM p) SELECT item_id, doc_id, CASE WHEN coalesce(run, 0) >= 6 OR round(both_ / (all_ - both_), 6) >= 0.6 THEN 'regenerate' ELSE 'ok' END AS verdict FROM j LEFT JOIN runs USING (item_id, doc_id)")
def leakage_verdict(spark, sf_dir):
    """A question that shares six words in a row with its source, or most of its words, is to be asked anew."""
    rows = token_jaccard(spark, sf_dir).join(verbatim_run(spark, sf_dir), ["item_id", "doc_id"], "left")
    leaks = (F.coalesce("run", F.lit(0)) >= 6) | (F.col("jaccard") >= 0.6)
    return rows.select("item_id", "doc_id", F.when(leaks, "regenerate").otherwise("ok").alias("verdict"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def shared_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey").intersect(table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey")))


@query("SELECT text, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_questions(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("SELECT CASE WHEN lang = 'en' THEN 'valid' ELSE 'invalid' END AS intent, count(*) AS n, count(CASE WHEN lang = 'en' THEN doc_id END) AS retrieved FROM documents GROUP BY 1")
def intent_short_circuit(spark, sf_dir):
    """Invalid questions are not searched for, and keep their row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "valid").otherwise("invalid").alias("intent"))
    found = docs.where("intent = 'valid'").select("doc_id", F.lit(1).alias("hit"))
    return docs.join(found, "doc_id", "left").groupBy("intent").agg(F.count("*").alias("n"), F.count("hit").alias("retrieved"))


@query("SELECT source, max(CASE WHEN lang = 'en' THEN n END) AS en, max(CASE WHEN lang = 'fr' THEN n END) AS fr, max(CASE WHEN lang = 'de' THEN n END) AS de, max(CASE WHEN lang = 'es' THEN n END) AS es FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source")
def comparison_table(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.count(F.lit(1)))


@query("SELECT conv_id, string_agg('[' || n || '] ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def format_context(spark, sf_dir):
    """Numbered blocks for a prompt, in order."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    blocks = table(spark, sf_dir, "conversations").withColumn("n", n).withColumn("block", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "text"))
    return blocks.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("context"))


@query("SELECT conv_id, CASE WHEN count(*) FILTER (role = 'system') > 0 THEN 'INVALID' WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'NONE' ELSE 'COMBINED' END AS prompt, max_by(text, turn) FILTER (role = 'assistant' AND text <> '') AS answer FROM conversations GROUP BY conv_id")
def answer_selection(spark, sf_dir):
    """Which prompt a conversation gets, and its last answer that is not empty."""
    said = (F.col("role") == "assistant") & (F.col("text") != "")
    n = lambda r: F.sum((F.col("role") == r).cast("int"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.when(n("system") > 0, "INVALID").when(n("assistant") == 0, "NONE").otherwise("COMBINED").alias("prompt"), F.max_by(F.when(said, F.col("text")), F.when(said, F.col("turn"))).alias("answer"))


@query("SELECT c_mktsegment AS bucket, c_custkey AS id, CAST(r AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def tie_broken_top(spark, sf_dir):
    return R.top(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("bucket"), F.col("c_custkey").alias("id"), "c_acctbal"), 3, ["bucket"], F.desc("c_acctbal"), "id").select("bucket", "id", F.col("rank").alias("n"))
