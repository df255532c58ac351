"""Retrieval, fusion, gate and ranking-metric queries: benchmark passages ask, documents and embeddings answer."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.operators import audit, embedding, feedback, pairs, search
from tarn.operators import retrieval as R
from tarn.operators.containment import holders
from tarn.plans import sql as S
from tarn.plans.registry import documents, query, table
from tarn.sources.shared import checkpointed

_BM25 = """
t AS (SELECT doc_id AS doc, source, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS ts FROM documents),
l AS (SELECT doc, source, len(ts) AS dl, ts FROM t),
stats AS (SELECT {g} count(*) AS n, avg(dl) AS avgdl FROM l {gb}),
tf AS (SELECT doc, source, dl, token, count(*) AS tf FROM (SELECT doc, source, dl, unnest(ts) AS token FROM l) GROUP BY ALL),
d AS (SELECT {g} token, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT d.*, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM d JOIN stats ON {on_stats}),
mean AS (SELECT {g} avg(idf) AS mean_idf FROM raw {gb}),
idf AS (SELECT raw.* EXCLUDE (idf), CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf FROM raw JOIN mean ON {on_mean}),
asked AS (SELECT q, token, count(*) AS times FROM (SELECT item_id AS q, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS token FROM benchmark) GROUP BY ALL),
scored AS (SELECT q, doc, tf.source, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN asked USING (token) JOIN idf ON idf.token = tf.token {on_idf} GROUP BY q, doc, tf.source)
"""
#: Every question with every document of the least ids, at 0 where they share no token: as many as any list can need.
_PAD = """, padded AS (SELECT q, doc, source, score FROM scored UNION ALL SELECT item_id, doc_id, source, 0.0 FROM benchmark, (SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER ({p} ORDER BY doc_id) AS r FROM documents) WHERE r <= 40) z WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.q = item_id AND s.doc = z.doc_id))"""
BM25_GLOBAL = "WITH " + _BM25.format(g="", gb="", on_stats="TRUE", on_mean="TRUE", on_idf="").rstrip() + _PAD.format(p="")
BM25_LOCAL = "WITH " + _BM25.format(g="source,", gb="GROUP BY source", on_stats="d.source = stats.source", on_mean="raw.source = mean.source", on_idf="AND idf.source = tf.source").rstrip() + _PAD.format(p="PARTITION BY source")
_GOLD = "gold AS (SELECT item_id AS q, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0)"
_COS = "round(list_cosine_similarity(q.e, v.e), 4)"


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")


def _documents(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text", "source")


def _gold(spark, sf_dir):
    """Documents that hold a question's passage word for word."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("item"))
    return holders(_documents(spark, sf_dir), items).select("q", "doc")


def _vectors(spark, sf_dir):
    """Queries (every vector whose id is divisible by 20) and the corpus."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"), F.col("label").alias("q_label"))
    return asked, v.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("dv"), "label")


@query(BM25_GLOBAL + " SELECT q, doc, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS INTEGER) AS rank FROM padded) WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    return R.bm25_top(_documents(spark, sf_dir).drop("source"), _asked(spark, sf_dir), 5).select("q", "doc", "score", "rank")


@query(BM25_LOCAL + " SELECT q, source, doc, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q, source ORDER BY score DESC, doc) AS INTEGER) AS rank FROM padded) WHERE rank <= 3")
def bm25_domain_local(spark, sf_dir):
    """Statistics of each source by itself, and the best three of each."""
    return R.bm25_top(_documents(spark, sf_dir), _asked(spark, sf_dir), 3, ["source"]).select("q", "source", "doc", "score", "rank")


_METRICS = f""", {_GOLD}, r AS (SELECT q, doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM padded) WHERE rank <= 5),
m AS (SELECT r.q, count(*) AS n, count(gold.doc) AS good, count(DISTINCT gold.doc) AS found, min(CASE WHEN gold.doc IS NOT NULL THEN rank END) AS first FROM r LEFT JOIN gold ON gold.q = r.q AND gold.doc = r.doc GROUP BY r.q),
s AS (SELECT q, count(DISTINCT doc) AS n_gold FROM gold GROUP BY q), per AS (SELECT item_id AS q, CASE WHEN n_gold > 0 THEN CAST(coalesce(found, 0) > 0 AS INTEGER)::DOUBLE END AS hit, CASE WHEN n_gold > 0 THEN coalesce(round(found / n_gold, 6), 0) END AS recall,
CASE WHEN n_gold > 0 THEN coalesce(round(coalesce(good, 0) / n, 6), 0) END AS "precision", CASE WHEN n_gold > 0 THEN coalesce(round(1 / first, 6), 0) END AS mrr FROM benchmark LEFT JOIN s ON s.q = item_id LEFT JOIN m ON m.q = item_id)"""


@query(BM25_GLOBAL + _METRICS + ' SELECT q, hit, recall, "precision", mrr FROM per')
def retrieval_metrics(spark, sf_dir):
    """hit, recall, precision and mrr at 5 of BM25, against the documents that hold the passage; null without any."""
    ranked = bm25_topk(spark, sf_dir)
    return R.ranking_metrics(ranked, _gold(spark, sf_dir), _asked(spark, sf_dir), 5)


@query(BM25_GLOBAL + _METRICS + " SELECT count(hit) AS n, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall FROM per")
def mrr_at_k(spark, sf_dir):
    return retrieval_metrics(spark, sf_dir).agg(F.count("hit").alias("n"), F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("recall"))


@query(f"WITH {_V} SELECT * FROM (SELECT q.vec_id AS q, v.vec_id AS doc, {_COS} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS INTEGER) AS rank FROM q JOIN v ON q.vec_id <> v.vec_id) WHERE rank <= 5")
def dense_topk(spark, sf_dir):
    asked, corpus = _vectors(spark, sf_dir)
    return R.dense(asked, corpus, F.round(R.dot("qv", "dv"), 4), 5, unit=True).select("q", "doc", "score", "rank")


@query(f"WITH {_V} SELECT * FROM (SELECT q.vec_id AS q, v.vec_id AS doc, round(list_sum(list_transform(list_zip(q.e, v.e), lambda p: pow(p[1] - p[2], 2))), 4) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(q.e, v.e), lambda p: pow(p[1] - p[2], 2))), 4), v.vec_id) AS INTEGER) AS rank FROM q JOIN v ON q.vec_id <> v.vec_id) WHERE rank <= 5")
def dense_topk_scores(spark, sf_dir):
    """Squared distances, least first."""
    asked, corpus = _vectors(spark, sf_dir)
    return R.best_of(asked, corpus, 5, distance=True).select("q", "doc", "score", "rank")


@query(f"WITH {_V} SELECT * FROM (SELECT q.vec_id AS q, v.vec_id AS doc, {_COS} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS INTEGER) AS rank FROM q JOIN v ON q.vec_id <> v.vec_id AND v.label = 3) WHERE rank <= 5 AND score >= 0.1")
def dense_filtered(spark, sf_dir):
    """Only one domain, and only scores from a threshold on."""
    asked, corpus = _vectors(spark, sf_dir)
    return R.dense(asked, corpus.where("label = 3"), F.round(R.dot("qv", "dv"), 4), 5, unit=True).where("score >= 0.1").select("q", "doc", "score", "rank")


@query(f"WITH {_V} SELECT * FROM (SELECT q.vec_id AS q, v.label, v.vec_id AS doc, {_COS} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id, v.label ORDER BY {_COS} DESC, v.vec_id) AS INTEGER) AS rank FROM q JOIN v ON q.vec_id <> v.vec_id) WHERE rank <= 4")
def fanout_per_domain(spark, sf_dir):
    asked, corpus = _vectors(spark, sf_dir)
    return R.dense(asked, corpus, F.round(R.dot("qv", "dv"), 4), 4, ["label"], unit=True).select("q", "label", "doc", "score", "rank")


@query(f"WITH {_V} SELECT * FROM (SELECT q.vec_id AS q, v.label, v.vec_id AS doc, {_COS} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS INTEGER) AS rank FROM q JOIN v ON q.vec_id <> v.vec_id) WHERE rank <= 4")
def fanout_global_merge(spark, sf_dir):
    """The best four of each domain, merged to the best four of all."""
    return R.top(fanout_per_domain(spark, sf_dir).drop("rank"), 4, ["q"], F.desc("score"), "doc").select("q", "label", "doc", "score", "rank")


def _corpus(spark, sf_dir):
    """All documents and benchmark passages; those whose number has a vector have it."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("dv"))
    corpus = _documents(spark, sf_dir).drop("source").join(v, "doc", "left")
    return corpus, _asked(spark, sf_dir).join(v.select(F.col("doc").alias("q"), F.col("dv").alias("qv")), "q", "left")


_HYBRID = f"""{BM25_GLOBAL},
b AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM padded),
dv AS (SELECT doc_id AS doc, CAST(embedding AS DOUBLE[]) AS e FROM documents JOIN embeddings ON vec_id = doc_id), qv AS (SELECT item_id AS q, CAST(embedding AS DOUBLE[]) AS e FROM benchmark JOIN embeddings ON vec_id = item_id),
c AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY round(list_cosine_similarity(qv.e, dv.e), 4) DESC, doc) AS rank FROM qv JOIN dv ON q <> doc),
u AS (SELECT q, doc, rank, 1 AS list_no FROM b WHERE rank <= 10 UNION ALL SELECT q, doc, rank, 2 FROM c WHERE rank <= 10),
ut AS (SELECT q, u.doc, rank, list_no, coalesce(text, '') AS content FROM u JOIN documents ON doc_id = u.doc),
f AS (SELECT q, content, round(sum(0.5 / (60 + rank)), 8) AS score, min(list_no * 100 + rank) AS first, arg_min(doc, list_no * 100 + rank) AS doc FROM ut GROUP BY q, content),
r AS (SELECT q, doc, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, first, doc) AS INTEGER) AS rank FROM f) """


@query(_HYBRID + "SELECT q, doc, score, rank FROM r")
def rrf_fusion(spark, sf_dir):
    """BM25 and dense lists of ten, fused by content."""
    return search.hybrid(*_corpus(spark, sf_dir))


@query(_HYBRID + "SELECT q, doc, score, rank FROM r WHERE rank <= 5")
def hybrid_search(spark, sf_dir):
    """Both lists are ten long whatever k is; the fused list is cut to k."""
    return rrf_fusion(spark, sf_dir).where("rank <= 5")


_RERANK = f"""{_HYBRID.rstrip()}, {S.IDF.replace('n AS (SELECT count(*) AS n FROM documents)', 'nn AS (SELECT count(*) AS n FROM documents)').replace('idf AS (', 'kidf AS (', 1).replace(', n GROUP BY key', ', nn GROUP BY key')},
tk AS (SELECT q, key, count(*) AS times FROM (SELECT item_id AS q, unnest({S.keys(S.tokens('text'))}) AS key FROM benchmark) GROUP BY ALL),
tw AS (SELECT q, key, times * coalesce(idf, (SELECT greatest(ln(nn.n) + 1, 0.05) FROM nn)) AS w FROM tk LEFT JOIN kidf USING (key)),
dk AS (SELECT doc_id AS doc, list_distinct({S.keys(S.tokens('text'))}) AS ks FROM documents),
pools AS (SELECT 'default' AS preset, q, doc, rank FROM r WHERE rank <= 10 UNION ALL SELECT 'v4', q, doc, rank FROM r WHERE rank <= 20 UNION ALL SELECT 'v2', q, doc, rank FROM c WHERE rank <= 20 UNION ALL SELECT 'rerank_no_hybrid', q, doc, rank FROM c WHERE rank <= 10),
rs AS (SELECT preset, r.q, r.doc, CAST(any_value(rank) AS INTEGER) AS prior_rank, coalesce(round(sum(CASE WHEN list_contains(ks, key) THEN w ELSE 0 END) / sum(w), 6), 0) AS score FROM pools r JOIN dk USING (doc) LEFT JOIN tw ON tw.q = r.q GROUP BY preset, r.q, r.doc),
rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY preset, q ORDER BY score DESC, prior_rank) AS INTEGER) AS rank FROM rs) """


@query(_RERANK + "SELECT q, doc, prior_rank, score, rank FROM rr WHERE preset = 'default' AND rank <= 5")
def rerank_topn(spark, sf_dir):
    """The fused pool by the passage as it was asked, though the search is for a rewritten one: best first."""
    corpus, asked = _corpus(spark, sf_dir)
    idf, total = audit.key_idf(_documents(spark, sf_dir))
    rewritten = asked.select("q", F.concat("text", F.lit(" (rewritten)")).alias("text"), F.col("text").alias("original"))
    p = search.PRESETS["default"]
    pool = checkpointed(rrf_fusion(spark, sf_dir).where(F.col("rank") <= p.k))
    return search.rerank(pool, corpus, rewritten, idf, total, p.top_n)


@query(_HYBRID + "SELECT q, doc, rank FROM r WHERE rank <= 3")
def noop_trim(spark, sf_dir):
    return rrf_fusion(spark, sf_dir).where("rank <= 3").select("q", "doc", "rank")


@query(_RERANK + """, v AS (SELECT preset, q, doc, rank FROM r, (SELECT unnest(['hybrid_no_rerank', 'v3']) AS preset) WHERE rank <= 5 UNION ALL SELECT preset, q, doc, CAST(rank AS INTEGER) FROM c, (SELECT unnest(['dense_only', 'v1']) AS preset) WHERE rank <= 5
UNION ALL SELECT 'lexical', q, doc, CAST(rank AS INTEGER) FROM b WHERE rank <= 5 UNION ALL SELECT preset, q, doc, rank FROM rr WHERE rank <= 5) SELECT * FROM v""")
def search_presets(spark, sf_dir):
    """What all presets return for the same questions, from one pair of lists."""
    corpus, asked = _corpus(spark, sf_dir)
    idf, total = audit.key_idf(_documents(spark, sf_dir))
    return search.presets(corpus, asked, idf, total, list(search.PRESETS))


_FEEDBACK = BM25_GLOBAL + """,
p1 AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM padded),
sh AS (SELECT q, token, round(sum(tf / dl), 9) AS share FROM p1 JOIN tf USING (doc) WHERE rank <= 3 GROUP BY q, token),
ex AS (SELECT q, token, row_number() OVER (PARTITION BY q ORDER BY round(share * ln(n / df), 9) DESC, token) AS rank FROM sh JOIN d USING (token), stats WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.q = sh.q AND a.token = sh.token)),
asked2 AS (SELECT q, token, 2 * times AS times FROM asked UNION ALL SELECT q, token, 1 FROM ex WHERE rank <= 10),
scored2 AS (SELECT q, doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN asked2 USING (token) JOIN idf ON idf.token = tf.token GROUP BY q, doc),
padded2 AS (SELECT * FROM scored2 UNION ALL SELECT item_id, doc_id, 0.0 FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 40) WHERE NOT EXISTS (SELECT 1 FROM scored2 s WHERE s.q = item_id AND s.doc = doc_id)),
p2 AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM padded2),
u AS (SELECT q, doc, rank, 1 AS list_no FROM p1 WHERE rank <= 10 UNION ALL SELECT q, doc, rank, 2 FROM p2 WHERE rank <= 10),
p3 AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY round(sum(0.5 / (60 + rank)), 8) DESC, min(list_no * 100 + rank), doc) AS rank FROM u GROUP BY q, doc),
""" + _GOLD + """, lists AS (SELECT 'plain' AS how, * FROM p1 WHERE rank <= 5 UNION ALL SELECT 'rewritten', * FROM p2 WHERE rank <= 5 UNION ALL SELECT 'fused', * FROM p3 WHERE rank <= 5)"""


@query(_FEEDBACK + """ SELECT q, string_agg(token, ' ' ORDER BY rank) AS added FROM ex WHERE rank <= 10 GROUP BY q""")
def feedback_terms(spark, sf_dir):
    """The words that a first search adds to each passage."""
    corpus, asked = _documents(spark, sf_dir).drop("source"), _asked(spark, sf_dir)
    df = R.statistics(corpus)
    added = feedback.expansions(R.bm25_top(corpus, asked, feedback.FEEDBACK, df=df), corpus, asked, df)
    return added.groupBy("q").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), " ").alias("added"))


@query(_FEEDBACK + """, g AS (SELECT q, count(DISTINCT doc) AS n FROM gold GROUP BY q), f AS (SELECT how, q, count(DISTINCT doc) AS found FROM lists JOIN gold USING (q, doc) GROUP BY how, q)
SELECT h.how, count(n) AS n, round(avg(CASE WHEN n > 0 THEN round(coalesce(found, 0) / n, 6) END), 6) AS recall FROM (SELECT unnest(['plain', 'rewritten', 'fused']) AS how) h, benchmark LEFT JOIN g ON g.q = item_id LEFT JOIN f ON f.q = item_id AND f.how = h.how GROUP BY h.how""")
def feedback_recall(spark, sf_dir):
    """Recall at 5 of passages as asked, rewritten by the words of what they find, and of both lists fused."""
    found = feedback.search(_documents(spark, sf_dir).drop("source"), _asked(spark, sf_dir))
    gold, asked = checkpointed(_gold(spark, sf_dir)), _asked(spark, sf_dir)
    out = [R.ranking_metrics(found[how], gold, asked, 5).agg(F.count("recall").alias("n"), F.round(F.avg("recall"), 6).alias("recall")).select(F.lit(how).alias("how"), "n", "recall") for how in ("plain", "rewritten", "fused")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query()
def embedded_topk(spark, sf_dir):
    """The five nearest documents of each passage by vectors that are fitted on all documents; every document has one."""
    docs = checkpointed(embedding.counted(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")))
    model = embedding.fit(docs)
    vectors = embedding.embed(docs, model).select(F.col("id").alias("doc"), F.col("vector").alias("dv"))
    asked = embedding.embed(_asked(spark, sf_dir).withColumnRenamed("q", "id"), model, question=True).select(F.col("id").alias("q"), F.col("vector").alias("qv"))
    # passages and documents are numbered for themselves
    asked = asked.withColumn("q", -F.col("q") - 1)
    found = R.dense(asked, vectors, F.round(R.dot("qv", "dv"), 4), 5, unit=True)
    return found.select((-F.col("q") - 1).alias("q"), "doc", "score", "rank")


@query(f"WITH {_V}, n AS (SELECT q.vec_id AS q, v.label < 5 AS valid, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank FROM q JOIN v ON q.vec_id <> v.vec_id), k AS (SELECT q, floor(sum(CASE WHEN valid THEN CAST(round(score * 10000) AS BIGINT) END) / count(CASE WHEN valid THEN 1 END)) / 10000 AS v, floor(sum(CASE WHEN NOT valid THEN CAST(round(score * 10000) AS BIGINT) END) / count(CASE WHEN NOT valid THEN 1 END)) / 10000 AS i FROM n WHERE rank <= 5 GROUP BY q) SELECT q, CASE WHEN coalesce(i >= 0.3, FALSE) AND (v IS NULL OR i >= v) THEN 'invalid' ELSE 'valid' END AS intent FROM k")
def intent_gate(spark, sf_dir):
    """The gate that fails open: invalid only if the nearest utterances say so strongly enough (0.3 with these vectors)."""
    asked, corpus = _vectors(spark, sf_dir)
    near = R.dense(asked, corpus, F.round(R.dot("qv", "dv"), 4), search.NEAREST, unit=True)
    return search.gate(near.select("q", (F.col("label") < 5).alias("valid"), "score"), asked, 0.3)


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, substr(text, 1, 120) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def prefix_dedup(spark, sf_dir):
    """The first document of each source and first 120 characters."""
    return table(spark, sf_dir, "documents").groupBy("source", F.substring("text", 1, 120).alias("head")).agg(F.min("doc_id").alias("doc_id")).select("source", "doc_id")


@query("SELECT count(*) AS n FROM embeddings")
def search_count(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))


_KNN = f"""WITH {_V}, n AS (SELECT q.vec_id AS q, q.label < 5 AS truth, v.label < 5 AS valid, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank FROM q JOIN v ON q.vec_id <> v.vec_id),
k AS (SELECT q, any_value(truth) AS truth, floor(sum(CASE WHEN valid THEN CAST(round(score * 10000) AS BIGINT) END) / count(CASE WHEN valid THEN 1 END)) / 10000 AS valid_score, floor(sum(CASE WHEN NOT valid THEN CAST(round(score * 10000) AS BIGINT) END) / count(CASE WHEN NOT valid THEN 1 END)) / 10000 AS invalid_score FROM n WHERE rank <= 5 GROUP BY q) """


@query(_KNN + "SELECT q, valid_score, invalid_score, CASE WHEN invalid_score IS NULL OR valid_score > invalid_score THEN 'VALID' ELSE 'INVALID' END AS predicted FROM k")
def intent_knn_vote(spark, sf_dir):
    """Labels below 5 count as VALID; the five nearest vote by mean score, ties to INVALID."""
    asked, corpus = _vectors(spark, sf_dir)
    near = R.dense(asked, corpus, F.round(R.dot("qv", "dv"), 4), 5, unit=True)
    return R.knn_vote(near.select("q", (F.col("label") < 5).alias("valid"), "score"))


_GRID = _KNN + """, g AS (SELECT c, truth, coalesce(valid_score > invalid_score OR invalid_score IS NULL, FALSE) AND round(valid_score * 100, 2) >= c AS pred FROM k, (SELECT unnest(range(0, 81)) AS c)),
m AS (SELECT c, count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND NOT pred) AS tn, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn FROM g GROUP BY c),
s AS (SELECT CAST(c AS INTEGER) AS threshold, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS invalid_recall FROM m) """


@query(_GRID + "SELECT * FROM s")
def intent_threshold_grid(spark, sf_dir):
    """Confusion counts of the gate at every hundredth as threshold: one row a query and threshold, one aggregation."""
    truth = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("q"), (F.col("label") < 5).alias("truth"))
    votes = truth.join(R.small(intent_knn_vote(spark, sf_dir)), "q").withColumn("threshold", F.explode(F.sequence(F.lit(0), F.lit(80))))
    pred = (F.col("predicted") == "VALID") & (F.round(F.col("valid_score") * 100, 2) >= F.col("threshold"))
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    t = F.col("truth")
    m = votes.withColumn("pred", F.coalesce(pred, F.lit(False))).groupBy("threshold").agg(n(t & F.col("pred")).alias("tp"), n(~t & ~F.col("pred")).alias("tn"), n(~t & F.col("pred")).alias("fp"), n(t & ~F.col("pred")).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1 = lambda hit: ratio(2 * hit, 2 * hit + F.col("fp") + F.col("fn"))
    return m.select("*", F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 6).alias("accuracy"), F.round((f1(F.col("tp")) + f1(F.col("tn"))) / 2, 6).alias("macro_f1"), F.round(ratio(F.col("tn"), F.col("tn") + F.col("fp")), 6).alias("invalid_recall"))


@query(_GRID + "SELECT threshold, macro_f1, invalid_recall FROM s ORDER BY macro_f1 DESC, invalid_recall DESC, threshold LIMIT 1")
def intent_best_threshold(spark, sf_dir):
    return intent_threshold_grid(spark, sf_dir).orderBy(F.desc("macro_f1"), F.desc("invalid_recall"), "threshold").limit(1).select("threshold", "macro_f1", "invalid_recall")


_PAIRS = f"""WITH {_V}, p AS (SELECT q.vec_id AS a, v.vec_id AS b, CASE WHEN q.label < 5 AND v.label < 5 THEN 'V-V' WHEN q.label >= 5 AND v.label >= 5 THEN 'I-I' ELSE 'V-I' END AS kind, {_COS} AS s FROM q JOIN v ON q.vec_id <> v.vec_id AND NOT (v.vec_id % 20 = 0 AND v.vec_id < q.vec_id)) """


def _pairs(spark, sf_dir):
    """The queries, and all vectors, a pair of two queries once: kind 1 is of labels below 5, 0 of others, -1 of none."""
    asked, corpus = _vectors(spark, sf_dir)
    kind = lambda c: F.coalesce((F.col(c) < 5).cast("int"), F.lit(-1))
    return asked.select("q", "qv", kind("q_label").alias("kind")), corpus.select("doc", "dv", kind("label").alias("kind"), (F.col("doc") % 20 == 0).alias("asked"))


_KINDS = {"1-1": "V-V", "0-0": "I-I", "other": "V-I"}


@query(_PAIRS + "SELECT kind, count(*) AS n, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(coalesce(stddev_samp(s), 0), 6) AS std, min(s) AS least, max(s) AS most, round(quantile_cont(s, 0.25), 6) AS p25, round(quantile_cont(s, 0.75), 6) AS p75, round(quantile_cont(s, 0.95), 6) AS p95 FROM p GROUP BY kind")
def pair_similarity_summary(spark, sf_dir):
    """All statistics of the numbers of pairs by kind and score, of which there are few."""
    r = lambda c: F.round(c, 6)
    counts = checkpointed(pairs.pair_counts(*_pairs(spark, sf_dir)))
    kind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in _KINDS.items()))
    scored, of = F.when(F.col("s").isNotNull(), F.col("n")), Window.partitionBy("kind")
    rows = counts.select(kind.alias("kind"), "s", "n", scored.alias("m")).withColumn("mean", F.sum(F.col("s") * F.col("n")).over(of) / F.sum("m").over(of))
    spread = F.sqrt(F.try_divide(F.sum(F.pow(F.col("s") - F.col("mean"), F.lit(2.0)) * F.col("n")), F.sum("m") - 1))
    at = lambda p: r(F.percentile("s", p, F.col("n")))
    return rows.groupBy("kind").agg(F.sum("n").alias("n"), r(F.first("mean")).alias("mean"), at(0.5).alias("median"), r(F.coalesce(spread, F.lit(0.0))).alias("std"), F.min("s").alias("least"), F.max("s").alias("most"), at(0.25).alias("p25"), at(0.75).alias("p75"), at(0.95).alias("p95"))


@query(_PAIRS + "SELECT round(avg(CASE WHEN kind = 'V-V' THEN s END) - avg(CASE WHEN kind = 'V-I' THEN s END), 6) AS delta FROM p")
def similarity_delta(spark, sf_dir):
    counts = pairs.pair_counts(*_pairs(spark, sf_dir))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("s") * F.col("n"))) / F.sum(F.when((F.col("kind") == k) & F.col("s").isNotNull(), F.col("n")))
    return counts.agg(F.round(of("1-1") - of("other"), 6).alias("delta"))


@query(_PAIRS + "SELECT a, b, s FROM p WHERE kind = 'V-I' ORDER BY s DESC, a, b LIMIT 10")
def top_cross_pairs(spark, sf_dir):
    return pairs.greatest_pairs(*_pairs(spark, sf_dir), "other", 10)


_CENTROID = "WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) AS r(i) GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS centroid FROM x GROUP BY label) "


def _centroids(spark, sf_dir):
    dims = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return dims.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


@query(_CENTROID + "SELECT label, round(sqrt(list_sum(list_transform(centroid, lambda x: x * x))), 5) AS norm, round(centroid[1], 5) AS first FROM c")
def label_centroids(spark, sf_dir):
    return _centroids(spark, sf_dir).select("label", F.round(F.sqrt(R.dot("centroid", "centroid")), 5).alias("norm"), F.round(F.col("centroid")[0], 5).alias("first"))


@query(_CENTROID + """, s AS (SELECT vec_id, c.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 4) AS s FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rank, lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS next FROM s)
SELECT vec_id, CASE WHEN s < 0.3 THEN 'none' WHEN round(s - next, 4) < 0.04 THEN 'both' ELSE CAST(label AS VARCHAR) END AS route FROM r WHERE rank = 1""")
def centroid_router(spark, sf_dir):
    """The label of the nearest centroid; none if it is far, both if the next is almost as near."""
    c = _centroids(spark, sf_dir)
    s = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(R.small(c), F.lit(True)).withColumn("s", F.round(R.cosine("embedding", "centroid"), 4))
    order = Window.partitionBy("vec_id").orderBy(F.desc("s"), "label")
    best = s.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("s").over(order)).where("rank = 1")
    return best.select("vec_id", F.when(F.col("s") < 0.3, "none").when(F.round(F.col("s") - F.col("next"), 4) < 0.04, "both").otherwise(F.col("label").cast("string")).alias("route"))
