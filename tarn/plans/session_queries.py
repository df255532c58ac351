"""The bounded session store over the events, tables that are checked as they are read, results that are saved in batches, and
rounds of tool calls."""

from pyspark.sql import functions as F

from tarn.operators import audit, guards, session_store, tools
from tarn.plans import sql as S
from tarn.plans.registry import documents, query, table
from tarn.plans.retrieval_queries import BM25_LOCAL
from tarn.sources.shared import checkpointed, folder
from tarn.streaming import results


def _store_sql(key: str, ttl: str, most: int) -> str:
    """A session is open if it was used within the time to live and fewer than `most` others were used since then."""
    return f"""WITH e AS MATERIALIZED (SELECT event_id AS event, {key} AS id, ts, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
p AS MATERIALIZED (SELECT *, lag(n) OVER w AS pn, lag(ts) OVER w AS pts, coalesce(lead(n) OVER w, 9223372036854775807) AS nn FROM e WINDOW w AS (PARTITION BY id ORDER BY n)),
alive AS (SELECT p.n, q.id, row_number() OVER (PARTITION BY p.n ORDER BY q.n DESC) AS rank FROM p JOIN p AS q ON q.n <= p.n AND q.nn > p.n AND q.ts >= p.ts - INTERVAL {ttl}),
size AS (SELECT n, count(*) AS n_alive, max(id) FILTER (rank = {most + 1}) AS next FROM alive GROUP BY n),
since AS (SELECT p.n, count(*) AS others FROM p JOIN p AS q ON q.n > p.pn AND q.n < p.n AND coalesce(q.pn, 0) < p.pn GROUP BY p.n),
k AS (SELECT p.event, p.id, coalesce(p.ts - p.pts <= INTERVAL {ttl} AND coalesce(others, 0) < {most}, false) AS known, next, n_alive FROM p JOIN size USING (n) LEFT JOIN since USING (n))
SELECT event, id, known, CASE WHEN NOT known THEN next END AS evicted, least(n_alive, {most}) AS open FROM k"""


@query(_store_sql("CAST(user_id AS VARCHAR)", "1 HOUR", session_store.MOST))
def session_uses(spark, sf_dir):
    """Every event as a use of its user's session: whether that was open, which one went for it, how many are open."""
    events = table(spark, sf_dir, "events")
    return session_store.replayed(events.select(F.col("event_id").alias("event"), F.col("user_id").cast("string").alias("id"), "ts"))


@query(_store_sql("user_id || '/' || event_type", "30 DAYS", session_store.MOST))
def session_evictions(spark, sf_dir):
    """Sessions of users and kinds of events that are kept for a month, so that the limit is what closes them."""
    events = table(spark, sf_dir, "events")
    id_ = F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type")
    return session_store.replayed(events.select(F.col("event_id").alias("event"), id_.alias("id"), "ts"), ttl=30 * 86400.0)


@query("SELECT item_id, CAST(row_number() OVER () - 1 AS BIGINT) AS ordinal FROM benchmark")
def file_order(spark, sf_dir):
    """The passages with their places in the file."""
    return guards.in_file_order(table(spark, sf_dir, "benchmark")).select("item_id", "ordinal")


@query("SELECT l.doc_id, l.quality, l.toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id)")
def guarded_labels(spark, sf_dir):
    """Labels with the documents that they are of; an unknown or repeated id would abort."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return guards.scored_with_tests(labels, docs, "doc_id")[0].select("doc_id", "quality", "toxic", "n_chars")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def tests_without_result(spark, sf_dir):
    """Documents without a label, reported beside the guarded join."""
    return guards.scored_with_tests(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id"), "doc_id")[1].select("doc_id")


@query("SELECT CAST(conv_id AS VARCHAR) || '/' || turn AS id, text AS question, role AS label FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def validated_questions(spark, sf_dir):
    """All turns as a set of questions, validated as it is read: ids there and unique, no question blank."""
    rows = table(spark, sf_dir, "conversations").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    id_ = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return guards.question_set(rows.select(id_.alias("id"), F.col("text").alias("question"), F.col("role").alias("label")))


@query("SELECT doc_id, doc_id < vec_n AS cached, CASE WHEN doc_id < vec_n THEN CAST(e[1] AS DOUBLE) END AS first FROM documents LEFT JOIN (SELECT vec_id, embedding AS e FROM embeddings) ON vec_id = doc_id, (SELECT max(vec_id) + 1 AS vec_n FROM embeddings)")
def vector_cache(spark, sf_dir):
    """Documents looked up in a cache of vectors by model, dimensions, id and whole text; vectors of other dimensions abort."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    held = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")
    cache = held.select(guards.cache_key("given", 64, F.col("id"), F.col("text")).alias("key"), "vector")
    hits, rest = guards.cached_vectors(docs, cache, "given", 64)
    out = hits.select(F.col("id").alias("doc_id"), F.lit(True).alias("cached"), F.col("vector")[0].cast("double").alias("first"))
    return out.unionByName(rest.select(F.col("id").alias("doc_id"), F.lit(False).alias("cached"), F.lit(None).cast("double").alias("first")))


@query("SELECT doc_id AS id, source, CAST(row_number() OVER (ORDER BY CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END, CASE WHEN l.doc_id IS NULL THEN 0 ELSE -l.doc_id END, doc_id) AS BIGINT) AS place FROM documents LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id)")
def saved_results(spark, sf_dir):
    """Documents as results: saved in batches, the second of which is tried twice and overlaps the first, read back in the order of
    a test set (labels, last first), those without a test last."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    out = folder(spark, "results")
    results.save_batch(docs.where("id % 3 < 2"), 0, out)
    for _ in range(2):
        results.save_batch(docs.where("id % 3 > 0"), 1, out)
    tests = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.lit(10**9) - F.col("doc_id")).alias("ordinal"))
    rows = checkpointed(results.saved(spark, out, "id long, source string"))
    results.delete(spark, out)
    return results.in_order(rows, tests).select("id", "source", "place")


_TOOLS = f"""{BM25_LOCAL},
pool AS (SELECT q, source, doc, rank FROM (SELECT q, source, doc, row_number() OVER (PARTITION BY q, source ORDER BY score DESC, doc) AS rank FROM padded) WHERE rank <= 10),
{S.IDF.replace('n AS (SELECT count(*) AS n FROM documents)', 'nn AS (SELECT count(*) AS n FROM documents)').replace('idf AS (', 'kidf AS (', 1).replace(', n GROUP BY key', ', nn GROUP BY key')},
tk AS (SELECT q, key, count(*) AS times FROM (SELECT item_id AS q, unnest({S.keys(S.tokens('text'))}) AS key FROM benchmark) GROUP BY ALL),
tw AS (SELECT q, key, times * coalesce(idf, (SELECT greatest(ln(nn.n) + 1, 0.05) FROM nn)) AS w FROM tk LEFT JOIN kidf USING (key)),
calls AS (SELECT item_id AS q, 1 AS round, 'src' || length(text) % 25 AS domain FROM benchmark UNION ALL SELECT item_id, 2, 'src' || length(text) % 7 FROM benchmark),
cp AS (SELECT pool.*, round FROM pool JOIN calls c ON c.q = pool.q AND c.domain = source),
dk AS (SELECT doc_id AS doc, list_distinct({S.keys(S.tokens('text'))}) AS ks FROM documents WHERE doc_id IN (SELECT doc FROM cp)),
sc AS (SELECT cp.round, cp.q, cp.source, cp.doc, any_value(rank) AS prior, coalesce(round(sum(CASE WHEN list_contains(ks, key) THEN w ELSE 0 END) / sum(w), 6), 0) AS score FROM cp JOIN dk USING (doc) LEFT JOIN tw ON tw.q = cp.q GROUP BY cp.round, cp.q, cp.source, cp.doc),
kept AS (SELECT *, row_number() OVER (PARTITION BY round, q, source ORDER BY score DESC, prior) AS r FROM sc QUALIFY r <= 5),
f AS (SELECT round, q, source, count(*) AS n_docs, round(max(score), 3) AS top_score, max(score) < 0.3 AS weak, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY r) AS docs FROM kept GROUP BY round, q, source),
a AS (SELECT c.round, c.q, 'search_' || domain AS tool, coalesce(n_docs, 0) AS n_docs, top_score, weak, CASE WHEN f.q IS NULL THEN 'unknown_tool' END AS error, coalesce(docs, '') AS docs FROM calls c LEFT JOIN f ON f.q = c.q AND f.round = c.round AND f.source = domain)
SELECT CAST(round AS INTEGER) AS round, q, tool, n_docs, top_score, weak, error, docs FROM a WHERE round = 1 OR q IN (SELECT q FROM a WHERE round = 1 AND coalesce(weak, true))"""


@query(_TOOLS)
def tool_rounds(spark, sf_dir):
    """Each passage calls the search of one domain, which may not be there; where that is weak or fails, that of another."""
    corpus = documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), "text", F.col("source").alias("domain"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")
    call = lambda n: items.select("q", F.concat(F.lit("search_src"), (F.length("text") % n).cast("string")).alias("tool"), "text")
    return tools.rounds(call(25), call(7), corpus, *audit.key_idf(documents(spark, sf_dir)))
