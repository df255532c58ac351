"""Records of directories and permits, pages of sources, filters by rule, routes of questions, and sessions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import retrieval as R
from tarn.plans.registry import query, table
from tarn.plans.retrieval_queries import _centroids

#: Pages that are left out, and sections by the first and last page.
SKIPPED, SECTIONS = [0, 1, 5, 9], [("Preface", 2, 20), ("Part I", 21, 200), ("Part II", 201, 100_000)]
LIMITS = ["dilarang", "larangan", "sanksi", "tidak boleh", "dikecualikan", "license", "without"]


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id AS page, CASE WHEN doc_id BETWEEN 2 AND 20 THEN 'Preface' WHEN doc_id BETWEEN 21 AND 200 THEN 'Part I' WHEN doc_id BETWEEN 201 AND 100000 THEN 'Part II' ELSE 'Unknown' END AS section FROM documents WHERE doc_id NOT IN (0, 1, 5, 9)")
def tag_section(spark, sf_dir):
    """Pages that aren't skipped, with the section that holds them."""
    label = F.coalesce(*(F.when(F.col("page").between(a, b), F.lit(name)) for name, a, b in SECTIONS), F.lit("Unknown"))
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("page")).where(~F.col("page").isin(*SKIPPED)).select("page", label.alias("section"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(source || '.. ', '•', ''), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\.+$', '') AS nomor FROM documents")
def main_number(spark, sf_dir):
    """A cleaned cell without the dots at its end."""
    return _docs(spark, sf_dir).select("doc_id", F.regexp_replace(T.clean_cell(F.concat("source", F.lit(".. "))), r"\.+$", "").alias("nomor"))


@query(r"""WITH p AS (SELECT doc_id, source, lang, list_filter(string_split(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), chr(10)), lambda s: s <> '') AS l FROM documents),
c AS (SELECT *, list_transform(l, lambda s: regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS c FROM p)
SELECT doc_id, 'Permit: ' || source || chr(10) || 'Requirements:' || chr(10) || array_to_string(list_transform(c[:2], lambda s: '- ' || s), chr(10)) || chr(10) || 'Steps:' || chr(10) || array_to_string(list_transform(c, lambda s, i: i || '. ' || s), chr(10)) || CASE WHEN lang <> 'en' THEN chr(10) || 'Basis:' || chr(10) || '- ' || lang ELSE '' END || chr(10) || 'Time: ' || len(c) || ' days, valid: -' AS rendered FROM c""")
def render_permit(spark, sf_dir):
    """A permit of nested lists as one text: requirements, numbered steps, basis where there is one, and terms."""
    one = lambda s: T.trimmed(F.regexp_replace(s, r"\s+", " "))
    lines = F.transform(F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t]+", " "), "\n"), lambda s: s != ""), one)
    rows = _docs(spark, sf_dir).select("doc_id", "source", "lang", lines.alias("c"))
    steps = F.array_join(F.transform("c", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    parts = [F.concat(F.lit("Permit: "), "source"), F.lit("Requirements:"), F.array_join(F.transform(F.slice("c", 1, 2), lambda s: F.concat(F.lit("- "), s)), "\n"), F.lit("Steps:"), steps, F.when(F.col("lang") != "en", F.concat(F.lit("Basis:\n- "), "lang")), F.concat(F.lit("Time: "), F.size("c").cast("string"), F.lit(" days, valid: -"))]
    return rows.select("doc_id", F.concat_ws("\n", *parts).alias("rendered"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Handbook, p. ' || (doc_id // 10) WHEN 1 THEN 'Directory: ' || source WHEN 2 THEN 'Permit: ' || source || ' (' || lang || ')' ELSE source || ' no. ' || (doc_id % 50) || '/' || (2000 + doc_id % 20) || CASE WHEN doc_id % 3 = 0 THEN ', Pasal ' || (doc_id % 9) ELSE '' END END AS label FROM documents")
def citation_label(spark, sf_dir):
    """How a source is cited, by its domain."""
    i, s = F.col("doc_id"), lambda c: c.cast("string")
    law = F.concat("source", F.lit(" no. "), s(i % 50), F.lit("/"), s(2000 + i % 20), F.when(i % 3 == 0, F.concat(F.lit(", Pasal "), s(i % 9))).otherwise(""))
    label = F.when(i % 4 == 0, F.concat(F.lit("Handbook, p. "), s(F.expr("doc_id div 10")))).when(i % 4 == 1, F.concat(F.lit("Directory: "), "source")).when(i % 4 == 2, F.concat(F.lit("Permit: "), "source", F.lit(" ("), "lang", F.lit(")"))).otherwise(law)
    return _docs(spark, sf_dir).select("doc_id", label.alias("label"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE array_to_string(list_filter(string_split(text, '. '), lambda s: s <> ''), chr(10)) END AS flat FROM conversations")
def message_text(spark, sf_dir):
    """A message that is text, or a list of blocks whose texts are joined."""
    blocks = F.transform(F.split("text", r"\. "), lambda s: F.struct(F.lit("text").alias("type"), s.alias("text")))
    joined = F.array_join(F.filter(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), lambda s: s != ""), "\n")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.when(F.col("turn") % 2 != 0, blocks).alias("blocks"))
    return rows.select("conv_id", "turn", F.when(F.col("blocks").isNull(), F.col("text")).otherwise(joined).alias("flat"))


@query("SELECT doc_id, source = 'src7' OR " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in LIMITS) + " AS limits FROM documents")
def limit_flag(spark, sf_dir):
    """Chunks that are out of force or state a limit."""
    low = F.lower(F.coalesce("text", F.lit("")))
    test = F.coalesce(F.col("source") == "src7", F.lit(False))
    for w in LIMITS:
        test = test | F.contains(low, F.lit(w))
    return _docs(spark, sf_dir).select("doc_id", test.alias("limits"))


@query("SELECT doc_id, contains(to_json({'id': doc_id, 'q': CASE WHEN doc_id % 9 = 0 THEN 'TODO: ask' ELSE lang END}), 'TODO') AS todo FROM documents")
def todo_flag(spark, sf_dir):
    """Rows of which any field still has a placeholder."""
    row = F.to_json(F.struct(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 == 0, "TODO: ask").otherwise(F.col("lang")).alias("q")))
    return _docs(spark, sf_dir).select("doc_id", F.contains(row, F.lit("TODO")).alias("todo"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), 'licen[cs]e|copyright')")
def keyword_retrieval(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.lower(F.coalesce("text", F.lit(""))).rlike("licen[cs]e|copyright")).select("doc_id")


_PAGE = r"regexp_extract_all(html, '<p>([^<]*)</p>', 1)"


@query(rf"""WITH r AS (SELECT page_id, url, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS items, {_PAGE} AS paras, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages)
SELECT page_id, title, len(items) AS requirements, array_to_string(list_transform(paras, lambda p, i: i || '. ' || p), chr(10)) AS mechanism, regexp_extract(url, '/([0-9]+)', 1) AS number, CASE WHEN len(paras) > 0 THEN paras[-1] END AS remark FROM r""")
def permit_pages(spark, sf_dir):
    """What a permit's page says: title, requirements, the numbered steps, its number, and the last remark."""
    every = lambda p: F.regexp_extract_all("html", F.lit(p), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", every('<li><a href="[^"]*">([^<]*)</a></li>').alias("items"), every("<p>([^<]*)</p>").alias("paras"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"))
    steps = F.transform("paras", lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p))
    return rows.select("page_id", "title", F.size("items").cast("long").alias("requirements"), F.array_join(steps, "\n").alias("mechanism"), F.regexp_extract("url", "/([0-9]+)", 1).alias("number"), F.try_element_at("paras", F.lit(-1)).alias("remark"))


@query(r"""WITH l AS (SELECT page_id, page_id % 20 AS list_page, regexp_extract_all(html, '<li><a[^>]*>[^<]*</a></li>') AS cards FROM pages), n AS (SELECT list_page, sum(len(cards)) AS n FROM l GROUP BY list_page),
stop AS (SELECT coalesce(min(list_page), 15) AS stop FROM n WHERE n = 0)
SELECT page_id, CAST(i AS INTEGER) AS place, regexp_extract(cards[i], 'href="([^"]*)"', 1) AS link, regexp_extract(cards[i], '>([^<]*)</a>', 1) AS name FROM (SELECT l.*, unnest(range(1, len(cards) + 1)) AS i FROM l, stop WHERE list_page < least(stop, 15))""")
def list_cards(spark, sf_dir):
    """The cards of list pages up to the first empty one, fifteen at most; a card inside another is no card of its own."""
    pages = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 20).alias("list_page"), F.regexp_extract_all("html", F.lit("(<li><a[^>]*>[^<]*</a></li>)"), F.lit(1)).alias("cards"))
    empty = pages.groupBy("list_page").agg(F.sum(F.size("cards")).alias("n")).where("n = 0").agg(F.coalesce(F.min("list_page"), F.lit(15)).alias("stop"))
    rows = pages.join(F.broadcast(empty)).where("list_page < least(stop, 15)").select("page_id", F.posexplode("cards").alias("at", "card"))
    return rows.select("page_id", (F.col("at") + 1).alias("place"), F.regexp_extract("card", 'href="([^"]*)"', 1).alias("link"), F.regexp_extract("card", ">([^<]*)</a>", 1).alias("name"))


_LABELS = {"The": "judul", "and": "nomor", "to": "tahun", "of": "status", "Nicht": "bidang", "En": "tipe_dokumen"}


@query(r"""WITH kv AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="/([^"]*)">', 1)) AS k, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS v FROM pages),
m AS (SELECT page_id, """ + ", ".join(f"max(v) FILTER (k = '{k}') AS {c}" for k, c in _LABELS.items()) + " FROM kv GROUP BY page_id) SELECT page_id, " + ", ".join(_LABELS.values()) + " FROM pages LEFT JOIN m USING (page_id)")
def detail_fields(spark, sf_dir):
    """Key and value rows of a page as columns, by a map of labels; other keys are left out."""
    every = lambda p: F.regexp_extract_all("html", F.lit(p), F.lit(1))
    pairs = F.arrays_zip(every('<li><a href="/([^"]*)">').alias("k"), every('<li><a href="[^"]*">([^<]*)</a>').alias("v"))
    value = lambda k: F.array_max(F.transform(F.filter("kv", lambda x: x["k"] == k), lambda x: x["v"]))
    return table(spark, sf_dir, "pages").select("page_id", pairs.alias("kv")).select("page_id", *(value(k).alias(c) for k, c in _LABELS.items()))


@query("SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN 'perda' WHEN 1 THEN 'perbup' ELSE substr(source || ' of an unknown kind', 1, 20) END) || '-' || coalesce(CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) END, nullif(regexp_extract('/x/' || CASE WHEN doc_id % 5 = 0 THEN 'no' || doc_id ELSE '' END, 'no([0-9]+)', 1), ''), substr(md5('/x/' || doc_id), 1, 8)) AS built FROM documents")
def build_id(spark, sf_dir):
    """A type looked up, else its first twenty characters; then the number given, else that of the address, else its hash."""
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    kind = F.when(i % 4 == 0, "perda").when(i % 4 == 1, "perbup").otherwise(F.substring(F.concat("source", F.lit(" of an unknown kind")), 1, 20))
    url = F.concat(F.lit("/x/"), F.when(i % 5 == 0, F.concat(F.lit("no"), s)).otherwise(""))
    number = F.coalesce(F.when(i % 3 == 0, s), F.nullif(F.regexp_extract(url, "no([0-9]+)", 1), F.lit("")), F.substring(F.md5(F.concat(F.lit("/x/"), s)), 1, 8))
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lower(kind), F.lit("-"), number).alias("built"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')), '[^a-z0-9_\s\-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g') AS slug FROM documents")
def slugify(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query("SELECT source AS doc, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS n_pages, CASE WHEN floor(sum(n_chars) / count(*)) < 300 THEN 'scan_or_partial' END AS skipped FROM (SELECT source || '/' || (doc_id % 50) AS source, n_chars FROM documents) GROUP BY source")
def usability_filter(spark, sf_dir):
    """Documents with fewer than 300 characters a page are skipped, with the reason."""
    doc = F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("doc")
    per = _docs(spark, sf_dir).select(doc, "n_chars").groupBy("doc").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n_pages"))
    return per.select("*", F.when(F.floor(F.col("chars") / F.col("n_pages")) < 300, "scan_or_partial").alias("skipped"))


@query("SELECT doc_id, concat_ws(', ', 'source=' || source, CASE WHEN lang <> 'en' THEN 'lang=' || lang END) AS metadata, CASE doc_id % 4 WHEN 0 THEN 'Ask one question that this passage answers.' WHEN 1 THEN 'Ask one question that needs several of these passages.' WHEN 2 THEN 'Ask one question across both sources.' ELSE 'Ask one question that no source answers.' END || chr(10) || CASE WHEN doc_id % 4 = 3 THEN '' ELSE '[' || source || '] ' || coalesce(text, '') END AS prompt FROM documents")
def render_prompt(spark, sf_dir):
    """The prompts for single, multi, cross and none, with the passage whole."""
    line = F.concat_ws(", ", F.concat(F.lit("source="), "source"), F.when(F.col("lang") != "en", F.concat(F.lit("lang="), "lang")))
    k = F.col("doc_id") % 4
    ask = F.when(k == 0, "Ask one question that this passage answers.").when(k == 1, "Ask one question that needs several of these passages.").when(k == 2, "Ask one question across both sources.").otherwise("Ask one question that no source answers.")
    body = F.when(k == 3, "").otherwise(F.concat(F.lit("["), "source", F.lit("] "), F.coalesce("text", F.lit(""))))
    return _docs(spark, sf_dir).select("doc_id", line.alias("metadata"), F.concat(ask, F.lit("\n"), body).alias("prompt"))


# --- questions: rewriting, routing, what was decided, how it is returned ---


@query("SELECT item_id AS q, text AS original, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN 'A passage that answers: ' || text ELSE text || ' ' || text END AS query, CASE item_id % 3 WHEN 0 THEN 'passthrough' WHEN 1 THEN 'hyde' ELSE 'multiquery' END AS rewriter, 1 + CASE WHEN item_id % 3 <> 0 AND item_id % 5 <> 0 THEN 1 ELSE 0 END AS llm_calls, CASE WHEN item_id % 5 = 0 THEN 'INVALID' WHEN item_id % 7 = 0 THEN 'NONE' ELSE 'COMBINED' END AS prompt FROM benchmark")
def rewrite_stage(spark, sf_dir):
    """Questions as they are, or made into a passage, with the original kept; the calls this takes, and the prompt it ends in."""
    i = F.col("item_id")
    text = F.when(i % 3 == 0, F.col("text")).when(i % 3 == 1, F.concat(F.lit("A passage that answers: "), "text")).otherwise(F.concat("text", F.lit(" "), "text"))
    kind = F.when(i % 3 == 0, "passthrough").when(i % 3 == 1, "hyde").otherwise("multiquery")
    calls = 1 + ((i % 3 != 0) & (i % 5 != 0)).cast("int")
    prompt = F.when(i % 5 == 0, "INVALID").when(i % 7 == 0, "NONE").otherwise("COMBINED")
    return table(spark, sf_dir, "benchmark").select(i.alias("q"), F.col("text").alias("original"), text.alias("query"), kind.alias("rewriter"), calls.alias("llm_calls"), prompt.alias("prompt"))


@query("""SELECT conv_id, turn, coalesce(CASE WHEN json_valid(s) THEN CASE WHEN json_extract_string(s, '$.route') IN ('dukcapil', 'opd', 'both', 'none') THEN json_extract_string(s, '$.route') END END, 'none') AS route
FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '{"route": "opd"}' WHEN 1 THEN '{"route": "both", "why": 1}' WHEN 2 THEN '{"route": "mars"}' WHEN 3 THEN 'not json' ELSE '{"why": 2}' END AS s FROM conversations)""")
def parsed_route(spark, sf_dir):
    """The route that a reply names; none if it can't be read or names no store."""
    t = F.col("turn") % 5
    said = F.when(t == 0, '{"route": "opd"}').when(t == 1, '{"route": "both", "why": 1}').when(t == 2, '{"route": "mars"}').when(t == 3, "not json").otherwise('{"why": 2}')
    route = F.get_json_object(said, "$.route")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.when(route.isin("dukcapil", "opd", "both", "none"), route), F.lit("none")).alias("route"))


_ROUTED = """WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) AS r(i) GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS centroid FROM x GROUP BY label),
q AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q, label, e, round(list_cosine_similarity(e, centroid), 4) AS s FROM q, c), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, label) AS k FROM s),
w AS (SELECT a.q, a.e, CASE WHEN a.s < 0.3 THEN [] WHEN round(a.s - b.s, 4) < 0.04 THEN [a.label, b.label] ELSE [a.label] END AS stores FROM r a JOIN r b ON b.q = a.q AND b.k = 2 WHERE a.k = 1),
f AS (SELECT w.q, v.label, v.vec_id AS doc, round(list_cosine_similarity(w.e, v.e), 4) AS score FROM w JOIN v ON list_contains(stores, v.label) AND v.vec_id <> w.q)
SELECT q, label, doc, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q, label ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= 4"""


@query(_ROUTED)
def route_and_retrieve(spark, sf_dir):
    """One decision, then one search in each store it names: nothing for a far question, two stores for a close call."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    near = asked.join(R.small(_centroids(spark, sf_dir))).withColumn("s", F.round(R.cosine("qv", "centroid"), 4))
    order = Window.partitionBy("q").orderBy(F.desc("s"), "label")
    best = near.withColumn("k", F.row_number().over(order)).withColumn("s2", F.lead("s").over(order)).withColumn("l2", F.lead("label").over(order)).where("k = 1")
    stores = F.when(F.col("s") < 0.3, F.array().cast("array<int>")).when(F.round(F.col("s") - F.col("s2"), 4) < 0.04, F.array("label", "l2")).otherwise(F.array("label"))
    routed = best.select("q", "qv", F.explode(stores).alias("label"))
    docs = v.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("dv"), "label")
    pairs = docs.join(R.small(routed), "label").where("q <> doc").withColumn("score", F.round(R.cosine("qv", "dv"), 4))
    return R.top(pairs.drop("qv", "dv"), 4, ["q", "label"], F.desc("score"), "doc").select("q", "label", "doc", "score", "rank")


@query("SELECT conv_id, max(turn) AS turns, struct_pack(intent := CASE WHEN conv_id % 5 = 0 THEN 'invalid' ELSE 'valid' END, iterations := count(*)).intent AS intent, count(*) AS iterations, string_agg(DISTINCT role, ',' ORDER BY role) AS sources, CASE WHEN count(DISTINCT role) = 1 THEN min(role) ELSE 'both' END AS route FROM conversations GROUP BY conv_id")
def flattened_result(spark, sf_dir):
    """A result with its nested decisions as plain columns, old names beside new ones."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"), F.count("*").alias("n"), F.array_sort(F.collect_set("role")).alias("roles"))
    nested = rows.select("conv_id", "turns", F.struct(F.when(F.col("conv_id") % 5 == 0, "invalid").otherwise("valid").alias("intent"), F.col("n").alias("iterations"), F.col("roles").alias("routing")).alias("decisions"))
    routing = F.col("decisions.routing")
    return nested.select("conv_id", "turns", "decisions.intent", "decisions.iterations", F.array_join(routing, ",").alias("sources"), F.when(F.size(routing) == 1, routing[0]).otherwise("both").alias("route"))


@query("SELECT item_id AS id, CASE WHEN item_id % 4 = 0 THEN 'both' ELSE 'd' || (item_id % 4) END AS route, coalesce(CASE WHEN item_id % 3 <> 2 THEN CASE item_id % 3 WHEN 0 THEN 'easy' ELSE 'hard' END END, 'medium') AS difficulty, length(text) > 20 AND item_id % 9 <> 0 AND item_id % 6 <> 0 AS valid FROM benchmark")
def built_questions(spark, sf_dir):
    """Questions made of replies: kept if question, answer and facts are there; the difficulty is medium where it is none."""
    i = F.col("item_id")
    said = F.when(i % 3 == 0, "easy").when(i % 3 == 1, "hard")
    question, answer, facts = F.col("text"), F.when(i % 9 != 0, F.col("text")), F.when(i % 6 != 0, F.array("text")).otherwise(F.array().cast("array<string>"))
    ok = F.coalesce(F.length(question) > 20, F.lit(False)) & answer.isNotNull() & (F.size(facts) > 0)
    return table(spark, sf_dir, "benchmark").select(i.alias("id"), F.when(i % 4 == 0, "both").otherwise(F.concat(F.lit("d"), (i % 4).cast("string"))).alias("route"), F.coalesce(F.when(said.isin("easy", "medium", "hard"), said), F.lit("medium")).alias("difficulty"), ok.alias("valid"))


@query("SELECT source AS doc, min(doc_id) AS first_page, count(*) AS pages, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def grouped_pages(spark, sf_dir):
    """Pages by document, with the metadata of the first one."""
    return _docs(spark, sf_dir).groupBy(F.col("source").alias("doc")).agg(F.min("doc_id").alias("first_page"), F.count("*").alias("pages"), F.min_by("lang", "doc_id").alias("lang"))


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS q, v.vec_id AS doc, round(list_cosine_similarity(q.e, v.e), 4) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 4) DESC, v.vec_id) AS rank FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) SELECT q, max(s) AS confidence, string_agg('[' || rank || '] ' || substr(coalesce(text, ''), 1, 300), chr(10) ORDER BY rank) AS answer, count(*) AS sources FROM s LEFT JOIN documents ON doc_id = doc WHERE rank <= 3 AND s >= 0.2 GROUP BY q")
def cited_answer(spark, sf_dir):
    """An answer that quotes the start of each source that is near enough, with the greatest likeness as its confidence."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    near = R.dense(asked, v.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("dv")), F.round(R.dot("qv", "dv"), 4), 3, unit=True).where("score >= 0.2")
    texts = _docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("head"))
    rows = near.join(texts, "doc", "left").withColumn("line", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("head", F.lit(""))))
    return rows.groupBy("q").agg(F.max("score").alias("confidence"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("answer"), F.count("*").alias("sources"))


# --- sessions ---


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session, ts FROM g), e AS (SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first, max(ts) AS last FROM s GROUP BY 1, 2)
SELECT a.user_id, a.session, count(b.user_id) AS open_then FROM e a LEFT JOIN e b ON (b.user_id <> a.user_id OR b.session <> a.session) AND b.first <= a.first AND b.last >= a.first - INTERVAL 1 HOUR GROUP BY a.user_id, a.session HAVING count(b.user_id) < 200""")
def admitted_sessions(spark, sf_dir):
    """Sessions that find fewer than 200 others alive when they start: those that evict nobody. Starts and ends are counted along
    time: by minute for all minutes before, row by row within one, so no session is compared with another."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(by) <= F.expr("INTERVAL 1 HOUR"), 0).otherwise(1)
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", new.alias("new")).withColumn("session", F.sum("new").over(by))
    ends = rows.groupBy("user_id", "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    mark = lambda at, begins: F.struct(at.alias("at"), F.lit(begins).alias("begins"))
    marks = ends.select("user_id", "session", F.explode(F.array(mark(F.col("first"), 1), mark(F.col("last") + F.expr("INTERVAL 1 HOUR"), 0))).alias("m"))
    marks = marks.select("user_id", "session", "m.*", F.date_trunc("minute", "m.at").alias("minute"), (2 * F.col("m.begins") - 1).alias("step"))
    minutes = marks.groupBy("minute").agg(F.sum("step").alias("sum"))
    upto = Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)  # one row a minute
    before = minutes.select("minute", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("before"))
    # a session that ends where another starts is still alive then: starts count first, and equal ones together
    within = F.sum("step").over(Window.partitionBy("minute").orderBy("at", F.desc("begins")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = marks.withColumn("within", within).where("begins = 1").join(before, "minute")
    return counted.select("user_id", "session", (F.col("before") + F.col("within") - 1).alias("open_then")).where("open_then < 200")


@query("SELECT conv_id, turn, (SELECT count(*) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.role <> 'system') AS kept, (SELECT string_agg(role, ',' ORDER BY turn) FROM (SELECT * FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.role <> 'system' ORDER BY turn DESC LIMIT 4)) AS last_roles FROM conversations c WHERE role = 'user'")
def session_history(spark, sf_dir):
    """What a session remembers when a question comes: the turns that succeeded, of which the last four are shown."""
    ok = F.col("role") != "system"
    by = Window.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").withColumn("nth", F.sum(F.when(ok, 1).otherwise(0)).over(by.orderBy("turn")))
    # a user's turn is one that succeeds itself: the four before it are those numbered just below
    rows = rows.withColumn("shown", F.collect_list(F.when(ok, F.col("role"))).over(by.orderBy("nth").rangeBetween(-4, -1)))
    return rows.where("role = 'user'").select("conv_id", "turn", (F.col("nth") - 1).cast("long").alias("kept"), F.when(F.size("shown") > 0, F.array_join("shown", ",")).alias("last_roles"))
