"""Curation of test questions: evidence, scores, tiers, types, quotas and near duplicates.

Benchmark passages are the questions (their first line) and answers; sentences are facts; the documents of the same number,
and of the next one for every fifth, are the gold texts, and every eleventh cites one that does not exist.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import audit
from tarn.plans import sql as S
from tarn.plans.registry import documents, query, table
from tarn.sources.shared import spread

LABELS = ["lexical_exact", "paraphrase", "semantic", "analytical", "negation_edge", "multi_chunk"]


def _cites(spark, sf_dir):
    """(id, gold_id): what a question cites."""
    extra = F.array_compact(F.array(F.col("item_id"), F.when(F.col("item_id") % 5 == 0, F.col("item_id") + 1), F.when(F.col("item_id") % 11 == 7, F.lit(-1).cast("long"))))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(extra).alias("gold_id"))


def _cases(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("gold_id"), F.col("text").alias("gold_text"))
    gold = _cites(spark, sf_dir).join(docs, "gold_id", "left").groupBy("id").agg(F.count("*").alias("n_gold"), F.sum(F.col("gold_text").isNull().cast("long")).alias("missing"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("gold_text").isNotNull(), F.struct("gold_id", "gold_text")))), lambda x: x["gold_text"]), "\n").alias("gold"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("item_id") % len(LABELS) + 1).cast("int"))
    facts = F.filter(F.split("text", r"\. "), lambda f: f != "")
    own = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.get(F.split("text", "\n"), F.lit(0)).alias("question"), F.col("text").alias("answer"), facts.alias("facts"), label.alias("label"), F.when(F.col("item_id") % 9 == 0, "both").otherwise(F.concat(F.lit("d"), (F.col("item_id") % 4).cast("string"))).alias("route"), F.when(F.col("item_id") % 5 == 0, "multi").otherwise("single").alias("scope"))
    return own.join(gold, "id")


def _idf(spark, sf_dir):
    return audit.key_idf(documents(spark, sf_dir))


_CASES = f"""cites AS (SELECT item_id AS id, unnest(list_filter([item_id, CASE WHEN item_id % 5 = 0 THEN item_id + 1 END, CASE WHEN item_id % 11 = 7 THEN -1 END], lambda x: x IS NOT NULL)) AS gold_id FROM benchmark),
gold AS (SELECT id, count(*) AS n_gold, count(*) FILTER (d.doc_id IS NULL) AS missing, coalesce(string_agg(d.text, chr(10) ORDER BY d.doc_id), '') AS gold FROM cites LEFT JOIN documents d ON d.doc_id = gold_id GROUP BY id),
cases AS (SELECT item_id AS id, string_split(text, chr(10))[1] AS question, text AS answer, list_filter(string_split(text, '. '), lambda f: f <> '') AS facts, {[*LABELS]}[item_id % 6 + 1] AS label,
  CASE WHEN item_id % 9 = 0 THEN 'both' ELSE 'd' || (item_id % 4) END AS route, CASE WHEN item_id % 5 = 0 THEN 'multi' ELSE 'single' END AS scope, n_gold, missing, gold FROM benchmark JOIN gold ON gold.id = item_id)"""
_TERMS = f"""{S.IDF}, {_CASES},
p AS (SELECT id, 'q' AS kind, 0 AS n, question AS text FROM cases UNION ALL SELECT id, 'a', 0, answer FROM cases UNION ALL SELECT id, 'f', unnest(range(0, len(facts))), unnest(facts) FROM cases),
pg AS (SELECT p.*, gold, lower(gold) AS low, list_distinct({S.keys(S.tokens('gold'))}) AS gold_keys FROM p JOIN cases USING (id)),
tk AS (SELECT *, {S.tokens('text')} AS ts FROM pg), tkk AS (SELECT *, {S.keys('ts')} AS ks FROM tk),
tr AS (SELECT id, kind, n, low, gold_keys, unnest(range(0, len(ts))) AS pos, unnest(ts) AS token, unnest(ks) AS key FROM tkk),
terms AS (SELECT id, kind, n, pos, token, coalesce(idf, (SELECT greatest(ln(n.n) + 1, 0.05) FROM n)) AS w, contains(low, token) AS exact, list_contains(gold_keys, key) AS stemmed, list_contains(gold_keys, key) OR (length(key) >= 5 AND contains(low, key)) AS held FROM tr LEFT JOIN idf USING (key)),
cov AS (SELECT id, kind, n, round(sum(CASE WHEN held THEN w ELSE 0 END) / sum(w), 6) AS coverage FROM terms GROUP BY ALL),
dt AS (SELECT id, kind, n, token, min(pos) AS pos, any_value(w) AS w, any_value(exact) AS exact, any_value(stemmed) AS stemmed FROM terms GROUP BY id, kind, n, token),
lr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, pos) AS r, count(*) OVER (PARTITION BY id) AS of_ FROM dt WHERE kind = 'q'),
lex AS (SELECT id, count(*) AS terms, round(sum(CASE WHEN exact THEN 1 WHEN stemmed THEN 0.6 ELSE 0 END) / count(*), 6) AS overlap FROM lr WHERE r <= greatest(4, least(8, of_ // 2 + 2)) GROUP BY id)"""
_CODE = S.hard_anchors("text")
_ANCHORS = f""", al AS (SELECT *, {_CODE} AS raw, {S.english('gold')} AS eng FROM pg),
al2 AS (SELECT *, {S.distinct_in_order('raw')}[:12] AS all_ FROM al), al3 AS (SELECT *, CASE WHEN eng THEN list_filter(all_, lambda v: regexp_matches(v, '[0-9@]')) ELSE all_ END AS a FROM al2),
al4 AS (SELECT *, list_transform(a, lambda v: lower(v)) AS la FROM al3), al5 AS (SELECT *, {S.keys('la')} AS lk FROM al4),
rare AS (SELECT id, kind, n, sum((exact OR stemmed)::INT) / count(*) AS rare FROM (SELECT *, row_number() OVER (PARTITION BY id, kind, n ORDER BY w DESC, pos) AS r FROM dt WHERE NOT regexp_matches(token, '^[0-9]+$')) WHERE r <= 8 GROUP BY id, kind, n),
sup AS (SELECT id, kind, n, round(CASE WHEN len(a) > 0 THEN len(list_filter(la, lambda v, i: contains(low, v) OR list_contains(gold_keys, lk[i]))) / len(a) WHEN eng THEN 1 WHEN len(all_) = 0 THEN coalesce(rare, 0) ELSE 0 END, 6) AS support FROM al5 LEFT JOIN rare USING (id, kind, n))"""
_NUM = r"""CASE WHEN len(nums) = 0 THEN 1.0 ELSE len(list_filter(nums, lambda x: list_contains(there, x))) / len(nums) END"""
_EVIDENCE = f""", ev AS (SELECT p.id, p.kind, CASE WHEN p.kind = 'f' THEN greatest(coalesce(coverage, 0), support) END AS fact, coverage, support FROM p LEFT JOIN cov USING (id, kind, n) JOIN sup USING (id, kind, n)),
es AS (SELECT id, round(coalesce(avg(fact), 0), 6) AS fact_mean, coalesce(min(fact), 0) AS fact_min, count(*) FILTER (fact < 0.45) AS n_weak, coalesce(max(coverage) FILTER (kind = 'a'), 0) AS ans_cov, coalesce(max(support) FILTER (kind = 'a'), 0) AS ans_anchor FROM ev GROUP BY id),
nu AS (SELECT id, regexp_extract_all(coalesce(answer, ''), '[0-9]+') AS all_, regexp_extract_all(gold, '[\\p{{L}}\\p{{N}}_]+') AS there FROM cases),
nv AS (SELECT id, CASE WHEN len(all_) > 2 THEN list_filter(all_, lambda x: x NOT IN ('1', '2', '3')) ELSE all_ END AS nums, there FROM nu),
e AS (SELECT c.id, c.n_gold, c.missing, len(facts) AS n_facts, {S.english('gold')} AS english, round(CASE WHEN {S.english('gold')} THEN 1.0 ELSE {_NUM} END, 6) AS ans_numbers, round({S.boilerplate('gold')}, 3) AS boilerplate,
  regexp_matches(question, {S.quoted(T.CONTEXT_REFERENCE)}) AS context_ref, regexp_matches(question, {S.quoted(T.SELF_CITING)}) AS self_cite, regexp_matches(answer, {S.quoted(T.METADATA_ONLY)}) AND NOT contains(lower(gold), 'tidak berlaku') AS metadata_only,
  len({S.tokens('question')}) AS q_len, len({S.tokens('answer')}) AS ans_len, fact_mean, fact_min, n_weak, ans_cov, ans_anchor, coalesce(round(overlap, 3), 0) AS lex_overlap, label, route, scope
  FROM cases c JOIN es USING (id) JOIN nv USING (id) LEFT JOIN lex USING (id))"""
_SCORE = """, s AS (SELECT *, 0.47 * least(fact_mean / 0.85, 1) + 0.15 * least(greatest(ans_anchor, ans_cov) / 0.85, 1) + 0.12 * ans_numbers + 0.1 * (CASE WHEN n_facts >= 2 THEN 1 WHEN n_facts = 1 THEN 0.4 ELSE 0 END) + 0.08 * least(q_len / 12.0, 1) + 0.08 * (1 - least(n_weak / 3.0, 1)) AS raw,
  list_filter([CASE WHEN missing > 0 THEN 'gold_missing' END, CASE WHEN n_gold = 0 THEN 'no_gold' END, CASE WHEN fact_mean < 0.45 THEN 'facts_ungrounded' WHEN fact_mean < 0.6 THEN 'facts_weak' END, CASE WHEN n_weak >= 2 THEN 'multi_weak_facts' END,
  CASE WHEN ans_anchor < 0.55 AND ans_cov < 0.45 AND fact_mean < 0.8 THEN 'answer_ungrounded' WHEN ans_anchor < 0.65 AND fact_mean < 0.9 THEN 'answer_partly_supported' END, CASE WHEN english THEN 'english_gold' END, CASE WHEN boilerplate >= 0.45 THEN 'boilerplate_gold' END,
  CASE WHEN metadata_only THEN 'metadata_only_answer' END, CASE WHEN context_ref THEN 'context_reference' END, CASE WHEN self_cite THEN 'self_citing' END, CASE WHEN ans_numbers < 1 THEN 'unsupported_numbers' END, CASE WHEN n_facts = 0 THEN 'no_facts' END, CASE WHEN q_len < 4 THEN 'question_too_short' END, CASE WHEN ans_len < 4 THEN 'answer_too_short' END], lambda x: x IS NOT NULL) AS f FROM e),
t AS (SELECT *, round(CASE WHEN missing > 0 OR n_gold = 0 THEN 0.2 * raw ELSE raw END, 4) AS score FROM s),
q AS (SELECT id, score, array_to_string(f, ',') AS flags, CASE WHEN list_has_any(f, ['gold_missing', 'no_gold', 'no_facts']) THEN 'unusable' WHEN list_has_any(f, ['facts_ungrounded', 'answer_ungrounded', 'multi_weak_facts', 'boilerplate_gold', 'metadata_only_answer', 'context_reference']) THEN 'problematic'
  WHEN score >= 0.88 AND len(list_filter(f, lambda x: x <> 'self_citing')) = 0 THEN 'high' WHEN score >= 0.72 THEN 'acceptable' ELSE 'problematic' END AS tier FROM t)"""


@query(f"WITH {S.IDF} SELECT key, df, round(idf, 6) AS idf FROM idf")
def corpus_idf(spark, sf_dir):
    """Rarity of stemmed keys over all documents."""
    return _idf(spark, sf_dir)[0].withColumn("idf", F.round("idf", 6))


@query(f"SELECT doc_id, array_to_string({S.stems(S.tokens('text'))}, ' ') AS stems FROM documents")
def stems(spark, sf_dir):
    """Every document as the stems of its content words."""
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.stems(T.content_tokens(F.col("text"))), " ").alias("stems"))


@query(f"WITH {_TERMS} SELECT id AS item_id, coalesce(coverage, 0) AS coverage FROM cases LEFT JOIN (SELECT * FROM cov WHERE kind = 'a') c USING (id)")
def idf_coverage(spark, sf_dir):
    """How much of each answer's rare tokens its gold texts hold, also inside words; all documents give the rarity."""
    cases = _cases(spark, sf_dir)
    rows = audit.parts(cases).where("kind = 'a'")
    return cases.select("id").join(audit.coverage(audit.term_rows(rows, *_idf(spark, sf_dir))), "id", "left").select(F.col("id").alias("item_id"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


@query(f"WITH {_TERMS} SELECT id AS item_id, terms, overlap FROM lex")
def lexical_overlap(spark, sf_dir):
    """Of each question's rarest terms, those that its gold texts hold as they are (1) or by their key (0.6)."""
    rows = audit.parts(_cases(spark, sf_dir)).where("kind = 'q'")
    return audit.lexical_overlap(audit.term_rows(rows, *_idf(spark, sf_dir))).withColumnRenamed("id", "item_id")


@query(f"WITH al AS (SELECT doc_id, {_CODE} AS raw FROM documents) SELECT doc_id, array_to_string({S.distinct_in_order('raw')}[:12], ' | ') AS anchors FROM al")
def anchors_of(spark, sf_dir):
    """Addresses, numbers and names of each text."""
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.hard_anchors(F.col("text")), " | ").alias("anchors"))


@query(f"WITH {_TERMS}{_ANCHORS} SELECT id, kind, CAST(n AS INTEGER) AS n, support FROM sup")
def anchor_support(spark, sf_dir):
    rows = audit.parts(_cases(spark, sf_dir))
    return audit.anchor_support(rows, audit.term_rows(rows, *_idf(spark, sf_dir)))


@query(f"SELECT doc_id, {S.english('text')} AS english FROM documents")
def english_flag(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.is_english(F.col("text")).alias("english"))


_FLAGGED = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Lembaran Negara. ' WHEN 1 THEN 'Berdasarkan informasi yang diberikan, ' WHEN 2 THEN 'Pasal 5 Nomor 3. (Jakarta: Penerbit, 2015). ' WHEN 3 THEN 'berstatus tidak berlaku. ' ELSE '' END || text AS t FROM documents"


@query(f"SELECT doc_id, round({S.boilerplate('t')}, 6) AS fraction, regexp_matches(t, {S.quoted(T.CONTEXT_REFERENCE)}) AS context_ref, regexp_matches(t, {S.quoted(T.SELF_CITING)}) AS self_cite, regexp_matches(t, {S.quoted(T.METADATA_ONLY)}) AS metadata_only FROM ({_FLAGGED})")
def boilerplate_fraction(spark, sf_dir):
    """Citations, references to a context, self-citing and metadata: four in five documents are given one of them."""
    given = F.element_at(F.array(*map(F.lit, ["Lembaran Negara. ", "Berdasarkan informasi yang diberikan, ", "Pasal 5 Nomor 3. (Jakarta: Penerbit, 2015). ", "berstatus tidak berlaku. ", ""])), (F.col("doc_id") % 5 + 1).cast("int"))
    t = documents(spark, sf_dir).select("doc_id", F.concat(given, "text").alias("t"))
    x = F.col("t")
    return t.select("doc_id", F.round(T.boilerplate(x), 6).alias("fraction"), x.rlike(T.CONTEXT_REFERENCE).alias("context_ref"), x.rlike(T.SELF_CITING).alias("self_cite"), x.rlike(T.METADATA_ONLY).alias("metadata_only"))


@query(r"""WITH p AS (SELECT a.doc_id, regexp_extract_all(a.text, '[0-9]+') AS n, regexp_extract_all(coalesce(b.text, ''), '[\p{L}\p{N}_]+') AS there FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1),
k AS (SELECT doc_id, CASE WHEN len(n) > 2 THEN list_filter(n, lambda x: x NOT IN ('1', '2', '3')) ELSE n END AS n, there FROM p)
SELECT doc_id, CASE WHEN len(n) = 0 THEN 1.0 ELSE round(len(list_filter(n, lambda x: list_contains(there, x))) / len(n), 6) END AS support FROM k""")
def number_support(spark, sf_dir):
    """How many of a text's numbers the next document holds as words; both texts are read whole."""
    docs = documents(spark, sf_dir)
    gold = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("gold"))
    return docs.select("doc_id", "text").join(gold, "doc_id", "left").select("doc_id", F.round(T.number_support(F.col("text"), F.col("gold")), 6).alias("support"))


_AUDIT = f"WITH {_TERMS}{_ANCHORS}{_EVIDENCE}"
_COLUMNS = ["id", "n_gold", "missing", "n_facts", "english", "ans_numbers", "boilerplate", "context_ref", "self_cite", "metadata_only", "q_len", "ans_len", "fact_mean", "fact_min", "n_weak", "ans_cov", "ans_anchor", "lex_overlap"]


def _evidence(spark, sf_dir):
    return audit.evidence(_cases(spark, sf_dir), *_idf(spark, sf_dir))


@query(f"{_AUDIT} SELECT {', '.join(_COLUMNS)} FROM e")
def evidence_audit(spark, sf_dir):
    """One wide row of evidence for each question."""
    return _evidence(spark, sf_dir).select(*_COLUMNS)


@query(f"{_AUDIT}{_SCORE} SELECT id, score, flags FROM q")
def quality_score(spark, sf_dir):
    return audit.scored(_evidence(spark, sf_dir)).select("id", "score", "flags")


@query(f"{_AUDIT}{_SCORE} SELECT id, tier FROM q")
def quality_tier(spark, sf_dir):
    return audit.scored(_evidence(spark, sf_dir)).select("id", "tier")


@query(f"""{_AUDIT} SELECT id, CASE WHEN n_gold >= 2 OR route = 'both' OR scope IN ('multi', 'cross_store') OR (label IN ('analytical', 'multi_chunk', 'cross_store', 'negation_edge') AND n_facts >= 3) THEN 'complex' WHEN lex_overlap >= 0.7 THEN 'lexical' ELSE 'semantic' END AS qtype FROM e""")
def reclassify(spark, sf_dir):
    labels = _cases(spark, sf_dir).select("id", "route", "scope", "label")
    return audit.reclassified(_evidence(spark, sf_dir).join(labels, "id"))


def _sets(spark, sf_dir, x):
    """(bucket, id, x, score) of all documents, and a function that gives those of some ids: these are picked before texts are cut."""
    rows = lambda docs: spread(docs).select(F.col("lang").alias("bucket"), F.col("doc_id").alias("id"), x.alias("x"), F.col("n_chars").alias("score"))
    docs = table(spark, sf_dir, "documents")
    return rows(docs), lambda ids: rows(docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"))


@query(f"""WITH k AS (SELECT lang, doc_id, n_chars, list_sort(list_distinct({S.keys(S.tokens('text'))})) AS x FROM documents), c AS (SELECT *, first_value(doc_id) OVER (PARTITION BY lang, x ORDER BY n_chars DESC, doc_id) AS rep FROM k WHERE len(x) > 0), k1 AS (SELECT * FROM c WHERE doc_id = rep),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, a.n_chars AS si, b.n_chars AS sj FROM k1 a JOIN k1 b ON a.lang = b.lang AND a.doc_id < b.doc_id AND 100 * least(len(a.x), len(b.x)) >= 72 * greatest(len(a.x), len(b.x))
  WHERE 100 * len(list_intersect(a.x, b.x)) >= 72 * (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x)))),
d AS (SELECT CASE WHEN si >= sj THEN j ELSE i END AS doc_id, CASE WHEN si >= sj THEN i ELSE j END AS keep, i, j FROM p),
f AS (SELECT doc_id, arg_min(keep, (i, j)) AS redundant_with FROM d GROUP BY doc_id UNION ALL SELECT doc_id, rep FROM c WHERE doc_id <> rep) SELECT doc_id, redundant_with FROM documents LEFT JOIN f USING (doc_id)""")
def redundancy_marking(spark, sf_dir):
    """Of documents of a language with equal keys the one with the best score (length) stays, the first of equal ones. Of two
    that stay whose keys are alike from 0.72 on, the lower score is redundant, the later one of equal scores; the first
    pair, in order of ids, names what it is redundant with."""
    from tarn.operators.near import near_classes

    docs = documents(spark, sf_dir)
    rows, of = _sets(spark, sf_dir, F.array_distinct(T.keys(F.array_distinct(T.content_tokens(F.col("text"))))))
    pairs, members = near_classes(rows, 72, of)
    score = docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("s"))
    scored = pairs.join(score.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(score.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    first = F.col("sa") >= F.col("sb")
    marks = scored.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("doc_id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), "a", "b")
    named = marks.groupBy("doc_id").agg(F.min_by("keep", F.struct("a", "b")).alias("redundant_with")).unionByName(members.select(F.col("id").alias("doc_id"), F.col("rep").alias("redundant_with")))
    return docs.select("doc_id").join(named, "doc_id", "left")


_LIKE = "100 * len(list_intersect(a.x, b.x)) >= 85 * (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x)))"
_SETS = r"k AS (SELECT lang, doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS x FROM documents)"


@query(f"WITH {_SETS}, c AS (SELECT lang, doc_id, x, min(doc_id) OVER (PARTITION BY lang, list_sort(x)) AS rep FROM k WHERE len(x) > 0), r AS (SELECT * FROM c WHERE doc_id = rep) SELECT a.lang, a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.x, b.x)) / (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))), 6) AS jaccard FROM r a JOIN r b ON a.lang = b.lang AND a.doc_id < b.doc_id AND 100 * least(len(a.x), len(b.x)) >= 85 * greatest(len(a.x), len(b.x)) WHERE {_LIKE} UNION ALL SELECT lang, rep, doc_id, 1.0 FROM c WHERE doc_id <> rep")
def near_duplicate_pairs(spark, sf_dir):
    """Pairs of documents of a language whose words are alike from 0.85 on; of equal sets of words the first one stands for
    all, and each other one is paired with it."""
    from tarn.operators.near import near_pairs

    rows, of = _sets(spark, sf_dir, F.array_distinct(T.words(F.col("text"))))
    return near_pairs(rows, 85, of).select(F.col("bucket").alias("lang"), "a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"""WITH RECURSIVE {_SETS}, p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.lang = b.lang AND a.doc_id < b.doc_id AND 100 * least(len(a.x), len(b.x)) >= 85 * greatest(len(a.x), len(b.x)) AND len(a.x) > 0 WHERE {_LIKE}),
o AS (SELECT b AS id, list(a) AS earlier FROM p GROUP BY b), n AS MATERIALIZED (SELECT id, earlier, row_number() OVER (ORDER BY id) AS r FROM o),
f AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT n.r, CASE WHEN len(list_filter(n.earlier, lambda x: NOT list_contains(f.gone, x))) > 0 THEN list_append(f.gone, n.id) ELSE f.gone END FROM f JOIN n ON n.r = f.r + 1),
g AS (SELECT gone FROM f ORDER BY r DESC LIMIT 1) SELECT doc_id, NOT list_contains(gone, doc_id) AS accepted FROM documents, g""")
def online_dedup(spark, sf_dir):
    """In order of ids, a document is refused if one that was accepted before is alike from 0.85 on."""
    from tarn.operators.near import accepted

    docs = documents(spark, sf_dir)
    rows, of = _sets(spark, sf_dir, F.array_distinct(T.words(F.col("text"))))
    return docs.select("doc_id").join(accepted(rows, 85, of).select(F.col("id").alias("doc_id"), "accepted"), "doc_id", "left").select("doc_id", F.coalesce("accepted", F.lit(True)).alias("accepted"))


@query("""WITH o AS (SELECT source, doc_id, n_chars >= 3000 AS long_, row_number() OVER (PARTITION BY source, n_chars >= 3000 ORDER BY md5('17:' || doc_id), doc_id) AS r FROM documents),
m AS (SELECT *, long_ AND r <= 2 AS forced FROM o), s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY forced DESC, r - CASE WHEN long_ THEN 2 ELSE 0 END, long_, r) AS n FROM m) SELECT source, doc_id, CAST(n AS INTEGER) AS n FROM s WHERE n <= 5""")
def stratified_sample(spark, sf_dir):
    """Five of each source: two long ones at least, then long and short ones in turn, in an order that seed and id decide."""
    docs = documents(spark, sf_dir).select("source", "doc_id", (F.col("n_chars") >= 3000).alias("long"))
    seeded = F.md5(F.concat(F.lit("17:"), F.col("doc_id").cast("string")))
    r = F.row_number().over(Window.partitionBy("source", "long").orderBy(seeded, "doc_id"))
    rows = docs.withColumn("r", r).where("r <= 5").withColumn("forced", F.col("long") & (F.col("r") <= 2))
    turn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("forced"), F.col("r") - F.when(F.col("long"), 2).otherwise(0), "long", "r"))
    return rows.withColumn("n", turn).where("n <= 5").select("source", "doc_id", "n")


@query("""WITH c AS (SELECT lang, doc_id, contains(lower(text), 'licen') AS neg, row_number() OVER (PARTITION BY lang ORDER BY md5('q:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
m AS (SELECT *, sum(neg::INT) OVER (PARTITION BY lang ORDER BY r) AS nr, CAST(round_even(n * 0.15, 0) AS BIGINT) AS want FROM c), a AS (SELECT *, neg AND nr <= want AS taken FROM m),
f AS (SELECT *, row_number() OVER (PARTITION BY lang, taken ORDER BY r) AS fr, CAST(round_even(n * 0.25, 0) AS BIGINT) AS a1, CAST(round_even(n * 0.25, 0) AS BIGINT) AS a2, CAST(round_even(n * 0.2, 0) AS BIGINT) AS a3, CAST(round_even(n * 0.15, 0) AS BIGINT) AS a4, count(*) FILTER (taken) OVER (PARTITION BY lang) AS got FROM a)
SELECT doc_id, CASE WHEN taken THEN 'negation_edge' WHEN fr <= a1 THEN 'lexical_exact' WHEN fr <= a1 + a2 THEN 'paraphrase' WHEN fr <= a1 + a2 + a3 THEN 'semantic' WHEN fr <= a1 + a2 + a3 + a4 THEN 'analytical' WHEN fr <= a1 + a2 + a3 + a4 + want - got THEN 'negation_edge' ELSE 'lexical_exact' END AS qtype FROM f""")
def query_type_plan(spark, sf_dir):
    """Types of questions by share of each language, halves to even, what is short filled up with the first; slots for
    limits go first to documents that state one."""
    by = Window.partitionBy("lang")
    docs = documents(spark, sf_dir).select("lang", "doc_id", F.contains(F.lower("text"), F.lit("licen")).alias("neg"))
    part = lambda f: F.bround(F.col("n") * f, 0).cast("long")
    rows = docs.withColumn("r", F.row_number().over(by.orderBy(F.md5(F.concat(F.lit("q:"), F.col("doc_id").cast("string"))), "doc_id"))).withColumn("n", F.count("*").over(by))
    rows = rows.withColumn("nr", F.sum(F.col("neg").cast("int")).over(by.orderBy("r"))).withColumn("want", part(0.15)).withColumn("taken", F.col("neg") & (F.col("nr") <= F.col("want")))
    rows = rows.withColumn("fr", F.row_number().over(Window.partitionBy("lang", "taken").orderBy("r"))).withColumn("got", F.sum(F.col("taken").cast("int")).over(by))
    ends = [part(0.25), part(0.25) + part(0.25), part(0.25) + part(0.25) + part(0.2), part(0.25) + part(0.25) + part(0.2) + part(0.15)]
    qtype = F.when(F.col("taken"), "negation_edge")
    for end, name in zip(ends, ("lexical_exact", "paraphrase", "semantic", "analytical"), strict=True):
        qtype = qtype.when(F.col("fr") <= end, name)
    return rows.select("doc_id", qtype.when(F.col("fr") <= ends[-1] + F.col("want") - F.col("got"), "negation_edge").otherwise("lexical_exact").alias("qtype"))
