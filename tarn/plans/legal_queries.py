"""Chunking of regulations and of questions and answers.

The documents have no such headings; a fixed rule gives them some, here and in the twins: every third one becomes a regulation
whose lines are articles, with citations before the decision and an explanation behind, and every third one the same with
its lines lost. Questions and answers are made of all documents, a numbered question a line.
"""

from pyspark.sql import functions as F

from tarn.operators import legal as L
from tarn.plans.registry import query, table
from tarn.plans.sql import quoted


def _regulations(spark, sf_dir):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    article = lambda l, i: F.concat(F.lit("Pasal "), F.when(i % 5 == 4, F.lit(2)).otherwise(i + 1).cast("string"), F.lit("\n"), l)
    body = F.array_join(F.transform(lines, article), "\n")
    first = lambda n, i: F.concat(F.lit(f"\nPasal {n}\n"), F.coalesce(F.get(lines, F.lit(i)), F.lit("-")))
    text = F.concat(F.lit("PERATURAN\nPasal 18 ayat satu\nMEMUTUSKAN:\nsebagaimana dimaksud dalam Pasal 1 lama\n"), body, F.lit("\nPENJELASAN ATAS\numum"), first(1, 0), first(3, 1), first(2, 2))
    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, text).when(kind == 1, F.replace(text, F.lit("\n"), F.lit(" "))).otherwise(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("text"), (kind == 1).alias("spaced"))


_LINES = "string_split(coalesce(text, ''), chr(10))"
_FIRST = lambda n, i: f"chr(10) || 'Pasal {n}' || chr(10) || coalesce({_LINES}[{i}], '-')"
_REG = f"""x AS (SELECT doc_id AS id, doc_id % 3 AS kind, coalesce(text, '') AS plain, 'PERATURAN' || chr(10) || 'Pasal 18 ayat satu' || chr(10) || 'MEMUTUSKAN:' || chr(10) || 'sebagaimana dimaksud dalam Pasal 1 lama' || chr(10) ||
  array_to_string(list_transform({_LINES}, lambda l, i: 'Pasal ' || CASE WHEN (i - 1) % 5 = 4 THEN 2 ELSE i END || chr(10) || l), chr(10)) || chr(10) || 'PENJELASAN ATAS' || chr(10) || 'umum' || {_FIRST(1, 1)} || {_FIRST(3, 2)} || {_FIRST(2, 3)} AS t FROM documents),
reg AS (SELECT id, kind = 1 AS spaced, CASE kind WHEN 0 THEN t WHEN 1 THEN replace(t, chr(10), ' ') ELSE plain END AS text FROM x)"""


def _found(name: str, source: str, pattern: str) -> str:
    """(id, text, i, at, f): all matches of a pattern with their places."""
    p = quoted(pattern)
    return f"""{name}_l AS (SELECT id, text, regexp_extract_all(text, {p}) AS f, regexp_split_to_array(text, {p}) AS g FROM {source}),
{name}_u AS (SELECT id, text, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS f, unnest(g[:len(f)]) AS gap FROM {name}_l),
{name} AS (SELECT id, text, i, f, CAST(sum(length(gap)) OVER (PARTITION BY id ORDER BY i) + coalesce(sum(length(f)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS at_ FROM {name}_u)"""


_SECTIONS = f"""sec AS (SELECT id, text, CASE WHEN regexp_matches(text, {quoted(L.EXPLANATION)}) THEN length(regexp_split_to_array(text, {quoted(L.EXPLANATION)})[1]) END AS pj,
  CASE WHEN regexp_matches(text, {quoted(L.DECISION)}) THEN length(regexp_split_to_array(text, {quoted(L.DECISION)})[1]) + 10 ELSE 0 END AS body FROM reg)"""
_LINE = f"""{_found('lm', '(SELECT * FROM reg WHERE NOT spaced)', L.LINE_HEADING)},
lc AS (SELECT lm.id, at_, CAST(regexp_extract(f, '[0-9]+') AS BIGINT) AS n, CASE WHEN at_ >= pj THEN 'penjelasan' ELSE 'batang' END AS section, body FROM lm JOIN sec USING (id)),
lh AS (SELECT id, at_, n, section FROM (SELECT *, coalesce(max(n) OVER (PARTITION BY id, section ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM lc WHERE NOT (body > 0 AND section = 'batang' AND at_ < body)) WHERE n > top)"""
_INLINE = f"""{_found('im', '(SELECT * FROM reg WHERE spaced)', L.ANY_HEADING)},
ic AS MATERIALIZED (SELECT id, at_, n, section, row_number() OVER (PARTITION BY id, section ORDER BY at_) AS r FROM (SELECT im.id, at_, CAST(regexp_extract(f, '[0-9]+') AS BIGINT) AS n, CASE WHEN at_ >= pj THEN 'penjelasan' ELSE 'batang' END AS section, body, substr(im.text, greatest(at_ - 25, 0) + 1, least(at_, 25)) AS pre FROM im JOIN sec USING (id))
  WHERE NOT (section = 'batang' AND at_ < body) AND NOT regexp_matches(pre, {quoted(L.MENTION)})),
fold AS (SELECT id, section, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS last, CAST(0 AS INTEGER) AS at_, false AS kept FROM (SELECT DISTINCT id, section FROM ic) UNION ALL SELECT fold.id, fold.section, ic.r, CASE WHEN ic.n > last AND ic.n <= last + 3 THEN ic.n ELSE last END, ic.at_, ic.n > last AND ic.n <= last + 3 FROM fold JOIN ic ON ic.id = fold.id AND ic.section = fold.section AND ic.r = fold.r + 1),
ih AS (SELECT id, at_, last AS n, section FROM fold WHERE kept)"""
_HEADS = f"WITH RECURSIVE {_REG}, {_SECTIONS}, {_LINE}, {_INLINE}, h AS (SELECT * FROM lh UNION ALL SELECT * FROM ih)"
_GATE = ", gate AS (SELECT id FROM h WHERE section = 'batang' GROUP BY id HAVING count(*) >= 2 AND arg_min(n, at_) <= 5)"


@query(f"WITH {_REG}, {_SECTIONS} SELECT id, CAST(pj AS INTEGER) AS pj, CAST(body AS INTEGER) AS body FROM sec")
def section_bounds(spark, sf_dir):
    """Where the explanation of a regulation starts and its decision ends."""
    return L.sectioned(_regulations(spark, sf_dir)).select("id", "pj", "body")


@query(f"WITH {_REG}, {_SECTIONS}, {_LINE} SELECT id, at_ AS start, n, section FROM lh")
def line_headings(spark, sf_dir):
    return L.line_headings(_regulations(spark, sf_dir).where("not spaced")).withColumnRenamed("at", "start")


@query(f"WITH RECURSIVE {_REG}, {_SECTIONS}, {_INLINE} SELECT id, at_ AS start, n, section FROM ih")
def inline_headings(spark, sf_dir):
    return L.inline_headings(_regulations(spark, sf_dir).where("spaced")).withColumnRenamed("at", "start")


@query(f"{_HEADS}{_GATE} SELECT id FROM gate")
def regulation_gate(spark, sf_dir):
    return L.regulations(_regulations(spark, sf_dir))


@query(f"""{_HEADS}{_GATE}, hh AS (SELECT h.* FROM h JOIN gate USING (id)), nx AS (SELECT *, lead(at_) OVER (PARTITION BY id ORDER BY at_) AS next FROM hh),
own AS (SELECT id, CASE section WHEN 'batang' THEN 'pasal' ELSE 'penjelasan_pasal' END AS chunk_type, n, at_ AS s, CASE WHEN section = 'batang' AND coalesce(next, length(text)) > pj THEN pj ELSE coalesce(next, length(text)) END AS e, text FROM nx JOIN sec USING (id)),
pre AS (SELECT id, CASE section WHEN 'batang' THEN 'preamble' ELSE 'penjelasan_preamble' END AS chunk_type, CAST(NULL AS BIGINT) AS n, CASE section WHEN 'batang' THEN 0 ELSE any_value(pj) END AS s, min(at_) AS e, any_value(text) AS text FROM hh JOIN sec USING (id) GROUP BY id, section),
cut AS (SELECT id, chunk_type, n, regexp_replace(substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), '^\\s+|\\s+$', '', 'g') AS chunk FROM (SELECT * FROM own UNION ALL SELECT * FROM pre WHERE s IS NOT NULL)) SELECT * FROM cut WHERE length(chunk) >= 50""")
def heading_chunks(spark, sf_dir):
    """Articles and preambles of the regulations that pass the gate."""
    return L.heading_chunks(_regulations(spark, sf_dir)).select("id", "chunk_type", "n", "chunk")


@query()
def legal_chunks(spark, sf_dir):
    """The whole dispatch: regulations by headings, others by size, large chunks in parts."""
    return L.chunked(_regulations(spark, sf_dir))


def _questions(spark, sf_dir):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    ask = lambda l, i: F.concat(F.when(i % 3 == 0, F.concat(F.lit("\nB. BAGIAN "), F.when(i % 2 == 0, "GENAP").otherwise("GANJIL"), F.lit("\n"))).otherwise(""), F.lit("\n"), (i + 1).cast("string"), F.lit(". Apakah "), l, F.lit("? Ya."))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.transform(lines, ask), "").alias("text"))


_QA = f"qa AS (SELECT doc_id AS id, array_to_string(list_transform({_LINES}, lambda l, i: CASE WHEN (i - 1) % 3 = 0 THEN chr(10) || 'B. BAGIAN ' || CASE WHEN (i - 1) % 2 = 0 THEN 'GENAP' ELSE 'GANJIL' END || chr(10) ELSE '' END || chr(10) || i || '. Apakah ' || l || '? Ya.'), '') AS text FROM documents)"


@query(f"WITH {_QA}, {_found('sm', 'qa', L.SUBSECTION)} SELECT id, at_ AS start, regexp_extract(f, {quoted(L.SUBSECTION)}, 1) || '. ' || regexp_replace(regexp_extract(f, {quoted(L.SUBSECTION)}, 2), '^\\s+|\\s+$', '', 'g') AS label FROM sm")
def subsection_headings(spark, sf_dir):
    return L.subsections(_questions(spark, sf_dir)).withColumnRenamed("at", "start")


@query(f"""WITH {_QA}, {_found('sm', 'qa', L.SUBSECTION)}, {_found('qm', 'qa', L.QUESTION)},
s AS (SELECT id, at_, regexp_extract(f, {quoted(L.SUBSECTION)}, 1) || '. ' || regexp_replace(regexp_extract(f, {quoted(L.SUBSECTION)}, 2), '^\\s+|\\s+$', '', 'g') AS label FROM sm),
c AS (SELECT id, i, at_, CAST(regexp_extract(f, '[0-9]+') AS INTEGER) AS number, regexp_replace(substr(text, at_ + 1, coalesce(lead(at_) OVER (PARTITION BY id ORDER BY at_), length(text)) - at_), '^\\s+|\\s+$', '', 'g') AS chunk FROM qm),
l AS (SELECT c.id, c.i, arg_max(label, s.at_) AS label FROM c JOIN s ON s.id = c.id AND s.at_ <= c.at_ GROUP BY c.id, c.i)
SELECT c.id, number, substr(regexp_replace(regexp_extract(chunk, '^\\s*[0-9]{{1,3}}[\\.\\s]+([^?]+\\??)', 1), '^\\s+|\\s+$', '', 'g'), 1, 200) AS question, coalesce(label, 'Unknown') AS subsection, chunk FROM c LEFT JOIN l USING (id, i) WHERE length(chunk) >= 50""")
def question_chunks(spark, sf_dir):
    """A chunk for each question, with its number, its words and the subsection it stands in."""
    return L.question_chunks(_questions(spark, sf_dir)).select("id", "number", "question", "subsection", "chunk")


@query()
def two_track_chunks(spark, sf_dir):
    """Questions one by one, the other sections by size."""
    qa = _questions(spark, sf_dir).withColumn("section", F.lit("qa"))
    rest = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("intro").alias("section"))
    return L.two_tracks(qa.unionByName(rest))
