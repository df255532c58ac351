"""Cleaning, chunking and parsing queries over documents, pages and conversations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import quantiles
from tarn.plans.registry import documents, query, table

TIPES = ["src1", "src2"]


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '\.{3,}', '', 'g'), '(?m)^\s*[0-9]{1,3}\s*$', '', 'g'), '(^|[^.!?:\-])\n([a-zA-Z])', '\1 \2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents"""
)
def clean_text_steps(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.clean_page(F.col("text")).alias("cleaned"))


@query(
    r"""SELECT doc_id, round(length(regexp_replace(text, '[^A-Za-z0-9 \n.,;:!?()\-]', '', 'g')) / length(text), 6) AS ratio,
    length(regexp_replace(text, '[^A-Za-z0-9 \n.,;:!?()\-]', '', 'g')) / length(text) < 0.85 AS flagged FROM documents WHERE length(text) > 0"""
)
def char_ratio_flag(spark, sf_dir):
    ratio = T.char_ratio(F.col("text"))
    return documents(spark, sf_dir).where(F.length("text") > 0).select("doc_id", F.round(ratio, 6).alias("ratio"), (ratio < 0.85).alias("flagged"))


@query(
    """SELECT doc_id, CAST(i AS INTEGER) AS part, substr(text, CAST(i * 1000 + 1 AS BIGINT), 1200) AS chunk
    FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 200) / 1000.0) AS BIGINT)))) AS i FROM documents)"""
)
def fixed_stride_chunks(spark, sf_dir):
    """Chunks of 1200 characters that overlap by 200."""
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - 200) / 1000.0).cast("int"))
    docs = documents(spark, sf_dir).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return docs.select("doc_id", "part", F.expr("substring(text, part * 1000 + 1, 1200)").alias("chunk"))


@query(
    r"""SELECT doc_id, CAST(i AS INTEGER) AS piece, trim(parts[i]) AS sentence FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE length(trim(parts[i])) >= 50"""
)
def boundary_split(spark, sf_dir):
    """Chunks at line boundaries; those of under 50 characters go, and keep their place in the numbering."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    return rows.select("doc_id", (F.col("at") + 1).alias("piece"), F.trim("raw").alias("sentence")).where(F.length("sentence") >= 50)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, max(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM lineitem) WHERE top IS NULL OR l_partkey > top"""
)
def running_max_headings(spark, sf_dir):
    """Headings that are strictly greater than all before them: those a strictly rising scan keeps."""
    before = F.max("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey").rowsBetween(Window.unboundedPreceding, -1))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumn("top", before)
    return rows.where("top is null or l_partkey > top").drop("top")


@query(
    """WITH RECURSIVE o AS MATERIALIZED (SELECT l_orderkey, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS r FROM lineitem),
    f AS (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS last, false AS kept FROM o UNION ALL SELECT f.l_orderkey, o.r, CASE WHEN o.n > last AND o.n <= last + 3 THEN o.n ELSE last END, o.n > last AND o.n <= last + 3 FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.r = f.r + 1)
    SELECT l_orderkey, coalesce(list(CAST(last AS INTEGER) ORDER BY r) FILTER (kept), []) AS kept FROM f GROUP BY l_orderkey"""
)
def bounded_step_headings(spark, sf_dir):
    """Line numbers kept while each is 1 to 3 above the last one kept: a fold over the ordered numbers of an order."""
    numbers = F.sort_array(F.collect_list(F.struct("l_shipdate", "l_linenumber")))
    fold = F.aggregate(
        "numbers",
        F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("kept")),
        lambda a, x: F.when((x["l_linenumber"] > a["last"]) & (x["l_linenumber"] <= a["last"] + 3), F.struct(x["l_linenumber"].alias("last"), F.concat(a["kept"], F.array(x["l_linenumber"])).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(numbers.alias("numbers")).select("l_orderkey", fold.alias("kept"))


@query(
    """WITH o AS (SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM conversations),
    e AS (SELECT *, lead(start_at) OVER (PARTITION BY conv_id ORDER BY turn) AS end_at FROM o),
    p AS (SELECT conv_id, unnest([0, 100, 500, 1000]) AS pos FROM (SELECT DISTINCT conv_id FROM conversations))
    SELECT p.conv_id, p.pos, e.turn FROM p JOIN e ON p.conv_id = e.conv_id AND e.start_at <= p.pos AND (e.end_at IS NULL OR p.pos < e.end_at)"""
)
def asof_page_lookup(spark, sf_dir):
    """Turns joined to one text; the turn that a character position falls in."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 2).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_at"))
    rows = rows.withColumn("end_at", F.lead("start_at").over(by))
    ends = rows.select("conv_id", "turn", "start_at", "end_at", F.explode(F.array(*map(F.lit, (0, 100, 500, 1000)))).alias("pos"))
    return ends.where("start_at <= pos and (end_at is null or pos < end_at)").select("conv_id", "pos", "turn")


@query(
    """WITH f AS (SELECT conv_id, turn, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations)
    SELECT conv_id, CAST(island AS BIGINT) AS island, string_agg(text, chr(10) ORDER BY turn) AS merged FROM f WHERE island > 0 GROUP BY conv_id, island"""
)
def island_merge(spark, sf_dir):
    """Turns up to the next user turn merged into one row; what comes before the first user turn is dropped."""
    island = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("island", island.cast("long")).where("island > 0")
    return rows.groupBy("conv_id", "island").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("merged"))


@query(
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent FROM conversations"""
)
def forward_fill_parent(spark, sf_dir):
    parent = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parent.alias("parent"))


@query(
    r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(replace(s, '•', ''), '\s+', ' ', 'g'))), lambda s: s <> '' AND NOT regexp_matches(s, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+')), ' ') AS address,
    regexp_replace(list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_extract(s, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+')), lambda s: s <> '')[-1], '\.+$', '') AS email FROM documents"""
)
def email_phone_parse(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.address_of(F.col("text")).alias("address"), T.email_of(F.col("text")).alias("email"))


@query("SELECT doc_id, CASE WHEN starts_with(source, 'src1') THEN 'src1' WHEN starts_with(source, 'src2') THEN 'src2' ELSE 'Lainnya' END AS tipe FROM documents")
def prefix_classify(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.first_prefix(F.col("source"), TIPES, "Lainnya").alias("tipe"))


@query("SELECT doc_id, concat_ws(chr(10), 'No: ' || doc_id, 'Source: ' || source, CASE WHEN lang <> 'en' THEN 'Lang: ' || lang END, 'Chars: ' || coalesce(CAST(n_chars AS VARCHAR), '-')) AS rendered FROM documents")
def render_record(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    return documents(spark, sf_dir).select("doc_id", F.concat_ws("\n", F.concat(F.lit("No: "), s("doc_id")), F.concat(F.lit("Source: "), "source"), F.when(F.col("lang") != "en", F.concat(F.lit("Lang: "), "lang")), F.concat(F.lit("Chars: "), F.coalesce(s("n_chars"), F.lit("-")))).alias("rendered"))


@query(r"SELECT page_id, CAST(i AS INTEGER) AS n, items[i] AS item FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a></li>', 1) AS items FROM pages))")
def html_list_items(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<li><a[^>]*>([^<]*)</a></li>"), F.lit(1))).alias("at", "item"))
    return rows.select("page_id", (F.col("at") + 1).alias("n"), "item")


@query(r"""SELECT page_id, len(l) AS n_links, list_sort(list_distinct(l)) AS links FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""")
def html_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.sort_array(F.array_distinct(links)).alias("links"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages""")
def html_key_values(spark, sf_dir):
    get = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", get("<title>([^<]*)</title>").alias("title"), get('<html lang="([a-z]+)"').alias("lang"), get("<h1>([^<]*)</h1>").alias("h1"))


@query("SELECT source, lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 4) AS mean, median(n_chars) AS middle FROM documents GROUP BY source, lang")
def length_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    stats = rows.groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 4).alias("mean"))
    middle = quantiles.percentiles(rows, ["source", "lang"], "n_chars", {"middle": 0.5}).select(F.col("source").alias("s"), F.col("lang").alias("l"), "middle")
    same = stats["source"].eqNullSafe(middle["s"]) & stats["lang"].eqNullSafe(middle["l"])
    return stats.join(middle, same, "left").select("source", "lang", "n", "least", "most", "mean", "middle")
