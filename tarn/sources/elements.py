"""Web pages as tables of elements, and parsers of pages as joins of those.

A page is read once: each start tag becomes an element with the place of its start, that of the last start before its end,
its depth, its attributes, and which of the page's texts are within. "Within", "the first within" and "not within another"
are then comparisons of places, done by windows and equi-joins over all pages at once, so that nothing compares every element
of a page with every other. Where all that is wanted of a page is one row, extracted() makes it in the pass that reads the page,
and no element leaves its task: what an element holds are those that start from the next on to its last.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Elements without an end, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_BROKEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_CLASSES = re.compile(r"[ \t\n\x0b\f\r]+")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
ELEMENT = "struct<start:int,last:int,depth:int,tag:string,attrs:map<string,string>,t0:int,t1:int>"


def _markup(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") of a page, in one pass."""
    at, lower, ends = 0, None, page.rfind(">")
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or lt > ends:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if end < 0:
                return
            at = end + 3
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.find(">", lt) + 1
        elif m := _TAG.match(page, lt) or _BROKEN.match(page, lt):
            tag, at = m[2].lower(), m.end()
            yield ("close" if m[1] else "open"), tag, m[3]
            if not m[1] and tag in RAW:
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at)
                if end < 0:
                    return
                at = end
        else:
            yield "text", "<", ""
            at = lt + 1


def _attributes(text: str) -> list[tuple[str, str]]:
    if not text:
        return []
    out = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return list(out.items())


def basic_references(text: str) -> str:
    """text with the three references decoded that markup can't do without; all others stay as they are written."""
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def read_page(page: str | None, decoded: Callable[[str], str] = html.unescape) -> tuple[list[str], list[dict]]:
    """(texts, elements): stripped texts that aren't empty, and every element in the order of starts.

    An end tag ends all that is open within its element; one that matches nothing is skipped, which a count of what is open
    tells. What is still open ends with the page. t0 and t1 are the range of the texts within.
    """
    texts: list[str] = []
    rows: list[dict] = []
    stack: list[int] = []
    open_: Counter = Counter()

    def end() -> str:
        row = rows[stack.pop()]
        row["last"], row["t1"] = len(rows) - 1, len(texts)
        open_[row["tag"]] -= 1
        return row["tag"]

    for kind, value, rest in _markup(page or ""):
        if kind == "text":
            if value := decoded(value).strip():
                texts.append(value)
        elif kind == "open":
            rows.append({"start": len(rows), "last": len(rows), "depth": len(stack), "tag": value, "attrs": _attributes(rest), "t0": len(texts), "t1": len(texts)})
            if value not in VOID and not rest.rstrip().endswith("/") or value in RAW:
                stack.append(len(rows) - 1)
                open_[value] += 1
        elif open_[value]:
            while end() != value:
                pass
    while stack:
        end()
    return texts, rows


def parsed(pages: DataFrame, id_col: str, html_col: str, decoded: Callable[[str], str] = html.unescape) -> DataFrame:
    """(page, texts, elements) of every page; a null page has none. Nothing is moved. decoded: what becomes of references in
    texts, by default all that HTML knows, also those without an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("t0", pa.int32()), ("t1", pa.int32())]))
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                read = [read_page(x.as_py(), decoded) for x in part["html"]]
                yield pa.RecordBatch.from_arrays([part["page"], pa.array([t for t, _ in read], pa.list_(pa.string())), pa.array([e for _, e in read], kind)], ["page", "texts", "elements"])

    return pages.select(F.col(id_col).cast("long").alias("page"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"page long, texts array<string>, elements array<{ELEMENT}>")


#: What a parser makes of one page's texts and elements: its columns by name.
Extract = Callable[[list[str], list[dict]], dict]


def extracted(pages: DataFrame, id_col: str, html_col: str, of: Extract, kinds: dict[str, str]) -> DataFrame:
    """(page, the columns of kinds) of every page by `of`, in the pass that reads it. Nothing is moved."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(html_col).cast("string").alias("html"))
    return _rows_by(rows, lambda b: (of(*read_page(x.as_py())) for x in b["html"]), kinds)


def _extracted_from(pages: DataFrame, of: Extract, kinds: dict[str, str]) -> DataFrame:
    """The same from parsed pages."""
    return _rows_by(pages.select("page", "texts", "elements"), lambda b: (of(t.as_py(), e.as_py()) for t, e in zip(b["texts"], b["elements"], strict=True)), kinds)


def _rows_by(pages: DataFrame, read: Callable[[pa.RecordBatch], Iterator[dict]], kinds: dict[str, str]) -> DataFrame:
    schema = "page long, " + ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                rows = list(read(part))
                yield pa.RecordBatch.from_arrays([part["page"], *(pa.array([r[c] for r in rows], arrow.field(c).type) for c in kinds)], schema=arrow)

    return pages.mapInArrow(run, schema)


def picked(pages: DataFrame, which: Callable[[Column], Column], text: bool = True) -> DataFrame:
    """(page, start, last, tag, attrs, text) of the elements that `which` chooses, as rows."""
    inside = lambda e: F.array_join(F.slice("texts", e["t0"] + 1, e["t1"] - e["t0"]), "") if text else F.lit(None).cast("string")
    rows = F.transform(F.filter("elements", which), lambda e: F.struct(e["start"].alias("start"), e["last"].alias("last"), e["tag"].alias("tag"), e["attrs"].alias("attrs"), inside(e).alias("text")))
    return pages.select("page", F.explode(rows).alias("e")).select("page", "e.*")


def classes(e: Column) -> Column:
    return F.split(F.coalesce(e["attrs"]["class"], F.lit("")), r"\s+")


def has_class(e: Column, *names: str) -> Column:
    return F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(classes(e), n))


def outermost(rows: DataFrame) -> DataFrame:
    """The elements of rows that are in no other of them."""
    before = Window.partitionBy("page").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_reach", F.max("last").over(before)).where("_reach is null or _reach < start").drop("_reach")


def first_of(rows: DataFrame) -> DataFrame:
    """The first of the rows of each page."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("page").orderBy("start"))).where("_n = 1").drop("_n")


def inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner with `within`, the start of the outer element that holds it; others go. No outer element is in another."""
    both = inner.withColumn("_o", F.lit(None).cast("struct<start:int,last:int>")).unionByName(outer.select("page", "start", F.struct("start", "last").alias("_o")), allowMissingColumns=True)
    # an element that is both comes before itself
    held = F.last("_o", ignorenulls=True).over(Window.partitionBy("page").orderBy("start", F.col("_o").isNotNull()))
    rows = both.withColumn("_h", held).where("_o is null and _h is not null and start > _h.start and last <= _h.last")
    return rows.withColumn("within", F.col("_h.start")).drop("_o", "_h")


def firsts_inside(outer: DataFrame, inner: DataFrame, n: int = 1) -> DataFrame:
    """(page, within, nth, and the columns of inner) of the first n inner elements in each outer one, which may be nested.

    Inner elements are numbered by page; an outer one asks for the numbers that come next, so this is an equi-join.
    """
    both = outer.select("page", "start", "last", F.lit(0).alias("_k")).unionByName(inner.select("page", "start", "last", F.lit(1).alias("_k")))
    counted = both.withColumn("_no", F.sum("_k").over(Window.partitionBy("page").orderBy("start", F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)))
    asks = counted.where("_k = 0").select("page", F.col("start").alias("within"), F.col("last").alias("_end"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("nth"), "_no").withColumn("_no", F.col("_no") + F.col("nth"))
    numbered = inner.withColumn("_no", F.row_number().over(Window.partitionBy("page").orderBy("start")).cast("long"))
    return asks.join(numbered, ["page", "_no"]).where("last <= _end").drop("_no", "_end")


def _held(elements: list[dict], outer: dict | None) -> list[dict]:
    return elements[outer["start"] + 1 : outer["last"] + 1] if outer else []


def _joined(texts: list[str], e: dict) -> str:
    return "".join(texts[e["t0"] : e["t1"]])


def _cells(texts: list[str], elements: list[dict], section: dict | None, n: int) -> Iterator[list[str]]:
    """Of each table row of a section, its first n cells' texts, fewer where it has fewer; rows without cells are left out."""
    held = _held(elements, section)
    cells = [e for e in held if e["tag"] == "td"]
    starts = [e["start"] for e in cells]
    for row in held:
        if row["tag"] == "tr":
            at = bisect_right(starts, row["start"])
            if found := [_joined(texts, c) for c in cells[at : at + n] if c["last"] <= row["last"]]:
                yield found


#: The sections of a permit's page by id, and what the keys of its last table hold.
SECTIONS = {"persyaratan": "pills-syarat", "mekanisme_pelayanan": "pills-mekanisme", "dasar_hukum": "pills-hukum", "keterangan": "pills-keterangan"}
KEYS = {"estimasi selesai": "estimasi_selesai", "masa berlaku": "masa_berlaku", "biaya": "biaya"}


PERMIT = {
    "persyaratan": "array<string>", "mekanisme_pelayanan": "array<struct<nomor:int,deskripsi:string>>", "dasar_hukum": "array<struct<nomor:int,referensi:string>>", **dict.fromkeys(KEYS.values(), "string"),
}
#: A number as the pattern ^[0-9]+$ of Spark finds it: `$` is also before an end of line.
_NUMBER = re.compile(r"[0-9]+(?:\r?\n|\r)?")


def permit(texts: list[str], elements: list[dict]) -> dict:
    """The columns of PERMIT of one page, see permit_details()."""
    by_id = {i: None for i in SECTIONS.values()}
    for e in elements:
        if e["tag"] == "div" and e["attrs"]:
            i = dict(e["attrs"]).get("id")
            if i in by_id and by_id[i] is None:
                by_id[i] = e
    section = {f: by_id[i] for f, i in SECTIONS.items()}
    items = (_joined(texts, e) for e in _held(elements, section["persyaratan"]) if e["tag"] == "li")
    out = {"persyaratan": [x for x in items if x]} | dict.fromkeys(KEYS.values())
    for name, column in (("mekanisme_pelayanan", "deskripsi"), ("dasar_hukum", "referensi")):
        rows = ((c[0].rstrip("."), c[1]) for c in _cells(texts, elements, section[name], 2) if len(c) > 1)
        out[name] = [{"nomor": int(n), column: text} for n, text in rows if text and _NUMBER.fullmatch(n)]
    for c in _cells(texts, elements, section["keterangan"], 3):
        key = c[0].lower()
        field = next((f for k, f in KEYS.items() if k in key), None)
        if len(c) > 2 and field:
            out[field] = c[2]
    return out


def permit_details(pages: DataFrame) -> DataFrame:
    """(page, persyaratan, mekanisme_pelayanan, dasar_hukum, estimasi_selesai, masa_berlaku, biaya) of every parsed page.

    Requirements are the list items of their section that have a text. Steps and legal grounds are table rows whose first cell
    is a number, dots at its end left out, and whose second has a text. Terms are rows of three cells or more, the first of
    which contains a key, whatever its case; of several rows with a key the last counts. A missing section gives an empty list.
    """
    return _extracted_from(pages, permit, PERMIT)


def permits(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """permit_details() of pages that aren't parsed yet, in one pass."""
    return extracted(pages, id_col, html_col, permit, PERMIT)


def law_cards(pages: DataFrame, base_url: str) -> DataFrame:
    """(page, start, judul_list, tipe_list, detail_url, pdf_url) of the outer cards of parsed list pages.

    A card has the classes overflow-hidden and br-0, and not both border-0 and box-shadow-0, which inner ones have. One without a heading or
    without a link to its details is left out. Of several links of a kind in the card's first footer the last counts.
    """
    cards = picked(pages, lambda e: (e["tag"] == "div") & F.contains(e["attrs"]["class"], F.lit("overflow-hidden")) & F.contains(e["attrs"]["class"], F.lit("br-0")) & ~has_class(e, "border-0", "box-shadow-0"), text=False)
    cards = cards.select("page", "start", "last")
    title = firsts_inside(cards, picked(pages, lambda e: e["tag"] == "h4")).select("page", F.col("within").alias("start"), F.col("text").alias("judul_list"))
    spans = picked(pages, lambda e: e["tag"] == "span")
    icons = picked(pages, lambda e: (e["tag"] == "i") & F.contains(e["attrs"]["class"], F.lit("fa-file-text")), text=False)
    marked = spans.join(firsts_inside(spans, icons).select("page", F.col("within").alias("start")), ["page", "start"], "left_semi")
    kind = firsts_inside(cards, marked).select("page", F.col("within").alias("start"), F.col("text").alias("tipe_list"))
    footers = firsts_inside(cards, picked(pages, lambda e: (e["tag"] == "div") & has_class(e, "card-footer"), text=False))
    links = inside(picked(pages, lambda e: (e["tag"] == "a") & e["attrs"]["href"].isNotNull(), text=False), outermost(footers.select("page", "start", "last")))
    e = F.struct("attrs")
    info, green = has_class(e, "btn-info"), has_class(e, "btn-success")
    href = F.when(F.startswith(F.col("attrs")["href"], F.lit("http")), F.col("attrs")["href"]).otherwise(F.concat(F.lit(base_url), F.col("attrs")["href"]))
    last = lambda c, name: F.max_by(href, F.when(c, F.col("start"))).alias(name)
    urls = links.groupBy("page", "within").agg(last(info, "detail_url"), last(green & ~info, "pdf_url"))
    urls = footers.select("page", F.col("within").alias("card"), F.col("start").alias("within")).join(urls, ["page", "within"]).select("page", F.col("card").alias("start"), "detail_url", "pdf_url")
    out = cards.select("page", "start").join(title, ["page", "start"]).join(urls.where("detail_url is not null"), ["page", "start"]).join(kind, ["page", "start"], "left")
    return out.select("page", "start", "judul_list", F.coalesce("tipe_list", F.lit("")).alias("tipe_list"), "detail_url", F.coalesce("pdf_url", F.lit("")).alias("pdf_url"))


def detail_of(labels: dict[str, str], css: str = "tb-detail") -> Extract:
    """(a column for each label) of one page, see detail_table()."""

    def of(texts: list[str], elements: list[dict]) -> dict:
        table = next((e for e in elements if e["tag"] == "table" and css in _CLASSES.split(dict(e["attrs"]).get("class") or "")), None)
        rows = {c[0]: c[2] for c in _cells(texts, elements, table, 3) if len(c) > 2}
        return {f: rows.get(label) for label, f in labels.items()}

    return of


def detail_table(pages: DataFrame, labels: dict[str, str], css: str = "tb-detail") -> DataFrame:
    """(page, a column for each label): the third cells of the first table of a class, by the text of the first cell.

    Rows of fewer cells and labels that aren't known are left out; of several rows with a label the last counts."""
    return _extracted_from(pages, detail_of(labels, css), dict.fromkeys(labels.values(), "string"))


def detail_tables(pages: DataFrame, id_col: str, html_col: str, labels: dict[str, str], css: str = "tb-detail") -> DataFrame:
    """detail_table() of pages that aren't parsed yet, in one pass."""
    return extracted(pages, id_col, html_col, detail_of(labels, css), dict.fromkeys(labels.values(), "string"))
