import random
import time
from html.parser import HTMLParser

import pytest

from tarn.sources import elements as E


class Tree(HTMLParser):
    """Elements by the library's parser: (tag, depth, number of starts before, last start within, joined texts)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.rows, self.stack = [], []
        self.feed(page)
        self.close()
        while self.stack:
            self.stack.pop()["last"] = len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        row = {"tag": tag, "depth": len(self.stack), "last": len(self.rows), "text": [], "attrs": {}}
        for k, v in attrs:
            row["attrs"].setdefault(k, v or "")
        self.rows.append(row)
        if tag not in E.VOID:
            self.stack.append(row)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in E.VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        if any(r["tag"] == tag for r in self.stack):
            while True:
                row = self.stack.pop()
                row["last"] = len(self.rows) - 1
                if row["tag"] == tag:
                    break

    def handle_data(self, data):
        if data.strip() and not (self.stack and self.stack[-1]["tag"] in E.RAW):
            for row in self.stack:
                row["text"].append(data.strip())


@pytest.mark.parametrize("seed", range(20))
def test_elements_are_those_of_the_standard_parser(seed):
    r = random.Random(seed)
    pieces = ["<p>", "</p>", "<div class='a b' id=\"x\">", "</div>", "<br>", "<li data-x=1 hidden>", "</li>", "</em>", "<b>", "</b>", " text ", "a &amp; b", "<!-- <p> -->", "<script>if (a<b) '<p>';</script>", "<i/>", "<A HREF='/q?a=1&amp;b=2'>", "</A>", "<td>", "<tr>", "</tr>"]
    page = "".join(r.choices(pieces, k=80))
    texts, rows = E.read_page(page)
    want = Tree(page).rows
    assert [(x["tag"], x["depth"], x["last"], dict(x["attrs"])) for x in rows] == [(w["tag"], w["depth"], w["last"], w["attrs"]) for w in want]
    assert ["".join(texts[x["t0"] : x["t1"]]).replace(" ", "") for x in rows] == ["".join(w["text"]).replace(" ", "") for w in want]


@pytest.mark.parametrize("piece", ["<div>", "</x>", "<div></x>", "<", "<!--", "<a '", "<a \"", "&", "<script>", "<p a=b>", "< >"])
def test_time_grows_with_the_page(piece):
    def took(n):
        at = time.process_time()
        E.read_page(piece * n)
        return time.process_time() - at

    assert took(80_000) < 40 * max(took(10_000), 0.02)


def rows(spark, pages):
    return E.parsed(spark.createDataFrame(list(enumerate(pages)), "id long, html string"), "id", "html").cache()


def test_nested_targets(spark):
    pages = rows(spark, ["<div class=c><h4>a</h4><div class=c><h4>b</h4></div></div><div class=c></div><h4>z</h4>", None, "", "<h4>x</h4>"])
    cards, heads = E.picked(pages, lambda e: E.has_class(e, "c")), E.picked(pages, lambda e: e["tag"] == "h4")
    assert [(r["page"], r["within"], r["nth"], r["text"]) for r in E.firsts_inside(cards, heads, 3).orderBy("within", "nth").collect()] == [(0, 0, 1, "a"), (0, 0, 2, "b"), (0, 2, 1, "b")]
    assert sorted(r["start"] for r in E.outermost(cards).collect()) == [0, 4]
    assert [(r["within"], r["text"]) for r in E.inside(heads, E.outermost(cards)).orderBy("start").collect()] == [(0, "a"), (0, "b")]
    assert [r["start"] for r in E.firsts_inside(cards, cards).collect()] == [2]


def test_permit_page(spark):
    page = """<div id="pills-syarat"><li>one<ul><li>two</li></ul></li><li> </li></div><li>outside</li>
    <div id="pills-mekanisme"><table><tr><td>1.</td><td>first <b>step</b></td></tr><tr><td>x</td><td>no</td></tr><tr><td>3</td><td></td></tr><tr><td>2</td></tr>
    <tr><td>4</td><td>d</td><td>more</td></tr></table></div><div id="pills-keterangan"><table><tr><td>Biaya Izin</td><td>:</td><td>-</td></tr><tr><td>Biaya</td><td>:</td></tr></table></div>"""
    got = {r["page"]: r for r in E.permit_details(rows(spark, [page, "<p>", None])).collect()}
    assert got[0]["persyaratan"] == ["onetwo", "two"] and [tuple(x) for x in got[0]["mekanisme_pelayanan"]] == [(1, "firststep"), (4, "d")]
    assert got[0]["dasar_hukum"] == [] and got[0]["biaya"] == "-" and got[0]["masa_berlaku"] is None
    assert got[1]["persyaratan"] == got[2]["persyaratan"] == []


def test_card_rules(spark):
    card = "<div class='overflow-hidden br-0'>{}</div>"
    links = "<div class=card-footer><a class=btn-info href=/a></a></div>"
    page = card.format("<h4>t</h4>" + links) + card.format(links) + card.format("<h4>no link</h4>") + "<div class='overflow-hidden br-0 border-0 box-shadow-0'><h4>in</h4>" + links + "</div>"
    got = [tuple(r)[2:] for r in E.law_cards(rows(spark, [page]), "http://b").collect()]
    assert got == [("t", "", "http://b/a", "")]


def test_outline_decodes_what_its_twin_does(spark, tmp_path):
    from tarn.plans import catalog

    heads = ["a &quot;b", "cut &amp", "&lt;b&gt; &amp;lt; &amp;amp;", " &nbsp;x &copy ", ""]
    page = "<html><nav><a href='/'>m</a></nav><article><h1>{}</h1><p>t</p></article></html>"
    spark.createDataFrame([(i, page.format(h)) for i, h in enumerate(heads)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page"]: r["title"] for r in catalog.QUERIES["page_outline"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(heads))] == ['a &quot;b', "cut &amp", "<b> &lt; &amp;", "&nbsp;x &copy", ""]
    # the parser itself still decodes all references
    assert E.read_page("<h1>a &quot;b &amp</h1>")[0] == ['a "b &']


def test_a_page_is_read_and_parsed_where_it_is(spark):
    pages = spark.createDataFrame([(1, "<div id=pills-syarat><li>a</li></div><div id=pills-keterangan><tr><td>BIAYA<td>:<td>5</tr></div>"), (2, None)], "id long, html string")
    parsed = E.parsed(pages, "id", "html")
    for got in (E.permits(pages, "id", "html"), E.permit_details(parsed), E.detail_table(parsed, {"Judul": "judul"})):
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 2
    rows = {r["page"]: r for r in E.permits(pages, "id", "html").collect()}
    assert (rows[1]["persyaratan"], rows[2]["persyaratan"], rows[2]["biaya"]) == (["a"], [], None)
    # a cell that isn't ended holds those after it
    assert rows[1]["biaya"] == "5"


def test_parsing_grows_with_rows_that_are_not_ended():
    def took(n):
        read = E.read_page("<div id=pills-hukum>" + "<tr><td></td><td></td>" * n)
        at = time.process_time()
        E.permit(*read)
        return time.process_time() - at

    assert took(40_000) < 40 * max(took(5_000), 0.02)


def test_permit_pages_of_small_files_are_dealt_to_all_cores(spark, tmp_path):
    from tarn.plans import catalog

    spark.range(40).selectExpr("id as c_custkey", "'s' as c_mktsegment").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(200).selectExpr("id as o_orderkey", "id % 39 as o_custkey", "'O' as o_orderstatus", "'1-HIGH' as o_orderpriority", "3e5 as o_totalprice").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog.QUERIES["permit_details"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows = {r["page"]: r for r in got.collect()}
    assert len(rows) == 40 and rows[0]["acts"] == "1:Act 0|2:Act 39|3:Act 78|4:Act 117|5:Act 156|6:Act 195" and rows[39]["needs"] == "" and rows[39]["estimasi_selesai"] is None
