"""Main text of web pages by paths that the pages of a host agree on.

Method. Each page is cut into containers (elements that hold blocks) with the blocks of text in them. Navigation, adverts,
comments and the like are known by tag, role or a name in class or id, and carry no text. Forms, headers and some names
(a widget, a notice) are zones that are judged by what they hold: an article's own header keeps its headings and long
sentences, and if nothing outside such zones is prose, the one with most of it is the page. A path of tags and classes,
digits generalised, that says the same on most different pages of a host is boilerplate. From the page down, a page's
main container is the deepest one with nothing outside it but link text, boilerplate and a little text without heading,
list, table or sentence (REST): a lead, a title or a list beside the body keeps both. It votes, with its text as weight,
for its path; votes are summed by host in Spark. Every page is then read again and its text taken from the containers on
its host's winning path, or from its own main container where it has none.

A container knows its parent and its own name; a path is a 64-bit hash of both, so a page takes memory in proportion to its
length however deep it is. A host in a third of all rows is one row by path after partial sums; boilerplate and winners are
joined back by host, broadcast while they are few and short. A page is parsed three times, each in one pass whatever its
length.
"""

from __future__ import annotations

import hashlib
import heapq
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C

#: Bytes of host names and path hashes that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Different pages of a host that must say the same under a path, and more than half of those with it, to make it boilerplate.
REPEATED = 3
#: Text in containers beside the main one, without heading, list, table or sentence, is no article up to one in so many characters.
REST = 8
#: Characters of a sentence that counts as prose where a zone is judged.
PROSE = 60

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCK = _HEADINGS | frozenset("p li dt dd pre blockquote td th tr caption figcaption summary".split())
_DROPPED = frozenset("head nav footer aside button select option dialog menu iframe object canvas svg map audio video".split())
_JUDGED = frozenset("form header".split())
#: A class or id, with at most one word before what it says and only words of layout behind: left-sidebar, ad-slot-2, but
#: not has-sidebar, content-with-sidebar, search-results or notice-of-motion.
_BEFORE = r"(?!(?:has|with|without|no|show|hide)[_-])(?:[a-z0-9]+[_-]+)?"
_GONE = r"ads?|advert\w*|banners?|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|login|menu|modal|nav|navbar|navigation|newsletter|pagination|paywall|popup|promos?|replies|respond|share|sharing|signup|skip|social|sponsor\w*|subscribe|toolbar"
_UNSURE = r"disclaimer|form|header|masthead|notices?|related|search|sidebar|widgets?"
_LAYOUT = r"area|articles|bar|bottom|box|buttons?|col|column|container|content|footer|full|header|icons?|inner|item|items|large|left|links?|list|main|outer|overlay|panel|posts|primary|right|secondary|section|slot|small|stories|tags|text|top|unit|wide|wrap|wrapper|[a-z]?\d+"
_BEHIND = rf"(?:[_-]+(?:{_GONE}|{_UNSURE}|{_LAYOUT}))*[_-]*\d*"
_GONE_NAME = re.compile(f"{_BEFORE}(?:{_GONE}){_BEHIND}", re.I)
_UNSURE_NAME = re.compile(f"{_BEFORE}(?:{_UNSURE}){_BEHIND}", re.I)
#: Elements that hold the page or its article, whatever their names say.
_KEPT = frozenset("html body main article".split())
_ODD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Comments, declarations, elements whose text isn't read, tags, and tags with a quote that is never closed.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(script|style|noscript|template|textarea|title)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(/?)([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PLAIN = frozenset("page html body div section p".split())
_STOP = re.compile("[.!?:;\u2026\u3002\uff01\uff1f\u061f\u0964]")
_DIGITS = re.compile(r"\d+")
_HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

#: What becomes of the text in an element: it goes whatever happens, or it is in a zone (a number from 0), or it stays.
_LOST, _STAYS = -2, -1


class Page:
    """paths, parents: of the containers, the page itself first; blocks: (container, text, how much of it is in links)."""

    def __init__(self, source: str | None):
        self.names, self.paths, self.parents = ["page"], [_hash("page")], [-1]
        self.blocks: list[tuple[int, str, int]] = []
        #: Containers with a block that isn't plain: a heading, a list or table cell, or text with the end of a sentence.
        self.telling: set[int] = set()
        self._texts: list[str] = []
        self._links = self._link = 0
        # zones: the zone outside, and whether it is an article's own header; blocks with tag and zone until all is read
        self._zones: list[tuple[int, bool]] = []
        self._read: list[tuple[int, str, int, str, int]] = []
        # open elements: tag, container, what becomes of its text
        stack: list[tuple[str, int, int]] = [("page", 0, _STAYS)]
        source, at = source or "", 0
        articles, open_ = 0, Counter()
        for m in _TAG.finditer(source):
            if m.start() > at and stack[-1][2] != _LOST:
                self._add(source[at : m.start()])
            at = m.end()
            closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
            if tag is None:
                continue
            tag = tag.lower()
            if tag in _INLINE:
                if tag == "br":
                    self._add(" ")
                elif tag == "a":
                    self._link = 0 if closing else 1
                continue
            self._flush(*stack[-1])
            if closing:
                # an end that matches nothing open is known by count, not by a walk over all that is open
                while open_[tag]:
                    ended = stack.pop()[0]
                    open_[ended] -= 1
                    articles -= ended in ("article", "main")
                    if ended == tag:
                        break
                continue
            if tag in _VOID:
                continue
            while stack[-1][0] == "p" or (tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == tag):
                open_[stack.pop()[0]] -= 1
            _, inside, fate = stack[-1]
            marks = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
            if fate != _LOST:
                names = [] if tag in _KEPT else [n for k in ("class", "id") for n in marks.get(k, "").split()]
                if tag in _DROPPED or marks.get("role", "").lower() in _ODD_ROLE or any(_GONE_NAME.fullmatch(n) for n in names):
                    fate = _LOST
                elif tag in _JUDGED or any(_UNSURE_NAME.fullmatch(n) for n in names):
                    self._zones.append((fate, tag == "header" and articles > 0))
                    fate = len(self._zones) - 1
            if tag not in _BLOCK and fate != _LOST:
                name = ".".join([tag, *sorted(_DIGITS.sub("0", c) for c in marks.get("class", "").split())])
                self.names.append(name)
                self.paths.append(_step(self.paths[inside], name))
                self.parents.append(inside)
                inside = len(self.names) - 1
            if not attributes.rstrip().endswith("/"):
                stack.append((tag, inside, fate))
                open_[tag] += 1
                articles += tag in ("article", "main")
        if at < len(source) and stack[-1][2] != _LOST:
            self._add(source[at:])
        self._flush(*stack[-1])
        self._judge()

    def _add(self, raw: str) -> None:
        self._texts.append(raw)
        if self._link:
            self._links += len(raw)

    def _flush(self, tag: str, container: int, fate: int) -> None:
        if self._texts:
            text = " ".join(html.unescape("".join(self._texts)).split())
            if text:
                # a title may link to its own page
                self._read.append((container, text, 0 if tag == "h1" else self._links, tag, fate))
            self._texts.clear()
        self._links = self._link = 0

    def _judge(self) -> None:
        """Keep the blocks outside zones, those of articles' own headers that tell something, and, where that is no prose,
        those of the zone with most of it; then of the zones in that one, and so on."""
        prose = [0] * len(self._zones)
        some = False
        for _, text, links, tag, fate in self._read:
            if len(text) >= PROSE and tag not in _HEADINGS and len(text) > 2 * links and _STOP.search(text):
                some |= fate == _STAYS
                if fate >= 0:
                    prose[fate] += len(text)
        # what a zone holds with those in it, which come later; zones by the one they are in
        held, inner = prose.copy(), [[] for _ in range(len(prose) + 1)]
        for z in range(len(prose) - 1, -1, -1):
            outside = self._zones[z][0]
            inner[outside].append(z)  # the last list is that of the page
            if outside >= 0:
                held[outside] += held[z]
        open_ = {_STAYS}
        able = [(-held[z], z) for z in inner[_STAYS] if held[z]]
        heapq.heapify(able)
        while able and not some:
            best = heapq.heappop(able)[1]
            open_.add(best)
            some = prose[best] > 0
            for z in inner[best]:
                if held[z]:
                    heapq.heappush(able, (-held[z], z))
        for container, text, links, tag, fate in self._read:
            own = fate >= 0 and self._zones[fate][1] and self._zones[fate][0] in open_
            if fate in open_ or (own and (tag in _HEADINGS or (len(text) >= PROSE and _STOP.search(text)))):
                if tag not in _PLAIN or _STOP.search(text):
                    self.telling.add(container)
                self.blocks.append((container, text, links))
        self._read.clear()

    def path(self, container: int) -> str:
        """The names from the page down to a container."""
        out: list[str] = []
        while container >= 0:
            out.append(self.names[container])
            container = self.parents[container]
        return ">".join(reversed(out))

    def said(self) -> dict[int, str]:
        """The blocks outside links by the path of their container."""
        texts: dict[int, list[str]] = {}
        for c, text, links in self.blocks:
            if len(text) > 2 * links:
                texts.setdefault(self.paths[c], []).append(text)
        return {p: "\n".join(t) for p, t in texts.items()}

    def main(self, repeated: Iterable[int] = ()) -> tuple[int, int]:
        """(the main container, how much text it holds outside links and boilerplate, the repeated paths)."""
        n, repeated = len(self.paths), frozenset(repeated)
        telling = [c in self.telling for c in range(n)]
        weight, children = [0] * n, [[] for _ in range(n)]
        for c, text, links in self.blocks:
            if self.paths[c] not in repeated:
                weight[c] += max(len(text) - 2 * links, 0)
        for c in range(n - 1, 0, -1):
            weight[self.parents[c]] += weight[c]
            telling[self.parents[c]] |= telling[c]
            children[self.parents[c]].append(c)
        at = 0
        while weight[at]:
            best = max(children[at], key=lambda c: (weight[c], -c), default=at)
            beside = [c for c in children[at] if c != best and weight[c]]
            outside = weight[at] - weight[best]
            crumbs = sum(weight[c] for c in beside) == outside and REST * outside <= weight[at] and not any(telling[c] for c in beside)
            if best == at or not weight[best] or (outside and not crumbs):
                break
            at = best
        return at, weight[at]

    def text(self, path: int | None) -> str:
        """The blocks below the containers on the path, or below the main container, one a line."""
        roots = {c for c, p in enumerate(self.paths) if p == path} or {self.main()[0]}
        inside = [False] * len(self.paths)
        for c in range(len(self.paths)):
            inside[c] = c in roots or (c > 0 and inside[self.parents[c]])
        return "\n".join(t for c, t, _ in self.blocks if inside[c])


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _step(path: int, name: str) -> int:
    """The path of a container from its parent's and its own name."""
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8, key=path.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, texts, pages = [], [], [], []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            said = Page(source).said()
            page = _hash("\n".join(said.values()))
            for path, text in said.items():
                hosts.append(host)
                paths.append(path)
                texts.append(_hash(text))
                pages.append(page)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (paths, texts, pages))], names=["host", "path", "said", "page"])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, weights = [], []
        for source, repeated in zip(batch.column("html").to_pylist(), batch.column("repeated").to_pylist(), strict=True):
            page = Page(source)
            at, weight = page.main(repeated or ())
            paths.append(page.paths[at])
            weights.append(weight)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.int64()), pa.array(weights, pa.int64())], names=["host", "path", "weight"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(s).text(p) for s, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _by_host(rows: DataFrame, hosts: DataFrame, numbers: Column) -> DataFrame:
    """rows with what is known of their host: broadcast up to BROADCAST_BYTES, else shuffled, where Spark splits a hot host."""
    bytes_ = hosts.agg(F.sum(F.octet_length("host") + 8 * numbers + 64)).first()[0] or 0
    return rows.join(F.broadcast(hosts) if bytes_ <= BROADCAST_BYTES else hosts, "host", "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: blocks of the main text, one a line, white space as one space.

    Null and empty html give an empty text. Pages with a null url, or one without a host, are a host of their own. Ties
    between paths go to the least hash. Null ids and repeated rows each have a row. An empty table gives an empty result;
    other columns aren't read, whatever their names.
    """
    C.arrow_rows(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    rows = C.inputs(pages, id=id_col, url=url_col, html=html_col).withColumn("host", host)
    # copies of a page are one page; pages without a host have no other to compare with
    said = rows.where("host != ''").select("host", "html").mapInArrow(_said, "host string, path long, said long, page long").distinct()
    same = said.groupBy("host", "path", "said").count().groupBy("host", "path").agg(F.max("count").alias("top"), F.sum("count").alias("n"))
    repeated = C.checkpointed(same.where((F.col("top") >= REPEATED) & (2 * F.col("top") > F.col("n"))).groupBy("host").agg(F.collect_list("path").alias("repeated")))
    votes = _by_host(rows.select("host", "html"), repeated, F.size("repeated")).mapInArrow(_votes, "host string, path long, weight long").groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    best = C.checkpointed(votes.where("weight > 0").groupBy("host").agg(F.min(F.struct((-F.col("weight")).alias("w"), "path")).alias("b")).select("host", "b.path"))
    joined = _by_host(rows, best, F.lit(1))
    return joined.select("id", "url", "html", "path").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
