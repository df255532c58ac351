"""Personal data, plain and disguised: e-mail addresses, IP addresses, card numbers and phone numbers.

Method. The plain forms are looked for in the text as it is. Then a chain of transducers rewrites it: characters that look
like others (homoglyphs, full-width and other compatible forms, invisible characters, character references), spelled digits,
"at" and "dot" in brackets or words. Every transducer keeps its edits, so a place in its output maps back to its input and so
to the source. The same detectors run over the rewritten text, and what they find becomes a span of the source, if an edit
is part of it. Words that are "at" and "dot" in prose as well are rewritten last, to marks of their own that only an address
which is whole, with a domain of letters at its end, may hold.

Each text is handled for itself, where it is; all patterns take time in proportion to its length. Rows are not moved, so no
source, key or group of copies matters.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common as C

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]
Edit = tuple[int, int, str]

# Letters of other scripts that look like these, and signs for at and dot.
LOOKALIKES = {
    "a": "аα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽε", "g": "ɡց", "h": "һհ", "i": "іıιӏ", "j": "јϳ", "k": "кκ", "l": "ⅼ", "m": "м", "n": "ոп", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ",
    "t": "тτ", "u": "υսц", "v": "ѵν", "w": "ѡԝω", "x": "хχ", "y": "уγү", "z": "ᴢ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ", "-": "‐‑‒–—−⁃", ".": "․。∙·•٫", "@": "ⓐ", "+": "✚➕",
}
INVISIBLE = "­͏؜ᅟ᠎​‌‍‎‏⁠⁡⁢⁣⁤︎️﻿"
# The digits in four languages, zero first; the first of each list are English.
DIGITS = ["zero null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf fuenf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"]
# What is never the first part of a domain after a plain "at".
ARTICLES = {"the", "a", "an", "this", "that", "some", "any", "every", "each", "one", "my", "your", "our", "his", "her", "its", "their"}
AT_WORD, DOT_WORD, DOT_SIGN, AT_SIGN = "", "", "", ""


class Mapped:
    """A text that edits made of another, and where its parts come from."""

    def __init__(self, text: str, below: Mapped | None = None, edits: list[Edit] | None = None):
        self.below, self.edits, self.out = below, edits or [], []
        if below is None:
            self.text = text
            return
        pieces, at, n = [], 0, 0
        for start, end, new in self.edits:
            pieces += [text[at:start], new]
            n += start - at
            self.out.append(n)
            n, at = n + len(new), end
        self.text = "".join([*pieces, text[at:]])

    def _edit(self, place: int) -> tuple[int, Edit] | None:
        i = bisect_right(self.out, place) - 1
        return (self.out[i], self.edits[i]) if i >= 0 else None

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The span of the first text that [start, end) of this one comes from, and whether an edit is within."""
        if self.below is None:
            return start, end, False
        places = []
        for place in (start, end - 1):
            at, (s, e, new) = self._edit(place) or (0, (0, 0, ""))
            places.append((s, e) if place < at + len(new) else (place - at - len(new) + e,) * 2)
        low, high = places[0][0], places[1][1] if places[1][0] != places[1][1] else places[1][1] + 1
        changed = bisect_right(self.out, end - 1) > bisect_right(self.out, start) or low != places[0][1]
        first, last, before = self.below.source(low, high)
        return first, last, before or changed

    def rewritten(self, pattern: re.Pattern, edits: Callable[[re.Match], list[Edit]]) -> Mapped:
        found = [e for m in pattern.finditer(self.text) for e in edits(m)]
        return Mapped(self.text, self, found) if found else self


# --- detectors: each takes time in proportion to the text ------------------------------------

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
_PARTS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    return [m.span() for m in _EMAIL.finditer(text) if m[1]] if "@" in text else []


def ips(text: str) -> list[Span]:
    """Four parts at a time of what digits and single dots make."""
    out = []
    for m in _PARTS.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[Span]:
    found = ((m.span(), m[0].replace(" ", "").replace("-", "")) for m in _CARD.finditer(text))
    return [at for at, digits in found if 12 <= len(digits) <= 19 and luhn(digits)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15] if "+" in text else []


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detected(text: str) -> dict[str, list[Span]]:
    digits = _DIGIT.search(text) is not None
    return {k: f(text) if digits or k == "email" else [] for k, f in DETECTORS.items()}


# --- transducers -----------------------------------------------------------------------------


def _same_as() -> dict[str, str]:
    """What each character that looks like ASCII is written as: the lookalikes, and all forms that Unicode calls compatible."""
    out = {c: plain for plain, others in LOOKALIKES.items() for c in others} | dict.fromkeys(INVISIBLE, "")
    for code in [*range(0xA0, 0x3000), *range(0xFE10, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        if not 0xD800 <= code < 0xE000 and (c := chr(code)) not in out:
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and plain.isascii() and plain.isprintable() and len(plain) == 1:
                out[c] = plain
            elif (d := unicodedata.decimal(c, None)) is not None:
                out[c] = str(d)
    return out


_SAME = _same_as()
_CHARACTERS = re.compile("&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,12});|%(?:40|2[eE])|[" + "".join(map(re.escape, sorted(_SAME))) + "]")
_BETWEEN = r"[ \t\r\n,-]{0,3}"
_SPELLED = {w: str(n) for n, words in enumerate(DIGITS) for w in words.split()}
_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_SPOKEN = re.compile(rf"(?<![^\W_])(?:(?:double|triple)[ \t]+)?{_WORD}(?:{_BETWEEN}(?:(?:double|triple)[ \t]+)?(?:{_WORD}|oh?(?![^\W_])))*+(?![^\W_])", re.I)
_SPOKEN_ONE = re.compile(rf"double|triple|{_WORD}|oh?", re.I)
_LETTERED = re.compile(r"(?<![A-Za-z0-9])(?=[OoIl]*[0-9])[0-9OoIl]*[OoIl][0-9OoIl]*(?![A-Za-z0-9])")
_AS_DIGIT = {"O": "0", "o": "0", "I": "1", "l": "1"}
_OPEN, _CLOSE = r"[\[({<][ \t]*", r"[ \t]*[\])}>][ \t\r\n]*"
_BRACKETED = re.compile(
    rf"{_OPEN}(?:(?P<at>at|ät|@|a|arroba|arobase|chez|klammeraffe)|(?P<dot>dot|punkt|punto|point|\.)){_CLOSE}"
    r"|(?<=[ \t])(?P<at2>arroba|arobase|klammeraffe)[ \t]+|(?<=[0-9])[ \t]+(?P<dot2>dot|punkt|punto|point)[ \t]+(?=[0-9])"
    r"|(?<![^\W_])(?P<plus>[\[({<]?plus[\])}>]?)[ \t]+(?=[(]?[1-9](?:[ ().-]{0,3}[0-9]){9,14}(?![0-9]))",
    re.I,
)
_WORDS = re.compile(
    r"(?<=[A-Za-z0-9_%+])(?:[ \t\r\n]+(?:(?P<at>at|ät)|(?P<dot>dot|punkt|punto)|(?P<sign>\.|point)|(?P<atsign>@))[ \t\r\n]+|[_-](?:(?P<at3>at)|(?P<dot3>dot))[_-])(?=[A-Za-z0-9])", re.I
)
_ADDRESS = re.compile(
    f"(?P<local>[A-Za-z0-9._%+{DOT_WORD}-]++)(?:(?P<at>[@{AT_WORD}{AT_SIGN}])(?P<domain>[A-Za-z0-9-]+(?:[.{DOT_WORD}{DOT_SIGN}][A-Za-z0-9-]+)++)(?![@{AT_WORD}{AT_SIGN}]))?"
)


def _character(m: re.Match) -> list[Edit]:
    c = m[0]
    new = {"%40": "@", "%2e": "."}.get(c.lower()) if c[0] == "%" else html.unescape(c) if c[0] == "&" else _SAME[c]
    new = "".join(_SAME.get(x, x) for x in new)
    return [(*m.span(), new)] if new != c and new.isascii() else []


def _lettered(m: re.Match) -> list[Edit]:
    return [(m.start() + i, m.start() + i + 1, _AS_DIGIT[c]) for i, c in enumerate(m[0]) if c in _AS_DIGIT]


def _spoken(m: re.Match) -> list[Edit]:
    out, times, at = [], 1, m.start()
    for x in _SPOKEN_ONE.finditer(m[0]):
        start, end, word = m.start() + x.start(), m.start() + x.end(), x[0].lower()
        if word in ("double", "triple"):
            times = 2 if word == "double" else 3
            continue
        # what lies between two digits goes with the second
        out.append((start if at == m.start() and times == 1 else at, end, _SPELLED.get(word, "0") * times))
        times, at = 1, end
    if len(out) == 1 and len(out[0][2]) == 1:
        # one such word is a word of prose, unless something says that it is part of a number
        before, after = m.string[max(0, m.start() - 12) : m.start()], m.string[m.end() : m.end() + 12]
        within = re.search("[0-9][ \\t-]*$", before) and re.match("[ \\t-]*[0-9]", after)
        if not (within or _ONE_BEFORE.search(before) or _ONE_AFTER.match(after)):
            return []
    return out


def _bracketed(m: re.Match) -> list[Edit]:
    if m["plus"]:
        return [(*m.span(), "+")]
    start = m.start()
    while start and m.string[start - 1] in " \t\r\n":
        start -= 1
    return [(start, m.end(), "@" if m["at"] or m["at2"] else ".")]


def _words(m: re.Match) -> list[Edit]:
    mark = AT_WORD if m["at"] or m["at3"] else DOT_WORD if m["dot"] or m["dot3"] else DOT_SIGN if m["sign"] else AT_SIGN
    return [(*m.span(), mark)]


def addresses(text: str) -> list[Span]:
    """E-mail addresses with marks for words and signs: a plain "at" asks for a "dot", or a local part no word has."""
    out = []
    for m in _ADDRESS.finditer(text):
        if not m["at"]:
            continue
        labels = re.split(f"[.{DOT_WORD}{DOT_SIGN}]", m["domain"])
        good = len(labels[-1]) > 1 and labels[-1].isalpha()
        if m["at"] == AT_WORD:
            said = DOT_WORD in m["domain"] or re.search(f"[0-9._+{DOT_WORD}]", m["local"].strip("."))
            good = good and bool(said) and DOT_SIGN not in m["domain"] and labels[0].lower() not in ARTICLES
        if good:
            out.append(m.span())
    return out


def _ranges(chars: str) -> str:
    """A character class of many characters, as ranges."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


#: What a text needs for any transducer to matter, for RE2, which takes one pass: they may say yes too often, never no. The
#: second is for any case.
_LOOKS, _HINT = _ranges("".join(_SAME)), "|".join(
    [
        "&(?:#[0-9xX]|[A-Za-z]{2,12};)|%(?:40|2e)",
        r"[\[({<][ \t]*(?:at|ät|@|a|dot|punkt|punto|point|\.|plus|klammeraffe|arroba|arobase|chez)[ \t]*[\])}>]",
        r"(?:^|[^a-z0-9])(?:dot|punkt|punto|arroba|arobase|klammeraffe)(?:[^a-z0-9]|$)|[ \t\r\n]@[ \t\r\n]|[ \t]point[ \t]+[0-9]|(?:^|[^a-z0-9])plus[ \t]+\(?[1-9]",
        r"[ \t\r\n](?:at|ät)[ \t\r\n]+[a-z0-9-]+\.[a-z0-9]|[_-]at[_-]",
        "[0-9][oil]|[oil][0-9]",
        rf"(?:^|[^a-z0-9])(?:double|triple|{_WORD}){_BETWEEN}{_WORD}|\+[ \t]*{_WORD}|[0-9][ \t-]*{_WORD}[ \t-]*[0-9]",
    ]
)
_ONE_BEFORE = re.compile(r"(?:\+|plus|dot|punkt|punto|point|[.\])}>])[ \t]*$", re.I)
_ONE_AFTER = re.compile(r"[ \t]*(?:dot|punkt|punto|point|[\[({<])", re.I)


def disguised(text: str) -> dict[str, list[Span]]:
    """Spans of the source that a detector finds only in the rewritten text."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    plain = Mapped(text).rewritten(_CHARACTERS, _character).rewritten(_SPOKEN, _spoken).rewritten(_LETTERED, _lettered).rewritten(_BRACKETED, _bracketed)
    worded = plain.rewritten(_WORDS, _words)
    found = [(k, plain, at) for k, spans in detected(plain.text).items() for at in spans] if plain.below else []
    found = [x for x in found if x[0] != "email" or plain.text[x[2][0] : x[2][1]].rsplit(".", 1)[1].isalpha()]
    if worded is not plain:
        found += [("email", worded, at) for at in addresses(worded.text)]
    for kind, layer, (start, end) in found:
        first, last, changed = layer.source(start, end)
        if changed:
            out[kind].append((first, last))
    return out


def spans_of(text: str, rewrite: bool = True) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(plain spans, all spans) by kind, in code points. A disguised span that meets a plain one of its kind counts only if it
    holds all of it and more; one that meets another disguised one of its kind, only if it is the longer, or the first.
    rewrite: whether hinted() says that it is worth while."""
    base = detected(text)
    every = {k: list(v) for k, v in base.items()}
    for kind, spans in disguised(text).items() if rewrite else ():
        taken: list[Span] = []
        for s, e in sorted(set(spans), key=lambda x: (x[0] - x[1], x)):
            over = [b for b in base[kind] if b[0] < e and s < b[1]]
            if all(s <= b[0] and b[1] <= e and (s, e) != b for b in over) and not any(a < e and s < b for a, b in taken):
                taken.append((s, e))
        every[kind] += taken
    return base, every


def written(spans: dict[str, list[Span]]) -> str:
    rows = sorted((s, KINDS.index(k), e) for k, v in spans.items() for s, e in v)
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)


def hinted(texts: pa.Array) -> pa.Array:
    """Whether a transducer may change what is found in a text."""
    return pc.or_(pc.match_substring_regex(texts, _HINT, ignore_case=True), pc.match_substring_regex(texts, _LOOKS))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hints = hinted(b["text"])
        looks = pc.or_(hints, pc.match_substring_regex(b["text"], "[0-9@]"))
        none = {k: [] for k in KINDS}
        rows = [spans_of(t.as_py(), hint.as_py()) if look.as_py() else (none, none) for t, hint, look in zip(b["text"], hints, looks)]
        counts = [pa.array([len(base[k]) for base, _ in rows], pa.int64()) for k in KINDS]
        base = [written(x) for x, _ in rows]
        every = [written(x) if x != y else s for (y, x), s in zip(rows, base)]
        yield pa.RecordBatch.from_arrays([b["id"], *counts, pa.array(base, pa.string()), pa.array(every, pa.string())], ["id", *(f"n_{k}" for k in KINDS), "base", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans) for every row: the numbers of plain matches, they as
    kind:start:end by start and kind, joined by commas, and all spans in the same form.

    Places are code points, the end exclusive. Null and empty texts have no spans. Null ids and repeated rows are rows of
    their own. Texts are read whole, whatever their length. An empty table gives an empty result. Other columns aren't
    read, whatever their names.
    """
    return C.inputs(docs, id=id_col, text=text_col).mapInArrow(_found, "id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def masked(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans of personal_data() replaced by their kinds in brackets; of spans that meet, the first and longest.
    Ids must not be null or repeated; rows without spans keep their text."""

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b[text_col].to_pylist(), b["_spans"].to_pylist()):
                rows = sorted(((int(s), -int(e), k) for k, s, e in (x.split(":") for x in (spans or "").split(",") if x)))
                pieces, at = [], 0
                for s, e, k in rows:
                    if s >= at:
                        pieces += [text[at:s], f"[{k}]"]
                        at = -e
                out.append("".join([*pieces, text[at:]]) if rows else text)
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type)).drop_columns(["_spans"])

    joined = docs.join(found.where("spans <> ''").select(F.col("id").alias(id_col), F.col("spans").alias("_spans")), id_col, "left").select(*docs.columns, "_spans")
    return joined.mapInArrow(masks, docs.schema)


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    out = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return out.select(F.col("id").alias("doc_id"), *(f"n_{k}" for k in KINDS), digest, "spans")
