"""Cleaning and parsing of text as column functions. Null texts count as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Glyph and patterns of the cleaning rules.
BULLET = "•"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
#: Words without content, affixes of the stemmer in the order they are tried, words that mark English text.
STOP = (
    "yang dan di ke dari untuk pada dengan dalam adalah atau apa siapa bagaimana kapan mana saja apakah itu ini ada tidak bisa dapat oleh sebagai akan "
    "juga agar jika maka tersebut para serta secara harus telah sudah bagi antara tentang terhadap sebuah suatu setiap kepada karena namun tetapi lain "
    "lainnya kah nya yg utk dgn dr pd berapa mengapa kenapa apabila bila hal seperti sesuai berdasarkan menurut kalau gimana gmn buat aja sih dong nih "
    "kalo emang kok terus lalu"
).split()
SUFFIXES = "kannya annya nya kan lah kah pun an i".split()
PREFIXES = "memper meng meny mem men me peng peny pem pen per ber ter di ke se".split()
ENGLISH = "the of and for in shall article chapter with paragraph is are that provisions rights carried out based".split()
PRONOUNS = "anda kami saya mereka beliau".split()
#: Citations, bibliography, references to a given context, questions that name their own source, metadata.
BOILERPLATE = r"(?i)Lembaran Negara|Berita Negara|Tambahan Lembaran|Mengingat\s*:|Menimbang\s*:|Undang-Undang Nomor|Peraturan Menteri|Peraturan Pemerintah Nomor"
BIBLIOGRAPHY = r"\((?:[A-Z][^()]{2,40}:\s*)?[^()]{3,70},\s*(?:19|20)[0-9]{2}\)"
CONTEXT_REFERENCE = (
    r"(?i)berdasarkan (rujukan|informasi|konteks|teks|dokumen|data|penjelasan)[^,.?]{0,25}(diberikan|disediakan|tersebut|ini)|dalam konteks yang diberikan"
    r"|menurut (teks|konteks|dokumen) (di atas|tersebut|ini)|yang (diberikan|disebutkan) (dalam|di) (konteks|teks)"
)
SELF_CITING = r"(?i)pasal\s*[0-9]+[^?]{0,60}?(nomor|no\.)\s*[0-9]+|(permendagri|undang-undang|perda|perbup|peraturan pemerintah)\s*(nomor|no\.)?\s*[0-9]+\s*tahun\s*[0-9]{4}"
METADATA_ONLY = r"(?i)berstatus\s*['\"‘’]?\s*(tidak|masih)\s+berlaku|berdasarkan metadata|metadata dokumen|status\s+(keberlakuan|dokumen|peraturan)\b"


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_page(x: Column) -> Column:
    """Drop dot leaders and lines of a page number, join wrapped lines, collapse blanks and blank lines, trim."""
    for pattern, to in ((r"\.{3,}", ""), (r"(?m)^\s*\d{1,3}\s*$", ""), (r"(?<![.!?:\-])\n(?=[a-zA-Z])", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, to)
    return trimmed(x)


def clean_cell(x: Column) -> Column:
    """Without the glyph of lists, blanks and tabs collapsed, trimmed; line breaks stay."""
    return trimmed(F.regexp_replace(F.replace(_text(x), F.lit(BULLET), F.lit("")), r"[ \t]+", " "))


def cell_lines(x: Column) -> Column:
    return F.filter(F.transform(F.split(_text(x), "\n"), clean_cell), lambda s: s != "")


def email_of(x: Column) -> Column:
    """The e-mail address of the last line that has one, without final dots; null if none has."""
    hits = F.filter(F.transform(cell_lines(x), lambda s: F.regexp_extract(s, EMAIL, 0)), lambda s: s != "")
    return F.regexp_replace(F.try_element_at(hits, F.lit(-1)), r"\.+$", "")


def address_of(x: Column) -> Column:
    return F.array_join(F.filter(cell_lines(x), lambda s: ~s.rlike(EMAIL)), " ")


def phones_of(x: Column) -> Column:
    return F.filter(F.transform(F.split(clean_cell(F.replace(_text(x), F.lit("\n"), F.lit(" "))), "/"), trimmed), lambda s: s != "")


def first_prefix(x: Column, prefixes: list[str], default: str) -> Column:
    """The first of the prefixes that x starts with."""
    return F.coalesce(*(F.when(trimmed(_text(x)).startswith(p), F.lit(p)) for p in prefixes), F.lit(default))


def sub_letter(x: Column) -> Column:
    found = F.regexp_extract(clean_cell(x), r"^([a-z])\.\s+(.+)$", 1)
    return F.when(found != "", found)


def sub_name(x: Column) -> Column:
    found = F.regexp_extract(clean_cell(x), r"^([a-z])\.\s+(.+)$", 2)
    return F.when(found != "", found).otherwise(clean_cell(x))


def slugify(x: Column) -> Column:
    x = F.regexp_replace(F.lower(trimmed(_text(x))), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(x, r"[\s_]+", "-"), r"-+", "-")


def _singles(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: F.length(t) == 1))


def _filled(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda t: t != "")


def is_charspaced(x: Column) -> Column:
    """Whether a page has 20 tokens or more, over half of them of one character."""
    tokens = F.filter(F.split(_text(x), r"\s+"), lambda t: t != "")
    return (F.size(tokens) >= 20) & (_singles(tokens) / F.size(tokens) > 0.5)


def despaced_lines(x: Column) -> Column:
    """Lines of spaced letters are joined to words; two or more blanks part words."""

    def line(s: Column) -> Column:
        tokens = _filled(s)
        words = F.filter(F.transform(F.split(s, "  +"), lambda w: F.replace(w, F.lit(" "), F.lit(""))), lambda w: w != "")
        return F.when((F.size(tokens) >= 4) & (_singles(tokens) / F.size(tokens) > 0.6), F.array_join(words, " ")).otherwise(s)

    return F.array_join(F.transform(F.split(_text(x), "\n"), line), "\n")


def rebuilt_page(x: Column) -> Column:
    """A page of spaced letters as one run of text: lines joined, a blank where letters meet digits."""

    def line(s: Column) -> Column:
        tokens = _filled(s)
        joined = F.regexp_replace(F.array_join(tokens, ""), r"(?<=[A-Za-z])(?=\d)|(?<=\d)(?=[A-Za-z])", " ")
        return F.when((F.size(tokens) >= 2) & (_singles(tokens) / F.size(tokens) > 0.6), joined).otherwise(trimmed(s))

    return F.array_join(F.filter(F.transform(F.split(_text(x), "\n"), line), lambda s: s != ""), " ")


def fix_charspacing(x: Column) -> Column:
    return F.when(is_charspaced(x), rebuilt_page(x)).otherwise(despaced_lines(x))


def words(x: Column) -> Column:
    """Unicode words in lower case."""
    return F.regexp_extract_all(F.lower(_text(x)), F.lit(r"(?U)(\w+)"), F.lit(1))


def content_tokens(x: Column) -> Column:
    """Runs of ASCII letters and digits of three characters or more that aren't stop-words, in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(_text(x)), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP))


def _first(w: Column, choices: list[tuple[Column, Column]]) -> Column:
    out = w
    for test, to in reversed(choices):
        out = F.when(test, to).otherwise(out)
    return out


def unsuffixed(w: Column) -> Column:
    """Without the longest of the suffixes that leaves more than three letters."""
    return _first(w, [((F.length(w) > len(s) + 3) & w.endswith(s), F.left(w, F.length(w) - len(s))) for s in SUFFIXES])


def unprefixed(w: Column) -> Column:
    """Without the first of the prefixes that leaves more than three letters."""
    return _first(w, [((F.length(w) > len(p) + 3) & w.startswith(p), F.substring(w, F.lit(len(p) + 1), F.length(w))) for p in PREFIXES])


def stems(tokens: Column) -> Column:
    return F.transform(F.transform(tokens, unsuffixed), unprefixed)


def keys(tokens: Column) -> Column:
    """What tokens are matched by: numbers as they are, words by the first six letters of their stem."""
    return F.transform(stems(tokens), lambda t: F.when(t.rlike("^[0-9]+$"), t).otherwise(F.substring(t, 1, 6)))


def is_english(x: Column) -> Column:
    """Whether more than one word in twenty marks English."""
    tokens = F.regexp_extract_all(F.lower(_text(x)), F.lit("([a-z]+)"), F.lit(1))
    return (F.size(tokens) > 0) & (20 * F.size(F.filter(tokens, lambda t: t.isin(*ENGLISH))) > F.size(tokens))


def boilerplate(x: Column) -> Column:
    """How much of a text is citations and bibliography: 12 and 25 words for each, over its words."""
    hits = 12.0 * F.regexp_count(_text(x), F.lit(BOILERPLATE)) + 25.0 * F.regexp_count(_text(x), F.lit(BIBLIOGRAPHY))
    return F.least(F.lit(1.0), hits / F.greatest(F.lit(1), F.regexp_count(_text(x), F.lit(r"(?U)\w+"))))


def hard_anchors(x: Column) -> Column:
    """The first twelve distinct e-mail addresses and numbers, then capitalised words inside sentences in lower case."""
    x = _text(x)
    hard = F.regexp_extract_all(x, F.lit(r"([\w.\-]+@[\w.\-]+|\b[0-9][0-9.,/-]*[0-9]\b|\b[0-9]+\b)"), F.lit(1))
    sentences = F.split(F.regexp_replace(x, r"([.;:])\s+", "$1\n"), "\n")
    inner = F.flatten(F.transform(sentences, lambda s: F.slice(F.regexp_extract_all(s, F.lit("([A-Za-zÀ-ÿ]+)"), F.lit(1)), 2, 1 << 30)))
    proper = F.transform(F.filter(inner, lambda w: w.rlike("^[A-ZÀ-ÖØ-Þ]") & ~F.lower(w).isin(*STOP, *PRONOUNS)), F.lower)
    return F.slice(F.array_distinct(F.concat(hard, proper)), 1, 12)


def char_ratio(x: Column) -> Column:
    """Part of the characters that are letters, digits, blanks or usual marks; null for an empty text."""
    good = F.regexp_count(_text(x), F.lit("[A-Za-z0-9 \n.,;:!?()-]"))
    return F.when(F.length(_text(x)) > 0, good / F.length(_text(x)))


def number_support(x: Column, gold: Column) -> Column:
    """Part of the numbers of x that gold has as whole words; 1, 2 and 3 don't count among more than two numbers."""
    numbers = F.regexp_extract_all(_text(x), F.lit("([0-9]+)"), F.lit(1))
    kept = F.when(F.size(numbers) > 2, F.filter(numbers, lambda n: ~n.isin("1", "2", "3"))).otherwise(numbers)
    there = F.regexp_extract_all(_text(gold), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.when(F.size(kept) == 0, F.lit(1.0)).otherwise(F.size(F.filter(kept, lambda n: F.array_contains(there, n))) / F.size(kept))
