"""Pieces of SQL that several twins share: the text rules of tarn.functions.text as expressions over lists."""

from tarn.functions import text as T


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def among(words: list[str]) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN {among(T.STOP)})"


def stems(tokens_: str) -> str:
    cut = " ".join(f"WHEN length(t) > {len(s) + 3} AND ends_with(t, '{s}') THEN left(t, length(t) - {len(s)})" for s in T.SUFFIXES)
    bare = " ".join(f"WHEN length(t) > {len(p) + 3} AND starts_with(t, '{p}') THEN substr(t, {len(p) + 1})" for p in T.PREFIXES)
    return f"list_transform(list_transform({tokens_}, lambda t: CASE {cut} ELSE t END), lambda t: CASE {bare} ELSE t END)"


def keys(tokens_: str) -> str:
    return f"list_transform({stems(tokens_)}, lambda t: CASE WHEN regexp_matches(t, '^[0-9]+$') THEN t ELSE substr(t, 1, 6) END)"


def english(x: str) -> str:
    words = f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z]+')"
    return f"len({words}) > 0 AND 20 * len(list_filter({words}, lambda t: t IN {among(T.ENGLISH)})) > len({words})"


def boilerplate(x: str) -> str:
    count = lambda p: f"len(regexp_extract_all(coalesce({x}, ''), {quoted(p)}))"
    return f"least(1.0, (12.0 * {count(T.BOILERPLATE)} + 25.0 * {count(T.BIBLIOGRAPHY)}) / greatest(1, len(regexp_extract_all(coalesce({x}, ''), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'))))"


def hard_anchors(x: str) -> str:
    """Before the first twelve distinct ones are taken."""
    x = f"coalesce({x}, '')"
    hard = rf"regexp_extract_all({x}, '[\w.\-]+@[\w.\-]+|\b[0-9][0-9.,/-]*[0-9]\b|\b[0-9]+\b')"
    inner = rf"flatten(list_transform(string_split(regexp_replace({x}, '([.;:])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: regexp_extract_all(s, '[A-Za-zÀ-ÿ]+')[2:]))"
    proper = f"list_transform(list_filter({inner}, lambda w: regexp_matches(w, '^[A-ZÀ-ÖØ-Þ]') AND lower(w) NOT IN {among([*T.STOP, *T.PRONOUNS])}), lambda w: lower(w))"
    return f"list_concat({hard}, {proper})"


def distinct_in_order(x: str) -> str:
    """The distinct values of a list, each at its first place."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


#: idf(key, df, idf) over all documents, and n, their number.
IDF = f"""n AS (SELECT count(*) AS n FROM documents), idf AS (SELECT key, count(*) AS df, greatest(ln(any_value(n) / (1 + count(*))) + 1, 0.05) AS idf
  FROM (SELECT doc_id, unnest(list_distinct({keys(tokens('text'))})) AS key FROM documents), n GROUP BY key)"""
