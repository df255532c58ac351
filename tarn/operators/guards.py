"""Checks that are part of a plan: whatever reads a guarded table fails before its first row if a check finds a violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded(df: DataFrame, **violations: DataFrame) -> DataFrame:
    """df, which can't be read or written if one of the tables violations (what string) has a row. The error has the name of the
    check with spaces, how many there are and the first. A check is one row that is broadcast, however many there are. A table without rows
    has nothing to be kept from, and may pass."""
    for name, rows in violations.items():
        found = rows.agg(F.count("*").alias("n"), F.min("what").alias("first"))
        message = F.concat(F.lit(name.replace("_", " ") + ": "), F.col("n").cast("string"), F.lit(", the first is "), F.coalesce("first", F.lit("null")))
        ok = found.select(F.when(F.col("n") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
        df = df.join(F.broadcast(ok)).where("_ok").drop("_ok")
    return df


def _what(c) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("what")


def repeated(df: DataFrame, key: str) -> DataFrame:
    """The values of key that are there twice or more."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(_what(key))


def scored_with_tests(results: DataFrame, tests: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(results joined with their tests, tests without a result). Results with an unknown key, and tests with a repeated one,
    abort."""
    unknown = results.join(tests.select(key), key, "left_anti").select(_what(key))
    return guarded(results.join(tests, key), unknown_ids=unknown, repeated_test_ids=repeated(tests, key)), tests.join(results.select(key), key, "left_anti")


def question_set(rows: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """rows (id, question, label) of a set of questions: ids there and unique, questions not blank, and, where `sizes` says so,
    as many of each label as it says; else reading fails."""
    blank = rows.where(F.col("question").isNull() | (F.trim("question") == "")).select(_what("id"))
    checks = {"missing_ids": rows.where("id is null").select(_what("question")), "repeated_ids": repeated(rows.where("id is not null"), "id"), "blank_questions": blank}
    if sizes:
        want = rows.sparkSession.createDataFrame(list(sizes.items()), "label string, want long")
        have = rows.groupBy("label").agg(F.count("*").alias("have"))
        off = want.join(have, "label", "full").where("coalesce(want, 0) <> coalesce(have, 0)")
        checks["wrong_sizes"] = off.select(F.concat(F.coalesce("label", F.lit("null")), F.lit(": "), F.coalesce("have", F.lit(0)).cast("string"), F.lit(" for "), F.coalesce("want", F.lit(0)).cast("string")).alias("what"))
    return guarded(rows, **checks)


def cache_key(model: str, dims: int, id_: F.Column, text: F.Column) -> Column:
    """What a vector is cached by: model, dimensions, id and the whole text."""
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(dims)), id_.cast("string"), F.coalesce(text, F.lit(""))), 256)


def cached_vectors(rows: DataFrame, cache: DataFrame, model: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their vectors from the cache, rows to embed). rows (id, text), cache (key, vector).

    An empty vector, or one of other dimensions than `dims`, aborts, as does a key that is there twice.
    """
    keyed = rows.withColumn("key", cache_key(model, dims, F.col("id"), F.col("text")))
    used = cache.join(keyed.select("key"), "key", "left_semi")
    wrong = used.where(F.coalesce(F.size("vector"), F.lit(-1)) != dims).select(_what("key"))
    hits = guarded(keyed.join(used, "key"), wrong_dimensions=wrong, repeated_keys=repeated(used, "key"))
    return hits.drop("key"), keyed.join(cache.select("key"), "key", "left_anti").drop("key")


def complete_numbers(rows: DataFrame, number: str, least: int, most: int) -> DataFrame:
    """rows, none of whose numbers from least to most may be missing."""
    whole = rows.sparkSession.range(least, most + 1).select(F.col("id").cast("string").alias("what"))
    return guarded(rows, missing_numbers=whole.join(rows.select(F.col(number).cast("string").alias("what")), "what", "left_anti"))


def sized_between(rows: DataFrame, least: int, most: int) -> DataFrame:
    n = rows.agg(F.count("*").alias("n"))
    return guarded(rows, wrong_number_of_rows=n.where(~F.col("n").between(least, most)).select(_what("n")))


def in_file_order(df: DataFrame) -> DataFrame:
    """df, read from Parquet files, with ordinal: the place of a row in its files, in the order of their names, from 0.

    Rows know their place in a file; what is added are the rows of the files before, one number a file.
    """
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(files.withColumn("_before", before).drop("_n")), "_file").withColumn("ordinal", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")
