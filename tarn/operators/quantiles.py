"""Exact order statistics of groups of any size: no group is sorted, and none is held by one task.

The row with a rank is looked for by range. A range of values is cut into BUCKETS equal parts, of which only numbers, least and
most are kept; the part that holds the rank is the next range, and the rank is counted from its start. A range ends as one
value, or has so few rows that they are numbered. What is shuffled a round are the numbers of parts, whatever the rows are;
after six rounds at most a range is one value, and small groups need none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.retrieval import small
from tarn.sources.shared import checkpointed

#: Parts of a range, and rows of a range that are numbered in one task.
BUCKETS, FEW = 1024, 10_000


def _within(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (_g, _v) with the ranges (_g, lo, hi, ...) of their group that hold them."""
    return rows.join(small(ranges), "_g").where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))


def _part() -> Column:
    """The part of its range that a value is in: equal ones of a range within one sign and a factor of BUCKETS, else one for each
    sign and power of 2, so that ranges of any width narrow as fast."""
    v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
    # halves, as the difference of two values may be beyond doubles
    even = F.least(F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * BUCKETS), F.lit(BUCKETS - 1))
    power = F.when(v == 0, F.lit(0).cast("long")).otherwise(F.signum(v).cast("long") * (F.floor(F.log2(F.abs(v))) + 1100))
    narrow = ((lo > 0) & (hi / BUCKETS <= lo)) | ((hi < 0) & (lo / BUCKETS >= hi))
    return F.when(narrow, even).otherwise(power)


def at_ranks(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """(_g, rank, value) of asks (_g, rank, n, lo, hi): the value at each rank, from 0, of the n values of a group, which are
    between lo and hi. rows (_g, _v) have finite doubles."""
    open_, out = checkpointed(asks.select("_g", "rank", F.col("rank").alias("off"), "n", "lo", "hi")), None
    while True:
        done = open_.where("lo = hi").select("_g", "rank", F.col("lo").alias("value"))
        out = done if out is None else out.unionByName(done)
        large = open_.where(f"lo < hi and n > {FEW}")
        if large.limit(1).count() == 0:
            break
        ranges = large.select("_g", "lo", "hi").distinct()
        counts = _within(rows, ranges).groupBy("_g", "lo", "hi", _part().alias("part")).agg(F.count("*").alias("m"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        # BUCKETS rows a range at most
        upto = F.sum("m").over(Window.partitionBy("_g", "lo", "hi").orderBy("part"))
        parts = counts.withColumn("upto", upto)
        found = large.join(parts, ["_g", "lo", "hi"]).where("off < upto and off >= upto - m")
        found = found.select("_g", "rank", (F.col("off") - F.col("upto") + F.col("m")).alias("off"), F.col("m").alias("n"), F.col("least").alias("lo"), F.col("most").alias("hi"))
        open_ = checkpointed(found.unionByName(open_.where(f"lo < hi and n <= {FEW}")))
    few = open_.where("lo < hi")
    numbered = _within(rows, few.select("_g", "lo", "hi").distinct()).withColumn("off", F.row_number().over(Window.partitionBy("_g", "lo", "hi").orderBy("_v")) - 1)
    return out.unionByName(few.join(numbered, ["_g", "lo", "hi", "off"]).select("_g", "rank", F.col("_v").alias("value")))


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], floor: bool = False) -> DataFrame:
    """(by..., n, a column for each share): percentiles of the values of each group.

    The place of a share is share * (n - 1); between two ranks the value is interpolated, or with floor it is that of the
    lower rank. Null, NaN and infinite values don't count; a group without another has none. Null keys are a group.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.struct(*by).alias("_g"), v.alias("_v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    groups = checkpointed(rows.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    place = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("place")) for name, p in shares.items()))
    asked = groups.select("_g", "n", "lo", "hi", F.explode(place).alias("a")).select("_g", "n", "lo", "hi", "a.*").withColumn("low", F.floor("place"))
    asked = asked.withColumn("high", F.lit(None).cast("long") if floor else F.least(F.col("low") + 1, F.col("n") - 1))
    ranks = asked.select("_g", "n", "lo", "hi", F.explode(F.array_distinct(F.array_compact(F.array("low", "high")))).alias("rank")).distinct()
    values = checkpointed(at_ranks(rows, ranks))
    take = lambda c: values.select("_g", F.col("rank").alias(c), F.col("value").alias(f"{c}_value"))
    out = asked.join(take("low"), ["_g", "low"]).join(take("high"), ["_g", "high"], "left")
    share = F.col("place") - F.col("low")
    whole = F.when(F.col("high").isNull() | (share == 0), F.col("low_value")).otherwise(F.col("low_value") + share * (F.col("high_value") - F.col("low_value")))
    wide = out.groupBy("_g", "n").agg(*(F.max(F.when(F.col("name") == name, whole)).alias(name) for name in shares))
    return wide.select("_g.*", "n", *shares)
