"""Time bins with a gap-free spine."""

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.column import Column

# bin -> (unit of date_trunc, step between bins)
BINS = {"day": ("day", "interval 1 day"), "week": ("week", "interval 7 days"),
        "month": ("month", "interval 1 month"), "quarter": ("quarter", "interval 3 months"),
        "year": ("year", "interval 1 year")}


def bin_start(value, by: str) -> Column:
    """First date of the bin (weeks start on Monday)."""
    c = F.col(value) if isinstance(value, str) else value
    return F.date_trunc(BINS[by][0], c).cast("date")


def bin_end(start: Column, by: str) -> Column:
    """Last date of the bin (weeks end on Sunday)."""
    if by == "day":
        return start
    if by == "week":
        return F.date_add(start, 6)
    months = {"month": 1, "quarter": 3, "year": 12}[by]
    return F.date_sub(F.add_months(start, months), 1)


def fill_bins(counts: DataFrame, keys, by: str, zero: list[str]) -> DataFrame:
    """Add the missing bins between the first and the last of each key, with zeros.

    ``counts`` holds at most one row per key and bin in column ``bin``, so a key is no longer than the
    calendar. Every row also produces the empty bins up to its successor; the input is read once.
    """
    keys = list(keys)
    following = F.lead("bin").over(W.partitionBy(*keys).orderBy("bin"))
    reach = F.sequence("bin", "_next", F.expr(BINS[by][1]))
    bins = F.when(F.col("_next").isNull(), F.array("bin")).otherwise(
        F.slice(reach, F.lit(1), F.size(reach) - 1))
    spread = counts.withColumn("_next", following).select(
        *keys, *zero, F.posexplode(bins).alias("_place", "bin"))
    return spread.select(*keys, "bin", *[
        F.when(F.col("_place") == 0, F.col(c)).otherwise(F.lit(0)).alias(c) for c in zero])
