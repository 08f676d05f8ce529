"""Exact quantiles with linear interpolation, from value counts."""

from pyspark.sql import DataFrame, functions as F

from revloom.plans.order import with_position
from revloom.plans.skew import attach


def count_quantiles(values: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles per key of a column of counts, one output column per name in ``probs``.

    The rows shrink to one per distinct value before a key meets in one task. Counts that add up to
    N hold at most sqrt(2 N) distinct values, so this stays small at any scale.
    """
    keys = list(keys)
    hist = values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"))
    return hist.groupBy(*keys).agg(*[
        F.percentile(value, F.lit(p), F.col("_n")).alias(name) for name, p in probs.items()])


def exact_quantiles(values: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """The same for values of any kind: ranks of the distinct values come from a range-partitioned
    running total, and only the two values next to each target rank are kept."""
    keys = list(keys)
    hist = (values.filter(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).cast("double").alias("_v"))
            .agg(F.count(F.lit(1)).alias("_n")))
    ranked = with_position(hist, keys, [F.col("_v").asc()], totals=["_n"])
    size = ranked.groupBy(*keys).agg(F.max("running__n").alias("_total"))
    # a rank r (from 0) falls on the value whose run of ranks [end - n, end) holds it
    end, start = F.col("running__n"), F.col("running__n") - F.col("_n")
    sized = attach(ranked, size, keys, spread=["_v"])
    aggs = []
    for name, p in probs.items():
        target = (F.col("_total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(target)), ("hi", F.ceil(target))):
            aggs.append(F.max(F.when((start <= rank) & (rank < end), F.col("_v")))
                        .alias(f"_{name}_{side}"))
    picked = sized.groupBy(*keys, "_total").agg(*aggs)
    out = []
    for name, p in probs.items():
        target = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low + (high - low) * (target - F.floor(target))).alias(name))
    return picked.select(*keys, *out)
