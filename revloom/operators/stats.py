"""Descriptive statistics of commit metrics."""

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, functions as F

from revloom.plans.quantiles import count_quantiles, exact_quantiles
from revloom.plans.skew import attach

# fixed values: metrics that a summary covers, as far as they exist
METRICS = ("asi", "survival_rate", "churn_rate", "age_days", "lines_changed", "insertions",
           "deletions")


def asi_summary(metrics: DataFrame) -> DataFrame:
    """Mean, median, commits above 0.8 and below 0.3. The index has four digits, hence few values."""
    hist = metrics.filter(F.col("asi").isNotNull()).groupBy("repo", "asi").agg(
        F.count(F.lit(1)).alias("_n"))
    return hist.groupBy("repo").agg(
        (F.sum(F.col("asi") * F.col("_n")) / F.sum("_n")).alias("avg_asi"),
        F.percentile("asi", F.lit(0.5), F.col("_n")).alias("median_asi"),
        F.coalesce(F.sum(F.when(F.col("asi") > 0.8, F.col("_n"))), F.lit(0))
        .alias("high_stability_commits"),
        F.coalesce(F.sum(F.when(F.col("asi") < 0.3, F.col("_n"))), F.lit(0))
        .alias("low_stability_commits"))


def describe(metrics: DataFrame, columns=METRICS) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum of each metric."""
    have = [c for c in columns if c in metrics.columns]
    values = metrics.select("repo", *[F.col(c).cast("double") for c in have]).unpivot(
        "repo", have, "metric", "value")
    basic = values.groupBy("repo", "metric").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    quartiles = exact_quantiles(values, ["repo", "metric"], "value",
                                {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return basic.join(quartiles, ["repo", "metric"], "left")


def correlations(metrics: DataFrame, columns=METRICS) -> DataFrame:
    """Pearson correlation of every pair of metrics in one aggregation, as (x, y, r)."""
    have = [c for c in columns if c in metrics.columns]
    pairs = list(combinations_with_replacement(have, 2))
    wide = metrics.groupBy("repo").agg(*[
        F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"{x}|{y}")
        for x, y in pairs])
    cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{x}|{y}").alias("r"))
             for x, y in pairs for a, b in {(x, y), (y, x)}]
    return wide.select("repo", F.explode(F.array(*cells)).alias("_c")).select("repo", "_c.*")


def histogram(values: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal bins between minimum and maximum (the last one closed), all bins present."""
    rows = values.filter(F.col(value).isNotNull()).groupBy(
        "repo", F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ends = rows.groupBy("repo").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    # one single value gets a range of its own, half a unit to each side
    ends = ends.select("repo",
                       F.when(F.col("_a") == F.col("_b"), F.col("_a") - 0.5)
                       .otherwise(F.col("_a")).alias("_lo"),
                       F.when(F.col("_a") == F.col("_b"), F.col("_b") + 0.5)
                       .otherwise(F.col("_b")).alias("_hi"))
    slot = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1,
                   F.lit(bins))
    counts = attach(rows, ends, ["repo"], spread=["_v"]).groupBy(
        "repo", slot.cast("int").alias("bin")).agg(F.sum("_n").alias("_count"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    spine = ends.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return spine.join(counts, ["repo", "bin"], "left").select(
        "repo", "bin", (F.col("_lo") + width * (F.col("bin") - 1)).alias("lower"),
        (F.col("_lo") + width * F.col("bin")).alias("upper"),
        F.coalesce("_count", F.lit(0)).alias("count"))


def median_line(values: DataFrame, value: str) -> DataFrame:
    return count_quantiles(values, ["repo"], value, {"median": 0.5})


def box_plot(metrics: DataFrame, value: str = "lines_changed") -> DataFrame:
    """Quartiles, whiskers (last value within 1.5 interquartile ranges) and outliers of ``value``
    for commits with a high (> 0.8) and a low (< 0.3) index."""
    side = F.when(F.col("asi") > 0.8, "high").when(F.col("asi") < 0.3, "low")
    rows = metrics.select("repo", side.alias("side"), F.col(value).cast("double").alias("_v"))
    rows = rows.filter(F.col("side").isNotNull() & F.col("_v").isNotNull())
    rows = rows.groupBy("repo", "side", "_v").agg(F.count(F.lit(1)).alias("_n"))
    # quartiles from the value counts: line sums that add up to N have at most sqrt(2 N) values
    cuts = rows.groupBy("repo", "side").agg(*[
        F.percentile("_v", F.lit(p), F.col("_n")).alias(name)
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    return (attach(rows, cuts, ["repo", "side"], spread=["_v"]).groupBy("repo", "side").agg(
        F.sum("_n").alias("count"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        # a whisker never ends inside the box
        F.least(F.first("q1"), F.min(F.when(inside, F.col("_v")))).alias("whisker_low"),
        F.greatest(F.first("q3"), F.max(F.when(inside, F.col("_v")))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("outliers")))
