"""Persistence metrics of commits."""

from pyspark.sql import DataFrame, functions as F

from revloom.functions import scalars
from revloom.plans.order import carry_last, with_position
from revloom.plans.skew import attach_measured


def persistence_metrics(commits: DataFrame) -> DataFrame:
    """Add ``architectural_metrics`` (age_days, age_months, churn_rate, survival_rate, asi).

    ``commits`` needs ``lines_changed``. Age counts from the first commit of the repository, so
    survival grows with the lateness of a commit; the index divides it by one plus normalised churn,
    and only the stored values are rounded. The bounds per repository are computed and counted first,
    so that the wide commit rows need no shuffle where the bounds can be broadcast.
    """
    dated = commits.filter(F.col("date").isNotNull())
    bounds = dated.groupBy("repo").agg(
        F.min("date").alias("_start"), F.max("date").alias("_end"),
        F.max("lines_changed").alias("_top"))
    age = scalars.age_days("_start", "date")
    months = F.greatest(F.lit(1.0), age / F.lit(30.44))
    survival = F.coalesce(scalars.ratio(age, scalars.age_days("_start", "_end")), F.lit(0.0))
    churn = F.coalesce(scalars.ratio("lines_changed", "_top"), F.lit(0.0))
    metrics = F.struct(
        age.alias("age_days"), F.round(months, 2).alias("age_months"),
        F.round(F.col("lines_changed") / months, 2).alias("churn_rate"),
        F.round(survival, 4).alias("survival_rate"),
        F.round(survival / (F.lit(1.0) + churn), 4).alias("asi"))
    return (attach_measured(dated, bounds, ["repo"], spread=["hash"])
            .withColumn("architectural_metrics", metrics).drop("_start", "_end", "_top"))


def asi_trend(metrics: DataFrame, days: int = 30, asi: str = "asi") -> DataFrame:
    """Trailing mean of ``asi`` over (t - days, t], one row per distinct time.

    Rows shrink to one per time first. A trailing sum is the running sum at t less the one as of
    t - days; both come from range-partitioned orders, so the work is linear and a hot repository is
    spread. Sums are decimals, so that a difference loses nothing.
    """
    moments = metrics.filter(F.col(asi).isNotNull()).groupBy("repo", "date").agg(
        F.sum(F.col(asi).cast("decimal(24,12)")).alias("sum"), F.count(F.lit(1)).alias("n")).withColumn(
        "_t", F.unix_micros("date"))
    summed = with_position(moments, ["repo"], [F.col("_t").asc()], totals=["sum", "n"])
    span = days * scalars.DAY_MICROS
    totals = F.struct(F.col("running_sum").alias("sum"), F.col("running_n").alias("n"))
    # every moment is told at its own time (first) and asks at t - days
    told = summed.select("repo", F.col("_t").alias("at"), F.lit(0).alias("kind"), totals.alias("known"),
                         F.lit(None).cast("timestamp").alias("date"), totals.alias("own"))
    asks = summed.select("repo", (F.col("_t") - F.lit(span)).alias("at"), F.lit(1).alias("kind"),
                         F.lit(None).cast(told.schema["known"].dataType).alias("known"), "date",
                         totals.alias("own"))
    before = carry_last(told.unionByName(asks), ["repo"], [F.col("at").asc(), F.col("kind").asc()],
                        "known", "before").filter(F.col("kind") == 1)
    total = (F.col("own.sum") - F.coalesce(F.col("before.sum"), F.lit(0))).cast("double")
    count = F.col("own.n") - F.coalesce(F.col("before.n"), F.lit(0))
    return before.select("repo", "date", (total / count).alias("asi_trend"))
