"""Commit-level analyses."""

from pyspark.sql import DataFrame, Window as W, functions as F

from revloom.functions import scalars, text
from revloom.functions.lookups import FEATURE_WORDS, FIX_WORDS, WEEKDAYS
from revloom.plans.skew import top_n
from revloom.plans.timeline import BINS, bin_end, bin_start, fill_bins


def keyword_commits(commits: DataFrame, words) -> DataFrame:
    """Commits whose message holds one of the words, with ``keywords_matched``. A narrow plan:
    no shuffle, and it runs on a stream as it is."""
    return (commits.filter(text.has_word("message", words))
            .withColumn("keywords_matched", text.matched_words("message", words)))


def bug_fix_commits(commits: DataFrame) -> DataFrame:
    return keyword_commits(commits, FIX_WORDS)


def feature_commits(commits: DataFrame) -> DataFrame:
    return keyword_commits(commits, FEATURE_WORDS)


def newest(commits: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest commits per repository."""
    order = [F.col("date").desc(), F.col("hash").asc()]
    return top_n(commits, ["repo"], order, n, spread=["hash"]).drop("rank")


def commit_frequency(commits: DataFrame, bin_by: str = "month") -> DataFrame:
    """Commits per bin with empty bins as 0; ``period`` is the last day of the bin."""
    by = bin_by.lower() if bin_by.lower() in BINS else "month"
    counts = commits.groupBy("repo", bin_start("date", by).alias("bin")).agg(
        F.count(F.lit(1)).alias("commit_count"))
    full = fill_bins(counts, ["repo"], by, ["commit_count"])
    return full.select("repo", bin_end(F.col("bin"), by).alias("period"), "commit_count")


def monthly_commits(commits: DataFrame) -> DataFrame:
    """Monthly commits with the centred three-month mean and a bar scaled to the busiest month."""
    months = commit_frequency(commits, "month")
    # after the aggregation a repository has one row per month
    near = W.partitionBy("repo").orderBy("period").rowsBetween(-1, 1)
    whole = W.partitionBy("repo")
    enough = (F.count(F.lit(1)).over(near) == 3) & (F.count(F.lit(1)).over(whole) > 3)
    return months.select(
        "repo", "period", F.date_format("period", "yyyy-MM").alias("month"), "commit_count",
        F.when(enough, F.avg("commit_count").over(near)).alias("moving_average"),
        scalars.trend_bar("commit_count", F.max("commit_count").over(whole)).alias("trend"))


def weekday_counts(commits: DataFrame) -> DataFrame:
    """Commits per weekday, all seven days present."""
    counts = commits.groupBy("repo", scalars.day_name("date").alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"))
    days = F.array(*[F.struct(
        F.lit(i).alias("day_number"), F.lit(day).alias("day_of_week"),
        F.coalesce(F.sum(F.when(F.col("_day") == day, F.col("_n"))), F.lit(0)).alias("commit_count"))
        for i, day in enumerate(WEEKDAYS, 1)])
    return counts.groupBy("repo").agg(days.alias("_d")).select("repo", F.inline("_d"))


def hour_counts(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo", F.hour("date").alias("hour")).agg(
        F.count(F.lit(1)).alias("commit_count"))


def year_counts(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo", F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("commit_count"))


def _activity(commits: DataFrame) -> DataFrame:
    """Commits by month, by weekday and by hour in one table of small counts, from one pass.

    Cells of (month, weekday, hour) come first; the grouping sets then only see those few rows.
    """
    parents = (F.col("parents") if "parents" in commits.columns
               else F.array().cast("array<string>"))
    length = (F.length(text.subject_line("message")) if "message" in commits.columns else F.lit(0))
    cells = commits.groupBy(
        "repo", F.date_format("date", "yyyy-MM").alias("month"),
        scalars.day_name("date").alias("day"), F.hour("date").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.count_if(F.size(parents) > 1).alias("merges"), F.sum(length).alias("length"))
    repo, month, day, hour = (F.col(c) for c in ("repo", "month", "day", "hour"))
    return cells.groupingSets([[repo, month], [repo, day], [repo, hour]], repo, month, day, hour).agg(
        *[F.sum(c).alias(c) for c in ("n", "merges", "length")],
        F.min("first").alias("first"), F.max("last").alias("last"))


def _busiest() -> list:
    """Busiest weekday and hour with their counts; on a tie the earlier one."""
    n, day, hour = F.col("n"), F.col("day"), F.col("hour")
    best_day = F.max(F.when(day.isNotNull(), F.struct(
        n, (-scalars.weekday_number("day")).alias("tie"), day)))
    best_hour = F.max(F.when(hour.isNotNull(), F.struct(n, (-hour).alias("tie"), hour)))
    return [best_day["day"].alias("most_active_day"), best_day["n"].alias("most_active_day_count"),
            best_hour["hour"].alias("most_active_hour"), best_hour["n"].alias("most_active_hour_count")]


def commit_overview(commits: DataFrame) -> DataFrame:
    """Total, first and last commit, busiest weekday and hour."""
    return _activity(commits).groupBy("repo").agg(
        F.sum(F.when(F.col("hour").isNotNull(), F.col("n"))).alias("total_commits"),
        F.min("first").alias("first_commit"), F.max("last").alias("last_commit"), *_busiest())


def commit_patterns(commits: DataFrame) -> DataFrame:
    """Busiest weekday and hour, merge share, mean message length, month -> count."""
    by_hour = F.col("hour").isNotNull()

    def total(column):
        return F.sum(F.when(by_hour, F.col(column)))

    # at most one entry per calendar month
    months = F.collect_list(F.when(F.col("month").isNotNull(),
                                   F.struct("month", F.col("n").alias("commit_count"))))
    return _activity(commits).groupBy("repo").agg(
        F.round(total("merges") / total("n") * 100, 2).alias("merge_commit_percentage"),
        F.round(total("length") / total("n"), 2).alias("avg_message_length"), *_busiest(),
        F.map_from_entries(F.array_sort(months)).alias("monthly_commit_trend"))


def activity_heatmap(commits: DataFrame) -> DataFrame:
    """Weekday by hour counts, hours ``h0`` … ``h23`` as columns, all weekdays present."""
    cells = commits.groupBy("repo", scalars.day_name("date").alias("_day"),
                            F.hour("date").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    # a repository has at most 7 * 24 cells
    counts = cells.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws("|", "_day", "_h").alias("cell"), F.col("_n")))).alias("_counts"))
    days = F.array(*[F.struct(F.lit(i).alias("day_number"), F.lit(day).alias("day_of_week"))
                     for i, day in enumerate(WEEKDAYS, 1)])
    return counts.select("repo", "_counts", F.inline(days)).select(
        "repo", "day_number", "day_of_week", *[
            F.coalesce(F.try_element_at("_counts", F.concat_ws("|", "day_of_week", F.lit(h))),
                       F.lit(0)).alias(f"h{h}") for h in range(24)])


def activity_peaks(commits: DataFrame) -> DataFrame:
    overview = commit_overview(commits)
    return overview.select("repo", F.col("most_active_day").alias("peak_activity_day"),
                           F.col("most_active_hour").alias("peak_activity_hour"),
                           F.col("total_commits").alias("total_activity_points"))


def monthly_active_contributors(commits: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct author emails per month, empty months as 0."""
    distinct = (F.approx_count_distinct("author_email") if approximate
                else F.countDistinct("author_email"))
    counts = commits.groupBy("repo", bin_start("date", "month").alias("bin")).agg(
        distinct.alias("active_contributors"))
    full = fill_bins(counts, ["repo"], "month", ["active_contributors"])
    return full.select("repo", F.col("bin").alias("month"), "active_contributors")


def export_commits(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Commits with is_merge, message_length and their line totals (commits without changes: 0)."""
    sizes = changes.groupBy("repo", F.col("commit_hash").alias("hash")).agg(
        F.count(F.lit(1)).alias("files_changed"), F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"))
    counts = ["files_changed", "insertions", "deletions"]
    return (commits.join(sizes, ["repo", "hash"], "left").fillna(0, subset=counts)
            .withColumns({
                "lines_changed": F.col("insertions") + F.col("deletions"),
                "subject": text.subject_line("message"),
                "message_length": F.length(text.subject_line("message")).cast("long"),
                "is_merge": F.size(F.coalesce(
                    "parents", F.array().cast("array<string>"))) > 1}))
