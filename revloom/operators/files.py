"""File-level analyses over ``file_changes``."""

from pyspark.sql import DataFrame, functions as F

from revloom.functions import paths, scalars
from revloom.functions.lookups import EXTENSION_LANGUAGE
from revloom.operators.clean import recent
from revloom.plans.quantiles import count_quantiles
from revloom.plans.runtime import settle
from revloom.plans.skew import attach, top_n
from revloom.plans.timeline import bin_start


def file_churn(changes: DataFrame) -> DataFrame:
    """Insertions, deletions, churn and distinct commits per file.

    The rows are first spread by (file, commit), which the distinct count needs anyway: the keys are
    almost unique there, so combining before that shuffle would only cost time. A hot file is spread
    over its commits and reaches the second, small shuffle as partial sums.
    """
    spread = changes.repartition("repo", "filepath", "commit_hash")
    return (spread.groupBy("repo", "filepath").agg(
        F.sum("insertions").alias("total_insertions"), F.sum("deletions").alias("total_deletions"),
        F.sum("total_churn").alias("total_churn"),
        F.countDistinct("commit_hash").alias("commit_count"))
        .withColumn("avg_churn_per_commit", scalars.ratio("total_churn", "commit_count")))


def change_counts(changes: DataFrame) -> DataFrame:
    """Change rows per file."""
    return changes.groupBy("repo", "filepath").agg(F.count(F.lit(1)).alias("change_count"))


def volatile_files(changes: DataFrame, min_commits: int = 50) -> DataFrame:
    """Files with at least ``min_commits`` change rows (rows, not distinct commits)."""
    return (change_counts(changes).withColumnRenamed("change_count", "commit_count")
            .filter(F.col("commit_count") >= min_commits))


def core_files(presence_counts: DataFrame, commits: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Files present in at least ``threshold`` of the commits.

    ``presence_counts`` has one row per file with ``present_in`` (from a listing or lifetimes).
    """
    totals = commits.groupBy("repo").agg(F.countDistinct("hash").alias("_total"))
    share = scalars.ratio("present_in", "_total")
    return (attach(presence_counts, totals, ["repo"], spread=["filepath"])
            .select("repo", "filepath", share.alias("presence_percentage"))
            .filter(F.col("presence_percentage") >= threshold))


def listed_presence_counts(presence: DataFrame) -> DataFrame:
    """Commits per file from a listing of every commit's tree."""
    return presence.groupBy("repo", "filepath").agg(F.count(F.lit(1)).alias("present_in"))


def hotspot_files(changes: DataFrame, commits: DataFrame, as_of=None,
                  recency_days: int = 180) -> DataFrame:
    """Recent files by risk: commits, churn and authors, each divided by the repository's maximum.

    ``as_of`` defaults to each repository's last commit. Distinct commits and authors are counted by
    nested grouping, because every commit has one author.
    """
    dated = commits.select("repo", F.col("hash").alias("commit_hash"), "author_email", "date")
    if as_of is None:
        clock = commits.groupBy("repo").agg(F.max("date").alias("_clock"))
        dated = attach(dated, clock, ["repo"], spread=["commit_hash"])
        dated = recent(dated, F.col("_clock"), recency_days)
    else:
        dated = recent(dated, as_of, recency_days)
    joined = changes.join(dated.select("repo", "commit_hash", "author_email"),
                          ["repo", "commit_hash"])
    per_commit = joined.groupBy("repo", "filepath", "author_email", "commit_hash").agg(
        F.sum("total_churn").alias("_churn"))
    per_author = per_commit.groupBy("repo", "filepath", "author_email").agg(
        F.count(F.lit(1)).alias("_commits"), F.sum("_churn").alias("_churn"))
    files = per_author.groupBy("repo", "filepath").agg(
        F.sum("_commits").alias("recent_commits"), F.sum("_churn").alias("total_churn"),
        F.count("author_email").alias("unique_authors"))
    parts = ["recent_commits", "total_churn", "unique_authors"]
    tops = files.groupBy("repo").agg(*[F.max(c).alias(f"_top_{c}") for c in parts])
    score = sum((scalars.ratio(c, f"_top_{c}") for c in parts[1:]),
                scalars.ratio(parts[0], f"_top_{parts[0]}"))
    return (attach(files, tops, ["repo"], spread=["filepath"])
            .select("repo", "filepath", *parts, score.alias("risk_score")))


def extension_counts(changes: DataFrame, n: int | None = 10) -> DataFrame:
    """Change rows per (full) extension, the ``n`` largest."""
    counts = changes.groupBy("repo", paths.path_suffixes("filepath").alias("file_extension")).agg(
        F.count(F.lit(1)).alias("change_count"))
    if n is None:
        return counts
    order = [F.col("change_count").desc(), F.col("file_extension").asc()]
    return top_n(counts, ["repo"], order, n, spread=["file_extension"])


def change_overview(changes: DataFrame) -> DataFrame:
    """Total change rows, distinct files and the most active extension, from one pass."""
    per_file = change_counts(changes)
    per_extension = per_file.groupBy("repo", paths.path_suffixes("filepath").alias("_e")).agg(
        F.sum("change_count").alias("_n"), F.count(F.lit(1)).alias("_files"))
    # most changes, then the first name: smallest (-count, name)
    return per_extension.groupBy("repo").agg(
        F.sum("_n").alias("total_file_changes"), F.sum("_files").alias("unique_files"),
        F.min(F.struct((-F.col("_n")).alias("c"), "_e"))["_e"].alias("most_active_extension"))


def monthly_extensions(dated: DataFrame, n: int | None = 8) -> DataFrame:
    """Month by extension change counts in long form, zero-filled over the months of a repository.

    ``n`` keeps the most changed extensions; None keeps all and stays sparse.
    """
    cells = dated.groupBy("repo", bin_start("date", "month").alias("bin"),
                          paths.path_suffixes("filepath").alias("file_extension")).agg(
        F.count(F.lit(1)).alias("change_count"))
    if n is None:
        return cells.withColumnRenamed("bin", "month")
    cells = settle(cells)  # small, and read three times below
    totals = cells.groupBy("repo", "file_extension").agg(
        F.sum("change_count").alias("change_count"))
    order = [F.col("change_count").desc(), F.col("file_extension").asc()]
    kept = top_n(totals, ["repo"], order, n, spread=["file_extension"]).select(
        "repo", "file_extension")
    months = cells.select("repo", "bin").distinct()
    spine = months.join(kept, ["repo"])  # at most n rows per month
    return (spine.join(cells, ["repo", "bin", "file_extension"], "left")
            .fillna(0, subset=["change_count"]).withColumnRenamed("bin", "month"))


def directory_activity(changes: DataFrame, n: int = 15) -> DataFrame:
    counts = changes.groupBy("repo", paths.path_dir("filepath").alias("directory")).agg(
        F.count(F.lit(1)).alias("change_count"))
    order = [F.col("change_count").desc(), F.col("directory").asc()]
    return top_n(counts, ["repo"], order, n, spread=["directory"])


def depth_distribution(changes: DataFrame) -> DataFrame:
    return changes.groupBy("repo", paths.path_depth("filepath").alias("path_depth")).agg(
        F.count(F.lit(1)).alias("change_count"))


def top_changed_files(changes: DataFrame, n: int = 20) -> DataFrame:
    order = [F.col("change_count").desc(), F.col("filepath").asc()]
    return top_n(change_counts(changes), ["repo"], order, n, spread=["filepath"])


def change_frequency_summary(changes: DataFrame) -> DataFrame:
    """Files, files at or above the 95th percentile, most changed file and its count."""
    # settled: the quantiles and the result read it, and it is far smaller than the changes
    counts = settle(change_counts(changes))
    cut = count_quantiles(counts, ["repo"], "change_count", {"_p95": 0.95})
    return (attach(counts, cut, ["repo"], spread=["filepath"]).groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_hotspots"),
        F.count_if(F.col("change_count") >= F.col("_p95")).alias("critical_hotspots"),
        # largest count, then the first path: smallest (-count, path)
        F.min(F.struct((-F.col("change_count")).alias("c"), "filepath"))["filepath"]
        .alias("most_changed_file"),
        F.max("change_count").alias("max_changes")))


def file_heat(changes: DataFrame) -> DataFrame:
    """Stable up to the median count, Active to the 80th, Hot to the 95th percentile, else Critical."""
    counts = settle(change_counts(changes))
    cuts = count_quantiles(counts, ["repo"], "change_count",
                           {"_p50": 0.5, "_p80": 0.8, "_p95": 0.95})
    c = F.col("change_count")
    label = (F.when(c <= F.col("_p50"), "Stable").when(c <= F.col("_p80"), "Active")
             .when(c <= F.col("_p95"), "Hot").otherwise("Critical"))
    return attach(counts, cuts, ["repo"], spread=["filepath"]).select(
        "repo", "filepath", "change_count", label.alias("category"))


def file_heat_counts(changes: DataFrame) -> DataFrame:
    return file_heat(changes).groupBy("repo", "category").agg(
        F.count(F.lit(1)).alias("file_count"))


def group_by_directory(files: DataFrame, depth: int = 1) -> DataFrame:
    """Files with their directory at ``depth`` ('.' when not deeper).

    In long form: a directory may hold any number of files, so no list is built.
    """
    return files.select("repo", paths.path_prefix("filepath", depth).alias("directory"), "filepath")


def language_dimension(spark) -> DataFrame:
    """The extension -> language table (about 45 rows, fixed)."""
    return spark.createDataFrame(list(EXTENSION_LANGUAGE.items()),
                                 "language_key string, language string")


def with_language(files: DataFrame, path: str = "filepath") -> DataFrame:
    """Look up the language by join; the dimension is fixed and tiny, so it is broadcast."""
    dimension = F.broadcast(language_dimension(files.sparkSession))
    return (files.withColumn("language_key", paths.language_key(path))
            .join(dimension, "language_key", "left").drop("language_key")
            .withColumn("language", F.coalesce("language", F.lit("Other"))))


def _language_shares(files: DataFrame, count: str) -> DataFrame:
    # few rows per repository after grouping by extension
    by_key = files.groupBy("repo", paths.language_key("filepath").alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"))
    counts = by_key.groupBy("repo", paths.language_name("_key").alias("language")).agg(
        F.sum("_n").alias(count))
    totals = counts.groupBy("repo").agg(F.sum(count).alias("_total"))
    return counts.join(totals, ["repo"]).select(
        "repo", "language", count, (F.col(count) / F.col("_total") * 100).alias("percentage"))


def language_statistics(head_files: DataFrame) -> DataFrame:
    """Tracked files that are not binary, by language, with the share in percent (2 digits)."""
    text_files = head_files.filter(~paths.is_binary_path("filepath"))
    return _language_shares(text_files, "file_count").withColumn(
        "percentage", F.round("percentage", 2))


def language_distribution(changes: DataFrame) -> DataFrame:
    """Share of the change rows by language."""
    return _language_shares(changes, "change_count")


def language_shares_with_others(statistics: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` languages with most files and one row ``Others`` for the rest (if any)."""
    order = [F.col("file_count").desc(), F.col("language").asc()]
    kept = top_n(statistics, ["repo"], order, n, spread=["language"]).select(
        "repo", "language", F.lit(True).alias("_kept"))
    label = F.when(F.col("_kept"), F.col("language")).otherwise("Others")
    return (statistics.join(kept, ["repo", "language"], "left")
            .groupBy("repo", label.alias("language")).agg(F.sum("file_count").alias("file_count")))


def date_changes(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Change rows with the date of their commit."""
    dates = commits.select("repo", F.col("hash").alias("commit_hash"), "date")
    return changes.join(dates, ["repo", "commit_hash"])
