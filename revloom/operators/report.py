"""Thresholds, health and onboarding tables."""

from pyspark.sql import DataFrame, functions as F

from revloom.functions import paths, scalars
from revloom.functions.lookups import (
    DEFAULT_MINOR_HINT, DEFAULT_ROLE, LANGUAGE_ROLE, MINOR_LANGUAGE_HINTS)
from revloom.operators.files import change_counts
from revloom.plans.quantiles import count_quantiles
from revloom.plans.runtime import settle
from revloom.plans.skew import attach, top_n

# fixed values
HOTSPOTS = 15
DEFAULT_HIGH_CHURN = 50
DEFAULT_STABLE_DAYS = 180
MAJOR_PERCENT = 5.0


def file_metrics(changes: DataFrame, commits: DataFrame, as_of=None) -> DataFrame:
    """Per file: distinct commits, last change, days since, mean index of its commits (missing: 0)
    and impact = commits * (1 + index).

    ``commits`` may carry ``asi``. ``as_of`` defaults to the repository's last commit.
    """
    asi = F.col("asi") if "asi" in commits.columns else F.lit(None).cast("double")
    about = commits.select("repo", F.col("hash").alias("commit_hash"), "date", asi.alias("asi"))
    files = changes.select("repo", "commit_hash", "filepath").join(
        about, ["repo", "commit_hash"], "left").groupBy("repo", "filepath").agg(
        F.countDistinct("commit_hash").alias("commit_count"),
        F.max("date").alias("last_modified_date"),
        F.coalesce(F.avg("asi"), F.lit(0.0)).alias("mean_asi"))
    if as_of is None:
        clock = commits.groupBy("repo").agg(F.max("date").alias("_clock"))
        files = attach(files, clock, ["repo"], spread=["filepath"])
    else:
        files = files.withColumn("_clock", F.lit(as_of).cast("timestamp"))
    return files.withColumns({
        "days_since_last_change": scalars.age_days("last_modified_date", "_clock"),
        "impact_score": F.col("commit_count") * (1 + F.col("mean_asi"))}).drop("_clock")


def adaptive_thresholds(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """high_churn = max(10, floor of the 90th percentile of changes per file) and
    stable_days = min(180, a quarter of the age); fixed defaults where there is no data."""
    age = commits.groupBy("repo").agg(scalars.age_days(F.min("date"), F.max("date")).alias("_age"))
    churn = count_quantiles(change_counts(changes), ["repo"], "change_count", {"_p90": 0.9})
    return age.join(churn, ["repo"], "full").select(
        "repo",
        F.when(F.col("_age").isNull() | F.col("_p90").isNull(), DEFAULT_HIGH_CHURN)
        .otherwise(F.greatest(F.lit(10), F.floor("_p90"))).cast("long").alias("high_churn"),
        F.when(F.col("_age").isNull(), DEFAULT_STABLE_DAYS)
        .otherwise(F.least(F.lit(180), F.floor(F.col("_age") * 0.25))).cast("long")
        .alias("stable_days"))


def _with_thresholds(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    return attach(metrics, thresholds, ["repo"], spread=["filepath"])


def stable_list(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    rows = _with_thresholds(metrics, thresholds)
    return rows.filter(F.col("days_since_last_change") > F.col("stable_days")).select(
        *metrics.columns)


def volatile_list(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    rows = _with_thresholds(metrics, thresholds)
    return rows.filter(F.col("commit_count") > F.col("high_churn")).select(*metrics.columns)


def hotspot_list(metrics: DataFrame, n: int = HOTSPOTS) -> DataFrame:
    order = [F.col("impact_score").desc(), F.col("filepath").asc()]
    return top_n(metrics, ["repo"], order, n, spread=["filepath"])


def hotspot_topics(metrics: DataFrame, n: int = HOTSPOTS) -> DataFrame:
    """The hotspots with their topic."""
    return hotspot_list(metrics, n).withColumn("topic", paths.hotspot_topic("filepath"))


def study_first(metrics: DataFrame, per_topic: int = 3) -> DataFrame:
    """The best files of each topic among the hotspots."""
    order = [F.col("impact_score").desc(), F.col("filepath").asc()]
    return top_n(hotspot_topics(metrics).drop("rank"), ["repo", "topic"], order, per_topic,
                 spread=["filepath"])


def good_first_files(metrics: DataFrame, thresholds: DataFrame, n: int = 5) -> DataFrame:
    """Volatile files that are no hotspots, most changed first."""
    rest = volatile_list(metrics, thresholds).join(
        hotspot_list(metrics).select("repo", "filepath"), ["repo", "filepath"], "left_anti")
    order = [F.col("commit_count").desc(), F.col("filepath").asc()]
    return top_n(rest, ["repo"], order, n, spread=["filepath"])


def leave_alone(metrics: DataFrame, thresholds: DataFrame, n: int = 5) -> DataFrame:
    """Stable files, longest unchanged first."""
    order = [F.col("days_since_last_change").desc(), F.col("filepath").asc()]
    return top_n(stable_list(metrics, thresholds), ["repo"], order, n, spread=["filepath"])


def onboarding(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The three lists in one table: (repo, list, topic, rank, filepath)."""
    no_topic = F.lit(None).cast("string").alias("topic")
    pick = ["rank", "filepath"]
    metrics = settle(metrics)  # read by all three lists
    return (study_first(metrics).select("repo", F.lit("study first").alias("list"), "topic", *pick)
            .unionByName(good_first_files(metrics, thresholds).select(
                "repo", F.lit("good first files").alias("list"), no_topic, *pick))
            .unionByName(leave_alone(metrics, thresholds).select(
                "repo", F.lit("leave alone").alias("list"), no_topic, *pick)))


def activity_label(per_year):
    return (F.when(per_year > 500, "High Activity").when(per_year > 100, "Moderate Activity")
            .otherwise("Low Activity"))


def community_label(people):
    return (F.when(people > 100, "Strong Community").when(people > 20, "Active Community")
            .otherwise("Small Team"))


def repository_health(commits: DataFrame) -> DataFrame:
    """Commits, contributors, age, commits per year and both labels."""
    people = commits.groupBy("repo", "author_name", "author_email").agg(
        F.count(F.lit(1)).alias("_n"), F.min("date").alias("_a"), F.max("date").alias("_b"))
    basic = people.groupBy("repo").agg(
        F.sum("_n").alias("total_commits"), F.count(F.lit(1)).alias("total_contributors"),
        scalars.age_days(F.min("_a"), F.max("_b")).alias("repo_age_days"))
    years = F.col("repo_age_days") / F.lit(365.25)
    per_year = F.col("total_commits") / F.greatest(years, F.lit(1.0))
    return basic.withColumns({
        "commits_per_year": per_year, "activity": activity_label(per_year),
        "community": community_label(F.col("total_contributors"))})


def language_classes(distribution: DataFrame) -> DataFrame:
    """Major languages (at least 5 percent) with their role, the others as minor."""
    pairs = [F.lit(x) for item in LANGUAGE_ROLE.items() for x in item]
    role = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("language")), F.lit(DEFAULT_ROLE))
    major = F.col("percentage") >= MAJOR_PERCENT
    return distribution.select(
        "repo", "language", "percentage", scalars.percent_text("percentage").alias("percent_text"),
        F.when(major, "major").otherwise("minor").alias("class"), F.when(major, role).alias("role"))


def minor_language_hint(distribution: DataFrame) -> DataFrame:
    """What the minor languages of a repository suggest (the set has at most one entry per known
    language)."""
    minor = distribution.filter(F.col("percentage") < MAJOR_PERCENT).groupBy("repo").agg(
        F.collect_set("language").alias("_set"))
    hints = F.filter(F.array(*[
        F.when(F.arrays_overlap("_set", F.array(*map(F.lit, names))), F.lit(hint))
        for names, hint in MINOR_LANGUAGE_HINTS]), lambda h: h.isNotNull())
    return minor.select("repo", F.when(F.size(hints) > 0, F.array_join(hints, ", "))
                        .otherwise(DEFAULT_MINOR_HINT).alias("hint"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per repository and table."""
    counts = [t.groupBy("repo").agg(F.count(F.lit(1)).alias("rows")).select(
        "repo", F.lit(name).alias("table_name"), "rows") for name, t in sorted(tables.items())]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out
