"""Contributor analyses."""

from pyspark.sql import DataFrame, functions as F

from revloom.functions import scalars
from revloom.functions.lookups import CONTRIBUTOR_TIERS
from revloom.operators.clean import CONTRIBUTOR_ALIASES, conform, find_count_column
from revloom.plans.order import with_position
from revloom.plans.skew import attach, top_n


def _commit_sizes(changes: DataFrame) -> DataFrame:
    # summed per commit first: a commit of any size becomes one row before the join
    return changes.groupBy("repo", F.col("commit_hash").alias("hash")).agg(
        F.sum("insertions").alias("_ins"), F.sum("deletions").alias("_del"))


def contributor_stats(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Per (name, email): commits with changes, first and last date, lines, active days."""
    joined = commits.join(_commit_sizes(changes), ["repo", "hash"])
    return joined.groupBy("repo", "author_name", "author_email").agg(
        F.count(F.lit(1)).alias("commit_count"), F.min("date").alias("first_commit_date"),
        F.max("date").alias("last_commit_date"), F.sum("_ins").alias("total_insertions"),
        F.sum("_del").alias("total_deletions")).withColumn(
        "active_days", scalars.age_days("first_commit_date", "last_commit_date"))


def contributor_export(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Per (name, email): commits, dates, lines, distinct files, mean lines per commit."""
    who = ["repo", "author_name", "author_email"]
    authored = commits.groupBy(*who).agg(
        F.count(F.lit(1)).alias("commit_count"), F.min("date").alias("first_commit_date"),
        F.max("date").alias("last_commit_date"))
    authors = commits.select("repo", F.col("hash").alias("commit_hash"), "author_name",
                             "author_email")
    # one pass over the changes: lines per (author, file), then lines and files per author
    per_file = changes.join(authors, ["repo", "commit_hash"]).groupBy(*who, "filepath").agg(
        F.sum("insertions").alias("_ins"), F.sum("deletions").alias("_del"))
    lines = per_file.groupBy(*who).agg(
        F.sum("_ins").alias("total_insertions"), F.sum("_del").alias("total_deletions"),
        F.count(F.lit(1)).alias("files_touched"))
    return (authored.join(lines, who, "left")
            .fillna(0, subset=["total_insertions", "total_deletions", "files_touched"])
            .withColumn("total_lines_changed", F.col("total_insertions") + F.col("total_deletions"))
            .withColumn("avg_lines_per_commit",
                        F.round(F.col("total_lines_changed") / F.col("commit_count"), 2)))


def contributors_from_commits(commits: DataFrame) -> DataFrame:
    """Per email: commits, name on the earliest commit, first and last date."""
    return commits.groupBy("repo", "author_email").agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.min_by("author_name", F.struct("date", "hash")).alias("author_name"),
        F.min("date").alias("first_commit"), F.max("date").alias("last_commit"))


def active_contributors(contributors: DataFrame, min_commits: int = 5, n: int = 20) -> DataFrame:
    """Contributors with at least ``min_commits``, the ``n`` largest; accepts drifting names."""
    table = conform(contributors, CONTRIBUTOR_ALIASES)
    tie = [c for c in ("author_name", "author_email") if c in table.columns]
    order = [F.col("commit_count").desc(), *[F.col(c).asc() for c in tie]]
    return top_n(table.filter(F.col("commit_count") >= min_commits), ["repo"], order, n, spread=tie)


def contributor_overview(contributors: DataFrame, min_commits: int = 5, n: int = 20) -> DataFrame:
    """All contributors, active ones (at most ``n``) and the top name."""
    table = conform(contributors, CONTRIBUTOR_ALIASES)
    totals = table.groupBy("repo").agg(F.count(F.lit(1)).alias("total_contributors"))
    active = active_contributors(table, min_commits, n).groupBy("repo").agg(
        F.count(F.lit(1)).alias("active_contributors"),
        F.min_by("author_name", "rank").alias("top_contributor"))
    return totals.join(active, ["repo"], "left").fillna(0, subset=["active_contributors"])


def top_contributors(contributors: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest by whichever column counts commits, with the display columns present."""
    count = find_count_column(contributors)
    if count is None:
        raise ValueError("no column that counts commits")
    tie = [c for c in ("author_name", "author_email") if c in contributors.columns]
    order = [F.col(count).desc(), *[F.col(c).asc() for c in tie]]
    shown = [c for c in ("author_name", count, "first_commit_date", "last_commit_date")
             if c in contributors.columns]
    return top_n(contributors, ["repo"], order, n, spread=tie).select("repo", "rank", *shown)


def contributor_tier(count):
    c = F.col(count) if isinstance(count, str) else count
    expr = F.when(c >= CONTRIBUTOR_TIERS[0][1], CONTRIBUTOR_TIERS[0][0])
    for label, least in CONTRIBUTOR_TIERS[1:]:
        expr = expr.when(c >= least, label)
    return expr


def contributor_tiers(contributors: DataFrame) -> DataFrame:
    """Contributors per tier, all four tiers present."""
    tier = contributor_tier("commit_count")
    counts = F.array(*[F.struct(F.lit(label).alias("tier"),
                                F.count_if(tier == label).alias("contributors"))
                       for label, _ in CONTRIBUTOR_TIERS])
    return contributors.groupBy("repo").agg(counts.alias("_t")).select("repo", F.inline("_t"))


def pareto(contributors: DataFrame) -> DataFrame:
    """Cumulative share of commits against share of contributors, largest first.

    The running sum is range partitioned (:mod:`revloom.plans.order`), so a repository with very
    many contributors does not meet in one task.
    """
    who = contributors.select("repo", "author_email", "commit_count")
    ranked = with_position(who, ["repo"], [F.col("commit_count").desc(), F.col("author_email").asc()],
                           totals=["commit_count"])
    totals = who.groupBy("repo").agg(F.count(F.lit(1)).alias("_people"),
                                     F.sum("commit_count").alias("_commits"))
    return attach(ranked, totals, ["repo"], spread=["author_email"]).select(
        "repo", "author_email", "commit_count", "position",
        (F.col("position") / F.col("_people") * 100).alias("contributor_percent"),
        (F.col("running_commit_count") / F.col("_commits") * 100).alias("cumulative_percent"))
