"""File lifetimes: presence in a history without a row per (commit, file).

Commits get a dense number per repository (date, then hash). A file is present in the half-open
interval ``[from_seq, to_seq)`` between an opening change (A, M, R, C) and a closing one (D, or the
old path of R). This equals a full listing on a linear history; on a branched one, where date order is
not ancestry, give a listing to the operators that take one.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from revloom.functions import scalars, text
from revloom.operators import ancestry
from revloom.plans.order import SEGMENT, carry_last, running_sum, segment_of, with_position
from revloom.plans.runtime import settle
from revloom.plans.skew import attach, join_by_number, measured

# numbers that lifetimes without an end are dealt over
OPEN_ENDS = 64
# rows of files at points that are made by one task
TASK_ROWS = 1 << 20


def commit_sequence(commits: DataFrame) -> DataFrame:
    """(repo, hash, date, seq): dense commit numbers from 1, settled, because most history queries
    read them several times."""
    narrow = commits.select("repo", "hash", "date")
    return settle(with_position(narrow, ["repo"], [F.col("date").asc(), F.col("hash").asc()]
                                ).withColumnRenamed("position", "seq"))


def first_parent_sequence(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo, hash, date, seq): the first-parent chain of one head per repository, numbered from its root.

    ``heads``: (repo, hash). On a branched history this is the order in which the head's tree came about; lifetimes
    need changes against the first parent then (a log with ``--first-parent -m``). Other commits are left out.
    """
    edges = ancestry.parent_edges(commits).filter(F.col("place") == 0)
    chain = ancestry.reachable(edges, heads.select("repo", "hash")).select("repo", "hash").distinct()
    steps = ancestry.depths(edges, commits)
    numbered = commits.select("repo", "hash", "date").dropDuplicates(["repo", "hash"]).join(
        chain, ["repo", "hash"], "left_semi").join(steps, ["repo", "hash"])
    return settle(numbered.select("repo", "hash", "date", (F.col("depth") + 1).alias("seq")))


def presence_events(changes: DataFrame, sequence: DataFrame) -> DataFrame:
    """One row per (repo, filepath, seq) with ``open`` 1 or 0, kept in (repo, file, segment) parts."""
    is_open = (F.col("change_type") != "D").cast("int")
    touched = changes.select("repo", "commit_hash", "filepath", is_open.alias("open"))
    if "old_path" in changes.columns:
        left_behind = changes.filter((F.col("change_type") == "R") & F.col("old_path").isNotNull()
                                     ).select("repo", "commit_hash",
                                              F.col("old_path").alias("filepath"),
                                              F.lit(0).alias("open"))
        touched = touched.unionByName(left_behind)
    numbers = sequence.select("repo", F.col("hash").alias("commit_hash"), "seq")
    placed = join_by_number(touched, numbers, ["repo", "commit_hash"]).withColumn("segment", segment_of("seq"))
    # one shuffle serves the grouping and the windows below; a file changed in every commit is cut
    # into segments of at most SEGMENT rows
    return (placed.repartition("repo", "filepath", "segment")
            .groupBy("repo", "filepath", "segment", "seq").agg(F.max("open").alias("open")))


def file_lifetimes(changes: DataFrame, sequence: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(repo, filepath, from_seq, to_seq); ``to_seq`` is null while the file is still there.

    Looks up the highest commit number once (a job on the small sequence table) to leave out the
    carry between segments where every history fits into one. The result is settled: it is far
    smaller than the changes, and all questions about presence start from it. ``events`` are those of
    :func:`presence_events` where they were settled already.
    """
    events = presence_events(changes, sequence) if events is None else events
    one_segment = (sequence.agg(F.max("seq")).first()[0] or 0) < SEGMENT
    key = ["repo", "filepath", "segment"]
    # sorted by a number first: repositories are equal and paths begin alike in most comparisons
    part = W.partitionBy(F.xxhash64("repo", "filepath"), *key).orderBy("seq")
    kept = events.withColumn("_before", F.lag("open").over(part))
    if one_segment:
        switches = kept.filter(F.col("open") != F.coalesce("_before", F.lit(0)))
        return settle(switches.withColumn("to_seq", F.lead("seq").over(part)).filter(F.col("open") == 1).select(
            "repo", "filepath", F.col("seq").alias("from_seq"), "to_seq"))

    # the first row of a part and those that differ from the one before; settled, as the parts are read twice below
    kept = settle(kept.filter(F.col("_before").isNull() | (F.col("open") != F.col("_before"))).withColumn(
        "_until", F.lead("seq").over(part)))
    file = W.partitionBy("repo", "filepath").orderBy("segment")
    parts = kept.groupBy(*key).agg(
        # rows of a part take turns: the last one is that without a following row
        F.max(F.when(F.col("_until").isNull(), F.col("open"))).alias("_end"),
        F.min(F.when(F.col("open") == 0, F.col("seq"))).alias("_close"))
    around = parts.select(*key, F.lag("_end").over(file).alias("_carry"), F.first("_close", ignorenulls=True).over(
        file.rowsBetween(1, W.unboundedFollowing)).alias("_next"))
    opened = kept.filter(F.col("open") == 1).join(around, key)
    return settle(opened.filter(F.col("_before").isNotNull() | (F.coalesce("_carry", F.lit(0)) == 0)).select(
        "repo", "filepath", F.col("seq").alias("from_seq"), F.coalesce("_until", "_next").alias("to_seq")))


def presence_counts(lifetimes: DataFrame, sequence: DataFrame) -> DataFrame:
    """Commits whose tree holds the file, as the sum of its interval lengths."""
    totals = sequence.groupBy("repo").agg(F.max("seq").alias("_last"))
    lengths = lifetimes.groupBy("repo", "filepath").agg(
        F.sum(F.coalesce("to_seq", F.lit(0)) - F.col("from_seq")).alias("_closed"),
        F.count_if(F.col("to_seq").isNull()).alias("_open"))
    present = F.col("_closed") + F.col("_open") * (F.col("_last") + 1)
    return attach(lengths, totals, ["repo"], spread=["filepath"]).select(
        "repo", "filepath", present.alias("present_in"))


def complexity_timeline(lifetimes: DataFrame, sequence: DataFrame) -> DataFrame:
    """Files in the tree after every commit."""
    step = lifetimes.select("repo", F.explode(F.array(
        F.struct(F.col("from_seq").alias("seq"), F.lit(1).alias("d")),
        F.struct(F.col("to_seq").alias("seq"), F.lit(-1).alias("d")))).alias("_e"))
    deltas = step.select("repo", "_e.seq", "_e.d").filter(F.col("seq").isNotNull()).groupBy(
        "repo", "seq").agg(F.sum("d").alias("_delta"))
    # sorted by the number first: it tells rows apart
    full = sequence.join(deltas, ["seq", "repo"], "left").fillna(0, subset=["_delta"])
    return running_sum(full, ["repo"], "seq", "_delta", "total_files").select(
        "repo", "hash", "date", "seq", "total_files")


def listed_timeline(presence: DataFrame, commits: DataFrame) -> DataFrame:
    """The same from a listing of every tree; commits without files count 0."""
    counts = presence.groupBy("repo", F.col("commit_hash").alias("hash")).agg(
        F.count(F.lit(1)).alias("total_files"))
    return commits.select("repo", "hash", "date").join(counts, ["repo", "hash"], "left").fillna(
        0, subset=["total_files"])


def head_files(lifetimes: DataFrame) -> DataFrame:
    """Files at head: lifetimes that never ended."""
    return lifetimes.filter(F.col("to_seq").isNull()).select("repo", "filepath")


def listed_head_files(presence: DataFrame, commits: DataFrame) -> DataFrame:
    """Files at head from a listing: those of each repository's latest commit."""
    heads = commits.groupBy("repo").agg(
        F.max_by("hash", F.struct("date", "hash")).alias("commit_hash"))
    # the listing is the largest table of all: it is not shuffled where the heads can be broadcast
    side, _ = measured(heads)
    return presence.join(side, ["repo", "commit_hash"], "left_semi").select("repo", "filepath")


def files_at(lifetimes: DataFrame, targets: DataFrame, payload=(), together=()) -> DataFrame:
    """Files present at commit numbers: ``targets`` holds (repo, seq, …) for any number of points; ``payload`` names
    columns of the lifetimes that come along. Rows that are equal in the columns ``together`` are made by one task, where
    the points can be broadcast, about ``TASK_ROWS`` rows by each: lifetimes are dealt, and not the rows made of them.

    The points of a repository are numbered. How many of them lie before a commit at which a lifetime begins or
    ends is looked up once per commit, which makes a lifetime a range of points: only rows of the result are made.
    """
    points = settle(with_position(targets.select("repo", "seq").distinct(), ["repo"], [F.col("seq").asc()]))
    # lifetimes that go on end after all points: they are dealt over OPEN_ENDS numbers below all others, and not one
    spans = lifetimes.select("repo", "filepath", *payload, "from_seq", F.coalesce(
        "to_seq", -1 - F.pmod(F.xxhash64("filepath"), F.lit(OPEN_ENDS))).alias("to_seq"))
    ends = spans.select("repo", F.explode(F.array("from_seq", "to_seq")).alias("seq")).filter(F.col("seq") >= 0).distinct()
    # at equal numbers the ends come first: they count the points before them
    order = points.withColumn("_kind", F.lit(1)).unionByName(
        ends.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    before = carry_last(order, ["repo"], [F.col("seq").asc(), F.col("_kind").asc()], "position", "_before").filter(
        F.col("_kind") == 0).select("repo", "seq", F.coalesce("_before", F.lit(0)).alias("_before"))
    after_all = points.groupBy("repo").agg(F.max("position").alias("_before")).select(
        "repo", F.explode(F.sequence(F.lit(-OPEN_ENDS).cast("long"), F.lit(-1).cast("long"))).alias("seq"), "_before")
    at = lambda known, end, name: known.select("repo", F.col("seq").alias(end), F.col("_before").alias(name))
    ranged = spans.join(at(before, "from_seq", "_low"), ["repo", "from_seq"]).join(
        at(before.unionByName(after_all), "to_seq", "_high"), ["repo", "to_seq"])
    ranged = ranged.filter(F.col("_low") < F.col("_high"))
    if together:
        ranged = settle(ranged.select("repo", "filepath", *payload, "_low", "_high"))
        made = ranged.agg(F.sum(F.col("_high") - F.col("_low"))).first()[0] or 0
        ranged = ranged.repartition(1 + made // TASK_ROWS, *together)
    present = ranged.select(
        "repo", "filepath", *payload, F.explode(F.sequence(F.col("_low") + 1, "_high")).alias("position"))
    # rows of the result are not shuffled where the points can be broadcast
    asked, _ = measured(targets.join(points, ["repo", "seq"]))
    return present.join(asked, ["repo", "position"]).select(*targets.columns, "filepath", *payload)


def last_changes(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Latest change per file: date and author."""
    who = commits.select("repo", F.col("hash").alias("commit_hash"), "date", "author_name")
    touched = changes.select("repo", "commit_hash", "filepath").join(who, ["repo", "commit_hash"])
    latest = F.max(F.struct("date", "commit_hash", "author_name"))
    return touched.groupBy("repo", "filepath").agg(latest.alias("_l")).select(
        "repo", "filepath", F.col("_l.date").alias("last_modified"),
        F.col("_l.author_name").alias("last_author"))


def _with_clock(rows: DataFrame, commits: DataFrame, as_of) -> DataFrame:
    if as_of is not None:
        return rows.withColumn("_clock", F.lit(as_of).cast("timestamp"))
    clock = commits.groupBy("repo").agg(F.max("date").alias("_clock"))
    return attach(rows, clock, ["repo"], spread=["filepath"])


def stable_files(heads: DataFrame, last: DataFrame, commits: DataFrame, days: int = 365,
                 as_of=None) -> DataFrame:
    """Files at head whose last change is more than ``days`` before ``as_of`` (default: the last
    commit of the repository)."""
    found = last.join(heads, ["repo", "filepath"], "left_semi")
    old = F.col("last_modified") < F.col("_clock") - F.make_dt_interval(F.lit(days))
    return _with_clock(found, commits, as_of).filter(old).select(
        "repo", "filepath", "last_modified")


def abandoned_files(heads: DataFrame, last: DataFrame, commits: DataFrame, days: int = 730,
                    as_of=None) -> DataFrame:
    """Stable files at a longer limit, with their age and last author."""
    found = last.join(heads, ["repo", "filepath"], "left_semi")
    old = F.col("last_modified") < F.col("_clock") - F.make_dt_interval(F.lit(days))
    return _with_clock(found, commits, as_of).filter(old).select(
        "repo", "filepath", "last_modified",
        scalars.age_days("last_modified", "_clock").alias("days_since_change"), "last_author")


def reorganisations(changes: DataFrame, timeline: DataFrame, commits: DataFrame,
                    threshold: float = 0.2) -> DataFrame:
    """Commits that moved at least ``threshold`` of the files in their tree; root commits are left
    out (no parents, or the first of the repository where parents are unknown)."""
    moved = changes.filter(F.col("change_type") == "R").groupBy(
        "repo", F.col("commit_hash").alias("hash")).agg(F.count(F.lit(1)).alias("files_moved"))
    has_parents = "parents" in commits.columns
    about = commits.select("repo", "hash", "message", *(["parents"] if has_parents else []))
    rows = (moved.join(timeline, ["repo", "hash"]).join(about, ["repo", "hash"])
            .filter(F.col("total_files") > 0)
            .withColumn("move_ratio", scalars.ratio("files_moved", "total_files"))
            .filter(F.col("move_ratio") >= threshold))
    if "seq" in rows.columns:
        later = F.col("seq") > 1
    else:
        first = commits.groupBy("repo").agg(F.min(F.struct("date", "hash")).alias("_first"))
        rows = attach(rows, first, ["repo"], spread=["hash"])
        later = F.col("hash") != F.col("_first.hash")
    if has_parents:
        later = F.when(F.col("parents").isNull(), later).otherwise(F.size("parents") > 0)
    rows = rows.filter(later)
    return rows.select("repo", F.col("hash").alias("commit_hash"), "date",
                       text.subject_line("message").alias("message"), "files_moved", "move_ratio")


def repository_stats(commits: DataFrame, heads: DataFrame, branches: DataFrame | None = None,
                     tags: DataFrame | None = None, as_of=None) -> DataFrame:
    """Commits, branches, tags, first and last date, age, authors and files, zero where missing."""
    parts = commits.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_commits"), F.min("date").alias("first_commit_date"),
        F.max("date").alias("last_commit_date"),
        F.countDistinct("author_email").alias("unique_authors"))
    for table, name in ((branches, "total_branches"), (tags, "total_tags"),
                        (heads, "total_files_current")):
        if table is not None:
            counts = table.groupBy("repo").agg(F.count(F.lit(1)).alias(name))
            parts = parts.unionByName(counts, allowMissingColumns=True)
    counts = [c for c in ("total_commits", "total_branches", "total_tags", "unique_authors",
                          "total_files_current") if c in parts.columns]
    clock = F.lit(as_of).cast("timestamp") if as_of is not None else F.col("last_commit_date")
    return parts.groupBy("repo").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        F.min("first_commit_date").alias("first_commit_date"),
        F.max("last_commit_date").alias("last_commit_date")).withColumn(
        "age_in_days", F.coalesce(scalars.age_days("first_commit_date", clock), F.lit(0)))
