"""Files that change together.

A pair counts once per commit that holds both files. Listing all pairs of every commit fails on a
commit with very many files, so commits are split by size:

* small commits list their pairs directly;
* in large commits a pair can reach ``least`` common commits without any small one only if the two
  files share a large commit among all but their ``least - 1`` largest ones (prefix filtering of set
  joins: order each file's commits from the smallest up; two sets with ``least`` common members must
  meet in the first ``size - least + 1`` members of both). Only those meetings list candidates, so a bulk
  commit that is among the largest of its files lists nothing. A large commit that still meets is cut
  into blocks, and pairs of blocks are spread over tasks;
* candidates from either side then count their common large commits exactly, starting from the file
  with fewer of them.

The result is whole for any sizes.
"""

from pyspark.sql import DataFrame, functions as F

from revloom.plans.runtime import settle
from revloom.plans.skew import join_by_number, top_n

SMALL_COMMIT = 200
BLOCK = 512


def _distinct_changes(changes: DataFrame) -> DataFrame:
    """Distinct (repo, commit, file), settled: the steps below read these narrow rows, not the changes.

    The keys are nearly unique, so rows are spread first and the few repeats dropped after that.
    """
    columns = ["repo", "commit_hash", "filepath"]
    return settle(changes.select(*columns).dropna().repartition(*columns).distinct())


def _commit_sizes(distinct: DataFrame) -> DataFrame:
    """Files per commit, without commits of a single file."""
    return settle(distinct.groupBy("repo", "commit_hash").agg(F.count(F.lit(1)).alias("size"))
                  .filter(F.col("size") > 1))


def _often(distinct: DataFrame, least: int) -> DataFrame:
    """(repo, filepath) of files with at least ``least`` commits."""
    return distinct.groupBy("filepath", "repo").agg(F.count(F.lit(1)).alias("_d")).filter(
        F.col("_d") >= least).select("repo", "filepath")


def _members(distinct: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """Rows of files with at least ``least`` commits (no other can pair), with the commit's size."""
    if least > 1:
        distinct = distinct.join(_often(distinct, least), ["repo", "filepath"], "left_semi")
    # the commit first: ids tell rows apart, and the rows of a commit stay together for its list of files
    return distinct.join(sizes, ["commit_hash", "repo"])


def _numbered(distinct: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows of files with at least ``least`` commits, with a number for the path, and the files (repo, filepath, number).

    Pairs are many times the rows, and two numbers are far narrower than two paths. The numbers hold as the files are settled.
    """
    files = settle(_often(distinct, least).withColumn("number", F.monotonically_increasing_id()))
    return join_by_number(distinct, files, ["repo", "filepath"]).select(
        "repo", "commit_hash", F.col("number").alias("filepath")), files


def _named(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Paths for the numbers of the pairs; the lesser path is ``file1``."""
    side = lambda name: files.select(F.col("number").alias(name), F.col("filepath").alias(f"_{name}"))
    rest = [c for c in pairs.columns if c not in ("repo", "file1", "file2")]
    return pairs.join(side("file1"), "file1").join(side("file2"), "file2").select(
        "repo", F.least("_file1", "_file2").alias("file1"), F.greatest("_file1", "_file2").alias("file2"), *rest)


def _small_pairs(members: DataFrame) -> DataFrame:
    """Pair counts of small commits. Their sizes are bounded, so a commit fits into one array."""
    lists = members.groupBy("repo", "commit_hash").agg(
        F.array_sort(F.collect_list("filepath")).alias("_files"))
    first = lists.select("repo", "_files", F.posexplode("_files").alias("_place", "file1"))
    pairs = first.select("repo", "file1", F.explode(F.slice("_files", F.col("_place") + 2, F.size("_files"))).alias("file2"))
    return pairs.groupBy("file1", "file2", "repo").agg(F.count(F.lit(1)).alias("small")).select(
        "repo", "file1", "file2", "small")


def _large_candidates(members: DataFrame, least: int, block: int) -> DataFrame:
    """Pairs that may share ``least`` large commits."""
    prefix = members.select("repo", "commit_hash", "filepath")
    if least > 1:
        # leave out the (least - 1) largest commits of each file; a top-n is cut before its shuffle
        largest = top_n(members, ["repo", "filepath"],
                        [F.col("size").desc(), F.col("commit_hash").desc()], least - 1,
                        spread=["commit_hash"]).select(*prefix.columns)
        prefix = prefix.join(largest, prefix.columns, "left_anti")
    # block join: each file takes part in a row and a column of blocks of its commit
    counts = prefix.groupBy("repo", "commit_hash").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_blocks"))
    placed = prefix.join(counts, ["repo", "commit_hash"]).withColumn(
        "_own", F.pmod(F.xxhash64("filepath"), F.col("_blocks")).cast("int"))
    left = placed.select("repo", "commit_hash", F.col("filepath").alias("_a"),
                         F.col("_own").alias("_i"),
                         F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_j"))
    right = placed.select("repo", "commit_hash", F.col("filepath").alias("_b"),
                          F.explode(F.sequence(F.lit(0), "_own")).alias("_i"),
                          F.col("_own").alias("_j"))
    once = (F.col("_i") < F.col("_j")) | (F.col("_a") < F.col("_b"))
    return (left.join(right, ["repo", "commit_hash", "_i", "_j"]).filter(once)
            .select("repo", F.least("_a", "_b").alias("file1"), F.greatest("_a", "_b").alias("file2"))
            .distinct())


def _count_large(candidates: DataFrame, members: DataFrame, small: DataFrame, least: int) -> DataFrame:
    """Common large commits of each candidate pair that can still reach ``least``: its small commits and
    the large ones of its lighter file must suffice."""
    links = members.select("repo", "commit_hash", "filepath")
    degrees = links.groupBy("repo", "filepath").agg(F.count(F.lit(1)).alias("_d"))
    d1 = degrees.select("repo", F.col("filepath").alias("file1"), F.col("_d").alias("_d1"))
    d2 = degrees.select("repo", F.col("filepath").alias("file2"), F.col("_d").alias("_d2"))
    sized = candidates.join(small, ["repo", "file1", "file2"], "left").join(
        d1, ["repo", "file1"]).join(d2, ["repo", "file2"]).filter(
        F.coalesce("small", F.lit(0)) + F.least("_d1", "_d2") >= least)
    start = F.when(F.col("_d1") <= F.col("_d2"), F.col("file1")).otherwise(F.col("file2"))
    other = F.when(F.col("_d1") <= F.col("_d2"), F.col("file2")).otherwise(F.col("file1"))
    walk = sized.select("repo", "file1", "file2", start.alias("filepath"), other.alias("_other"))
    probe = walk.join(links, ["repo", "filepath"]).select(
        "repo", "commit_hash", F.col("_other").alias("filepath"), "file1", "file2")
    return probe.join(links, ["repo", "commit_hash", "filepath"]).groupBy(
        "repo", "file1", "file2").agg(F.count(F.lit(1)).alias("large"))


def file_coupling(changes: DataFrame, min_occurrences: int = 5, small_commit: int = SMALL_COMMIT,
                  block: int = BLOCK) -> DataFrame:
    """Unordered file pairs changed together in at least ``min_occurrences`` commits.

    The steps for large commits are left out where no commit is large.
    """
    least = max(1, min_occurrences)
    distinct = _distinct_changes(changes)
    sizes = _commit_sizes(distinct)
    # pairs that are met once are most of all: where they are the result, paths would be looked up for each of them
    named = lambda pairs: pairs
    if least > 1:
        distinct, files = _numbered(distinct, least)
        named = lambda pairs: _named(pairs, files)
    members = _members(distinct, sizes, 1)
    pair = ["repo", "file1", "file2"]
    if sizes.filter(F.col("size") > small_commit).isEmpty():
        return named(_small_pairs(members).filter(F.col("small") >= least).withColumnRenamed(
            "small", "times_changed_together"))
    members = settle(members)
    small = _small_pairs(members.filter(F.col("size") <= small_commit))
    large = members.filter(F.col("size") > small_commit)
    candidates = _large_candidates(large, least, block).unionByName(small.select(*pair)).distinct()
    counted = _count_large(candidates, large, small, least)
    total = (F.coalesce("small", F.lit(0)) + F.coalesce("large", F.lit(0)))
    return named(small.join(counted, pair, "full").withColumn("times_changed_together", total)
                 .filter(F.col("times_changed_together") >= least)
                 .select(*pair, "times_changed_together"))
