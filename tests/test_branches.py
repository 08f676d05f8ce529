"""Branched histories, and inputs that once were cut, broken or endless."""

import pytest
from pyspark.sql import functions as F

from conftest import rows, utc
from revloom.operators import ancestry, lifetimes, persistence, snapshots
from revloom.plans.analyses import AnalysisConfig, filtered
from revloom.sources import dumps, tables
from revloom.sources.tables import History


@pytest.fixture(scope="module")
def forked(make):
    """a adds x.py; the side branch deletes it later; main adds y.py last."""
    commits = make.commits([("a", "A", utc(2020, 1, 1), "add", []), ("s", "B", utc(2020, 1, 2), "drop", ["a"]),
                            ("m", "A", utc(2020, 1, 3), "more", ["a"])])
    changes = make.changes([("a", "x.py", "A"), ("s", "x.py", "D"), ("m", "y.py", "A")])
    return commits, changes


def branches_of(spark, heads):
    return spark.createDataFrame([("r", n, n, n == "main", False, h) for n, h in heads],
                                 "repo string, branch_name string, full_name string, is_current boolean, "
                                 "is_remote boolean, last_commit_hash string")


def test_head_of_a_branch(spark, forked):
    commits, changes = forked
    for head, files in (("m", [("x.py",), ("y.py",)]), ("s", [])):
        heads = spark.createDataFrame([("r", head)], "repo string, hash string")
        order = lifetimes.first_parent_sequence(commits, heads)
        assert rows(order, "hash", "seq") == sorted([("a", 1), (head, 2)])
        assert rows(lifetimes.head_files(lifetimes.file_lifetimes(changes, order)), "filepath") == files


def test_branch_history(spark, forked):
    commits, changes = forked
    full = History(commits=commits, file_changes=changes, branches=branches_of(spark, [("main", "m"), ("side", "s")]))
    assert rows(tables.branch_history(full).commits, "hash") == [("a",), ("m",)]
    side = tables.branch_history(full, "side", first_parent=True)
    assert rows(side.commits, "hash") == [("a",), ("s",)] and rows(side.file_changes, "commit_hash") == [("a",), ("s",)]


def test_depth_of_a_long_chain(make):
    chain = make.commits([(f"c{i:03}", "A", utc(2020), "m", [f"c{i - 1:03}"] if i else []) for i in range(70)])
    found = ancestry.depths(ancestry.parent_edges(chain), chain)
    assert rows(found, "hash", "depth") == [(f"c{i:03}", i) for i in range(70)]


def test_repeated_commits_do_not_multiply(make):
    one = make.commits([(f"c{i:02}", "A", utc(2020), "m", [f"c{i - 1:02}"] if i else []) for i in range(20)])
    edges = ancestry.parent_edges(one.union(one))
    assert edges.count() == 19
    assert ancestry.shortcuts(edges.union(edges)).count() == ancestry.shortcuts(edges).count()


def test_circles_end(make):
    circle = make.commits([("a", "A", utc(2020), "m", ["b"]), ("b", "A", utc(2020), "m", ["a"])])
    most, ancestry.MAX_ROUNDS = ancestry.MAX_ROUNDS, 4
    try:
        for attempt in (lambda e: ancestry.depths(e, circle), ancestry.shortcuts):
            with pytest.raises(ValueError):
                attempt(ancestry.parent_edges(circle))
    finally:
        ancestry.MAX_ROUNDS = most


def test_all_file_types_are_kept(spark):
    files = spark.createDataFrame([("r", f"f{i}.e{i}") for i in range(14)] + [("r", "g.e3")], "repo string, filepath string")
    types = snapshots.snapshot_stats(files).first().file_types
    assert len(types) == 14 and types[".e3"] == 2
    assert len(snapshots.snapshot_stats(files, 10).first().file_types) == 10


def test_unreadable_dates_are_rejected(spark, tmp_path):
    folder = tmp_path / "log" / "repo=r"
    folder.mkdir(parents=True)
    record = "\x1e{}\x1fA\x1fa@x\x1f{}\x1f\x1fmessage\x1f\nA\tx.py\n"
    (folder / "log.txt").write_text(record.format("h1", 1_600_000_000) + record.format("h2", "soon") + "\x1ehalf\n")
    assert rows(dumps.read_log(spark, str(tmp_path)), "hash") == [("h1",)]
    assert rows(dumps.rejected_records(spark, str(tmp_path)), "repo", "rejected") == [("r", 2)]


def test_store_without_listing(spark, forked, tmp_path):
    commits, changes = forked
    tags = spark.createDataFrame([("r", "v1", "a", "")], "repo string, tag_name string, commit_hash string, tagger_date string")
    built = History(commits=commits, file_changes=changes, branches=branches_of(spark, [("main", "m")]), tags=tags)
    root = f"file://{tmp_path}/store"
    for _ in range(2):
        found = tables.stored_or_built(spark, root, lambda: built)
        assert found.file_presence is None and found.branches.count() == 1 and rows(found.tags, "tag_name") == [("v1",)]
    again = tables.stored_or_built(spark, root, lambda: History(commits=commits, file_changes=changes), use_store=False)
    assert again.branches is None and again.commits.count() == 3


def test_reorganisations_from_a_listing(spark, refactor):
    commits, changes = refactor
    presence = spark.createDataFrame([("r", c, f"{d}/file{i}.py") for c, d in (("c1", "old_module"), ("c2", "new_core"))
                                      for i in (1, 2)], "repo string, commit_hash string, filepath string")
    timeline = lifetimes.listed_timeline(presence, commits)
    for known in (commits, commits.drop("parents")):
        found = lifetimes.reorganisations(changes, timeline, known, 0.5)
        assert rows(found, "commit_hash", "files_moved", "move_ratio") == [("c2", 2, 1.0)]


def test_date_range_without_commits(forked):
    kept = filtered(History(file_changes=forked[1]), AnalysisConfig(date_range="2020-01-01,2020-12-31", min_file_changes=1))
    assert kept.commits is None and kept.file_changes.count() == 3


def test_trend_of_a_dense_month(spark):
    made = spark.range(600).select(
        F.lit("r").alias("repo"), (F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 7211)).alias("date"),
        ((F.col("id") * 37 % 101) / 100).alias("asi"))
    got = {r.date: r.asi_trend for r in persistence.asi_trend(made).collect()}
    known = sorted((r.date, r.asi) for r in made.collect())
    for date, _ in known:
        near = [a for d, a in known if 0 <= (date - d).total_seconds() < 30 * 86400]
        assert abs(got[date] - sum(near) / len(near)) < 1e-9
