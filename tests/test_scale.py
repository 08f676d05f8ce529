"""Plans and shares of work that must not grow with the input."""

import random
import re

import pytest
from pyspark.sql.functions import udf

from revloom.operators import coupling, lifetimes, listings
from revloom.plans import analyses, order
from revloom.plans.runtime import TASK_BYTES, byte_size, size_partitions
from revloom.plans.skew import join_by_number
from revloom.sources import documents, dumps, tables
from conftest import rows


@pytest.fixture
def plain(spark):
    """No broadcast by size, no adaptive execution: what is left is what the code asks for."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_open_lifetimes_are_spread(plain):
    spans = plain.range(200).selectExpr("'r' AS repo", "concat('f', id) AS filepath", "1L AS from_seq", "CAST(NULL AS long) AS to_seq")
    ended = plain.createDataFrame([("r", "gone", 1, 3), ("r", "late", 4, None), ("q", "alone", 1, None)],
                                  "repo string, filepath string, from_seq long, to_seq long")
    found = lifetimes.files_at(spans.union(ended), plain.createDataFrame([("r", 3, "s")], "repo string, seq long, name string"))
    assert rows(found, "repo", "seq", "name", "filepath") == sorted(("r", 3, "s", f"f{i}") for i in range(200))
    # one point and one open end: not one task, and no shuffle of the rows made
    assert found.selectExpr("spark_partition_id() AS p").distinct().count() > 1
    assert not re.search(r"hashpartitioning\(repo#\d+, position#", _plan(found))


def test_rows_of_documents_are_not_shuffled_by_repository(plain):
    table = plain.range(50).selectExpr("if(id % 5 = 0, 'small', 'hot') AS repo", "concat('h', id) AS hash")
    packed = documents.to_documents({"commits": table}, 10)
    assert not re.search(r"hashpartitioning\(repo#\d+, \d+\)", _plan(packed))
    read = packed.selectExpr("repo", "explode(from_json(document, 'commits array<struct<hash:string>>').commits.hash) AS hash")
    assert rows(read, "repo", "hash") == rows(table, "repo", "hash")


def test_tree_in_parts_and_compressed(spark, tmp_path):
    lines = [("r", "c1\x1f\n100644 blob b1    12\ta b/x.py\n160000 commit 00  -\tsub\n"), ("r", "c1\x1f\n100755 blob b2  -\ty\tz\n"),
             ("r", "c2\x1f\n\tonly\nname only\n")]
    spark.createDataFrame(lines, "repo string, value string").write.partitionBy("repo").option("lineSep", "\x1e").text(
        f"{tmp_path}/tree", compression="gzip")
    assert rows(dumps.read_tree(spark, str(tmp_path)), "commit_hash", "filepath", "mode", "blob", "size") == [
        ("c1", "a b/x.py", "100644", "b1", 12), ("c1", "y\tz", "100755", "b2", 0), ("c2", "name only", None, None, None)]


def test_changes_are_computed_once_for_all_analyses(spark, make, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    changes = make.changes([(f"c{i}", f"src/f{i % 3}.py") for i in range(12)]).localCheckpoint()

    @udf("string")
    def counted(path):
        seen.add(1)
        return path

    history = tables.History(file_changes=changes.withColumn("filepath", counted.asNondeterministic()("filepath")))
    config = analyses.AnalysisConfig(modules=("files", "hotspots"), min_file_changes=1)
    written = analyses.run_and_write(spark, history, str(tmp_path), config)
    assert {row[2] for row in written.rows} == {"done"} and len(written.rows) > 5
    assert seen.value <= 2 * 12


def test_partitions_grow_with_the_input(spark, tmp_path):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.range(10_000).write.parquet(f"{tmp_path}/t")
    try:
        assert size_partitions(spark, f"{tmp_path}/t", f"{tmp_path}/missing") == int(before)
        more = size_partitions(spark, f"{tmp_path}/t", bytes_each=1000)
        assert more > int(before) and spark.conf.get(key) == str(more)
        assert size_partitions(spark, f"{tmp_path}/t") == more
    finally:
        spark.conf.set(key, before)


def test_tasks_are_joined_up_to_a_fixed_size(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        for asked, kept in (("64m", TASK_BYTES), ("1m", 1 << 20)):
            spark.conf.set(key, asked)
            size_partitions(spark)
            assert byte_size(spark, spark.conf.get(key)) == kept
    finally:
        spark.conf.set(key, before)


def _history(spark, most=40):
    """Files of a history that come and go, some in every commit, and the lifetimes found one by one."""
    pick = random.Random(7)
    changes = [("r", f"c{n}", f"f{f}", pick.choice("AMD")) for n in range(1, most + 1) for f in range(6)
               if f == 0 or pick.random() < 0.3]
    expected, since = [], {}
    for _, commit, path, kind in changes:
        if kind == "D":
            if path in since:
                expected.append(("r", path, since.pop(path), int(commit[1:])))
        else:
            since.setdefault(path, int(commit[1:]))
    expected += [("r", path, start, None) for path, start in since.items()]
    numbers = spark.createDataFrame([("r", f"c{n}", n) for n in range(1, most + 1)], "repo string, hash string, seq long")
    rows_of = spark.createDataFrame(changes, "repo string, commit_hash string, filepath string, change_type string")
    return rows_of, numbers, expected


@pytest.mark.parametrize("segment", [1, 3, 7, 1 << 20])
def test_lifetimes_across_segments_read_the_changes_once(spark, monkeypatch, segment):
    monkeypatch.setattr(lifetimes, "SEGMENT", segment)
    monkeypatch.setattr(order, "SEGMENT", segment)
    changes, numbers, expected = _history(spark)
    changes, planned, settle = changes.localCheckpoint(), [], lifetimes.settle
    monkeypatch.setattr(lifetimes, "settle", lambda df: planned.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or settle(df))
    found = lifetimes.file_lifetimes(changes, numbers)
    assert rows(found, "repo", "filepath", "from_seq", "to_seq") == sorted(
        expected, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert sum(len(re.findall(r"LogicalRDD \[repo#\d+, commit_hash#", plan)) for plan in planned) == 1


def test_join_by_number(spark):
    left = spark.createDataFrame([("r", "a", 1), ("r", None, 2), (None, "a", 3), ("r", "b", 4)], "repo string, hash string, n int")
    right = spark.createDataFrame([("r", "a", 10), ("r", "a", 11), ("r", None, 12), (None, "a", 13)], "repo string, hash string, m int")
    for how in ("inner", "left"):
        assert rows(join_by_number(left, right, ["repo", "hash"], how), "repo", "hash", "n", "m") == rows(
            left.join(right, ["repo", "hash"], how), "repo", "hash", "n", "m")
    numbered = right.selectExpr("10L AS n", "m")
    assert join_by_number(left.withColumn("n", left.n + 9), numbered, ["n"]).count() == 4


def test_line_counts_are_sorted_by_number(plain, make):
    changes = make.changes([("c1", "a", "M"), ("c1", "b", "M"), ("c2", "a", "M")]).select("repo", "commit_hash", "filepath", "change_type")
    numstat = plain.createDataFrame([("r", "c1", 0, "a", 1, 2), ("r", "c1", 1, "a", 3, 4), ("r", "c2", 0, "z", 5, 6)],
                                    "repo string, commit_hash string, line_no int, filepath string, insertions long, deletions long")
    found = dumps.with_line_counts(changes, numstat)
    assert found.columns == ["repo", "commit_hash", "filepath", "change_type", "insertions", "deletions", "total_churn"]
    assert rows(found, "commit_hash", "filepath", "insertions", "deletions", "total_churn") == [
        ("c1", "a", 3, 4, 7), ("c1", "b", 0, 0, 0), ("c2", "a", 0, 0, 0)]
    plan = _plan(found)
    assert re.search(r"SortMergeJoin \[_code#", plan) and plan.count("Exchange hashpartitioning(") == 2


def test_files_of_a_part_are_made_by_one_task(spark, monkeypatch):
    monkeypatch.setattr(lifetimes, "TASK_ROWS", 40)
    spans = spark.range(60).selectExpr("'r' AS repo", "concat('f', id) AS filepath", "id % 7 AS part", "1L AS from_seq",
                                       "CAST(if(id % 2 = 0, 4, NULL) AS long) AS to_seq")
    points = spark.createDataFrame([("r", n) for n in range(1, 7)], "repo string, seq long")
    found = lifetimes.files_at(spans, points, ["part"], together=["repo", "part"])
    assert rows(found, "seq", "filepath") == sorted((n, f"f{i}") for i in range(60) for n in range(1, 7) if i % 2 or n < 4)
    at = found.selectExpr("part", "spark_partition_id() AS p").distinct().collect()
    assert len({r.part for r in at}) == len(at) == 7 and len({r.p for r in at}) > 1
    # rows made are grouped by part and point without another shuffle
    assert not re.search(r"hashpartitioning\(repo#\d+, part#\d+, seq#", _plan(found.groupBy("repo", "part", "seq").count()))


def test_listing_is_packed_before_it_is_shuffled(plain):
    """130 commits list the same files, with a gap and other attributes on the way, one of them twice."""
    cells = [("r", f"c{n:03}", f"f{f}", 1 if n < 100 else 2) for n in range(1, 131) for f in range(5) if n != 70 or f]
    cells += [("r", "c010", "f1", 0), ("r", "c011", "f1", 9), ("r", "c012", "f2", None)]
    tree = plain.createDataFrame(cells, "repo string, commit_hash string, filepath string, size long").coalesce(1)
    order = plain.createDataFrame([("r", f"c{n:03}", n) for n in range(1, 131)], "repo string, hash string, seq long")
    packed = listings.pack_listing(tree, order)
    runs = [(f, 1, 1, 100) for f in ("f2", "f3", "f4")] + [(f, 2, 100, 131) for f in ("f0", "f1", "f2", "f3", "f4")] + [
        ("f0", 1, 1, 70), ("f0", 1, 71, 100), ("f1", 1, 1, 11), ("f1", 9, 11, 12), ("f1", 1, 12, 100)]
    assert rows(packed, "filepath", "size", "from_seq", "to_seq") == sorted(runs, key=lambda r: tuple((False, str(x)) for x in r))
    # of 653 rows one per file, attributes and block leaves the task that read them
    sent = packed._jdf.queryExecution().executedPlan()
    assert "partial_bit_or" in sent.toString() and not re.search(
        r"hashpartitioning\(repo#\d+, filepath#\d+, _segment#", sent.toString())


def test_tables_of_documents_meet_in_one_shuffle(plain):
    table = plain.range(50).selectExpr("if(id % 5 = 0, 'small', 'hot') AS repo", "concat('h', id) AS hash")
    tags = plain.range(3).selectExpr("'hot' AS repo", "concat('t', id) AS tag_name")
    packed = documents.to_documents({"commits": table, "tags": tags, "branches": table}, 10)
    assert _plan(packed).count("Exchange hashpartitioning(") == 1
    texts = [r.document for r in packed.collect()]
    assert len(texts) == 5 and sum("tags" in x for x in texts) == 1  # a table without rows is not named
    assert sum(x.count('"hash"') for x in texts) == 100 and sum(x.count('"tag_name"') for x in texts) == 3


def test_lists_of_small_commits_are_not_shuffled_again(plain, make):
    changes = make.changes([(f"c{n}", f"f{f}") for n in range(6) for f in range(n % 4 + 1)])
    distinct = coupling._distinct_changes(changes)
    members = coupling._members(distinct, coupling._commit_sizes(distinct), 1)
    lists = members.groupBy("repo", "commit_hash").agg({"filepath": "collect_list"})
    assert _plan(lists).count("Exchange hashpartitioning(") == 2
    pairs = rows(coupling.file_coupling(changes, 1), "file1", "file2", "times_changed_together")
    assert pairs == [("f0", "f1", 4), ("f0", "f2", 2), ("f0", "f3", 1), ("f1", "f2", 2), ("f1", "f3", 1), ("f2", "f3", 1)]
