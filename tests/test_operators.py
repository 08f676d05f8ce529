import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from revloom.operators import (
    ancestry, commits, contributors, coupling, files, lifetimes, persistence, report, snapshots, stats)
from revloom.plans import order
from tests.conftest import rows, utc


def core_presence(spark):
    listing = [("r", f"h{i}", "core.py") for i in range(9)] + [("r", "h9", "transient.py")]
    presence = spark.createDataFrame(listing, "repo string, commit_hash string, filepath string")
    heads = spark.createDataFrame([("r", f"h{i}") for i in range(10)], "repo string, hash string")
    return files.listed_presence_counts(presence), heads


def test_core_files(spark):
    counts, heads = core_presence(spark)
    assert rows(files.core_files(counts, heads, 0.9), "filepath", "presence_percentage") == [
        ("core.py", 0.9)]
    assert len(rows(files.core_files(counts, heads, 0.1), "filepath")) == 2


def test_volatile_files_count_rows(make):
    changes = make.changes([("h1", "a.py"), ("h1", "a.py"), ("h2", "a.py"), ("h3", "b.py")])
    assert rows(files.volatile_files(changes, 3), "filepath", "commit_count") == [("a.py", 3)]
    assert files.volatile_files(changes, 5).count() == 0


def test_file_churn(make):
    changes = make.changes([("h1", "a.py", "M", 10, 2), ("h2", "a.py", "M", 5, 1),
                            ("h1", "b.py", "M", 100, 50)])
    assert rows(files.file_churn(changes), "filepath", "total_insertions", "total_deletions",
                "total_churn", "commit_count", "avg_churn_per_commit") == [
        ("a.py", 15, 3, 18, 2, 9.0), ("b.py", 100, 50, 150, 1, 150.0)]


def test_simple_history(simple):
    c, f = simple
    sequence = lifetimes.commit_sequence(c)
    life = lifetimes.file_lifetimes(f, sequence)
    heads = lifetimes.head_files(life)
    stats_row = lifetimes.repository_stats(c, heads).collect()[0]
    assert (stats_row.total_commits, stats_row.unique_authors, stats_row.total_files_current) == (11, 1, 4)
    assert stats_row.age_in_days == 10
    top = files.file_churn(f).orderBy(F.desc("total_churn")).first()
    assert (top.filepath, top.commit_count) == ("main.py", 10)
    timeline = rows(lifetimes.complexity_timeline(life, sequence), "seq", "total_files")
    assert sorted(timeline) == [(i, 3) for i in range(1, 11)] + [(11, 4)]
    counts = dict(rows(lifetimes.presence_counts(life, sequence), "filepath", "present_in"))
    assert counts == {"README.md": 11, "main.py": 11, "utils.py": 11, "docs/guide.md": 1}


def test_complex_history(complex_history):
    c, f = complex_history
    people = contributors.contributor_stats(c, f)
    assert people.count() == 3
    assert people.orderBy(F.desc("commit_count"), "author_name").first().author_name == "Alice"
    assert people.agg(F.sum("commit_count")).first()[0] >= 5
    reach = ancestry.reachable(ancestry.parent_edges(c), c.filter("hash = 'm1'"))
    assert rows(reach, "hash") == [("a1",), ("a2",), ("b1",), ("m1",)]
    wide = commits.export_commits(c, f)
    assert rows(wide.filter("is_merge"), "hash", "files_changed") == [("m1", 0)]


def test_refactor_is_a_reorganisation(refactor):
    c, f = refactor
    sequence = lifetimes.commit_sequence(c)
    life = lifetimes.file_lifetimes(f, sequence)
    timeline = lifetimes.complexity_timeline(life, sequence)
    found = lifetimes.reorganisations(f, timeline, c, 0.5)
    assert rows(found, "commit_hash", "message", "files_moved", "move_ratio") == [
        ("c2", "move", 2, 1.0)]
    assert rows(lifetimes.head_files(life), "filepath") == [
        ("new_core/file1.py",), ("new_core/file2.py",)]


def test_abandoned(make):
    c = make.commits([("c1", "Alice", utc(2018)), ("c2", "Bob", utc(2020, 2, 1))])
    f = make.changes([("c2", "main.py", "A")])
    life = lifetimes.file_lifetimes(f, lifetimes.commit_sequence(c))
    found = lifetimes.abandoned_files(lifetimes.head_files(life), lifetimes.last_changes(f, c), c, 730,
                                      "2024-06-01 00:00:00")
    assert rows(found, "filepath", "days_since_change", "last_author") == [("main.py", 1581, "Bob")]


def test_empty_history(make):
    c, f = make.commits([]), make.changes([])
    sequence = lifetimes.commit_sequence(c)
    life = lifetimes.file_lifetimes(f, sequence)
    assert lifetimes.repository_stats(c, lifetimes.head_files(life)).count() == 0
    tables = [files.file_churn(f), files.volatile_files(f), files.hotspot_files(f, c),
              files.file_heat(f), contributors.contributor_stats(c, f), contributors.pareto(
                  contributors.contributors_from_commits(c)), commits.commit_frequency(c),
              commits.commit_patterns(c), report.adaptive_thresholds(c, f),
              coupling.file_coupling(f), lifetimes.complexity_timeline(life, sequence)]
    for table in tables:
        assert table.columns and table.count() == 0


def random_history(make, seed, commits_n=60, files_n=12):
    rng = random.Random(seed)
    c = [(f"h{i:03}", rng.choice("ABC"), utc(2020, 1, 1 + i // 4, hour=rng.randrange(24)))
         for i in range(commits_n)]
    c.sort(key=lambda x: (x[2], x[0]))
    alive, f, listing = set(), [], []
    for name, _, _ in c:
        for path in rng.sample(range(files_n), rng.randrange(1, 4)):
            p = f"d{path % 3}/f{path}.py"
            if p not in alive:
                alive.add(p)
                f.append((name, p, "A", 3, 0))
            elif rng.random() < 0.3:
                alive.remove(p)
                f.append((name, p, "D", 0, 3))
            elif rng.random() < 0.2:
                new = f"e/n{rng.randrange(10 ** 6)}.py"
                alive.remove(p)
                alive.add(new)
                f.append((name, new, "R", 1, 1, p))
            else:
                f.append((name, p, "M", 1, 1))
        listing += [(name, p) for p in alive]
    rng.shuffle(f)
    return make.commits(c), make.changes(f), c, listing


@pytest.mark.parametrize("segment", [1 << 20, 5])
def test_lifetimes_equal_listing(make, monkeypatch, segment):
    monkeypatch.setattr(order, "SEGMENT", segment)
    monkeypatch.setattr(lifetimes, "SEGMENT", segment)
    c, f, plain, listing = random_history(make, 3)
    sequence = lifetimes.commit_sequence(c)
    life = lifetimes.file_lifetimes(f, sequence)
    spread = lifetimes.files_at(life, sequence.select("repo", "seq", "hash"))
    assert rows(spread, "hash", "filepath") == sorted(listing)
    some = sequence.filter("seq % 7 = 3").select("repo", "seq", "hash")
    named = some.crossJoin(some.sparkSession.range(2)).union(some.selectExpr("'other' as repo", "seq", "hash", "9"))
    asked = {r.hash for r in some.collect()}
    assert rows(lifetimes.files_at(life, named), "hash", "filepath", "id") == sorted(
        (h, p, i) for h, p in listing if h in asked for i in range(2))
    counts = dict(rows(lifetimes.presence_counts(life, sequence), "filepath", "present_in"))
    assert counts == dict(Counter(p for _, p in listing))
    sizes = Counter(h for h, _ in listing)
    timeline = rows(lifetimes.complexity_timeline(life, sequence), "hash", "total_files")
    assert timeline == sorted((h, sizes.get(h, 0)) for h, _, _ in plain)
    # the same from a listing
    table = make.spark.createDataFrame([("r", *x) for x in listing],
                                       "repo string, commit_hash string, filepath string")
    assert rows(lifetimes.listed_timeline(table, c), "hash", "total_files") == timeline
    assert rows(lifetimes.listed_head_files(table, c), "filepath") == rows(
        lifetimes.head_files(life), "filepath")


@pytest.mark.parametrize("least,small,block", [(1, 3, 2), (2, 3, 2), (3, 2, 2), (4, 5, 3), (3, 100, 2),
                                               (2, 0, 4)])
def test_coupling_against_brute_force(make, least, small, block):
    rng = random.Random(least * 100 + small)
    changes = []
    for i in range(40):
        size = 25 if i % 13 == 0 else rng.randrange(1, 9)  # some bulk commits
        changes += [(f"h{i}", f"f{x:02}") for x in rng.sample(range(30), size)]
    changes += changes[:20]  # repeated rows count once
    pairs = Counter()
    for commit in {c for c, _ in changes}:
        pairs.update(combinations(sorted({p for c, p in changes if c == commit}), 2))
    found = coupling.file_coupling(make.changes(changes), least, small, block)
    assert rows(found, "file1", "file2", "times_changed_together") == sorted(
        (a, b, n) for (a, b), n in pairs.items() if n >= least)


def test_bulk_commit_lists_no_candidates(make):
    """A bulk commit that is the largest one of all its files is not expanded into pairs."""
    changes = [("bulk", f"f{i}") for i in range(300)]
    changes += [(f"h{i}", f"f{i}") for i in range(300)]
    distinct = coupling._distinct_changes(make.changes(changes))
    members = coupling._members(distinct, coupling._commit_sizes(distinct), 2)
    big = members.filter(F.col("size") > 200)
    assert big.count() == 300
    assert coupling._large_candidates(big, 2, 64).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_reachability_against_brute_force(make, seed):
    rng = random.Random(seed)
    parents = {}
    for i in range(150):
        near = [f"n{j}" for j in range(max(0, i - 6), i)]
        parents[f"n{i}"] = ([f"n{i - 1}"] if i and rng.random() < 0.9 else []) + (
            rng.sample(near, 1) if near and rng.random() < 0.3 else [])
        parents[f"n{i}"] = list(dict.fromkeys(parents[f"n{i}"]))
    c = make.commits([(h, "A", utc(2020), "", p) for h, p in parents.items()])

    def closure(head):
        seen, todo = set(), [head]
        while todo:
            h = todo.pop()
            if h not in seen:
                seen.add(h)
                todo += parents[h]
        return seen

    heads = ["n149", "n120", "n3"]
    head_rows = c.filter(F.col("hash").isin(heads))
    found = ancestry.reachable(ancestry.parent_edges(c), head_rows)
    assert rows(found, "head", "hash") == sorted((h, x) for h in heads for x in closure(h))


def test_long_chain_takes_few_rounds(make, monkeypatch):
    n = 600
    c = make.commits([(f"n{i}", "A", utc(2020), "", [f"n{i - 1}"] if i else []) for i in range(n)])
    rounds = []
    real = ancestry.settle
    monkeypatch.setattr(ancestry, "settle", lambda df: rounds.append(1) or real(df))
    found = ancestry.reachable(ancestry.parent_edges(c), c.filter(f"hash = 'n{n - 1}'"))
    assert found.count() == n
    assert len(rounds) < 40


def test_branches(make, spark):
    c = make.commits([("a", "A", utc(2020), "", []), ("b", "A", utc(2020, 2), "", ["a"]),
                      ("x", "A", utc(2020, 3), "", ["a"])])
    branches = spark.createDataFrame(
        [("r", "main", "main", True, False, "b"), ("r", "main", "origin/main", False, True, "a"),
         ("r", "old", "old", False, False, "a"), ("r", "new", "new", False, False, "x")],
        "repo string, branch_name string, full_name string, is_current boolean, is_remote boolean, "
        "last_commit_hash string")
    edges = ancestry.parent_edges(c)
    facts = ancestry.branch_facts(branches, edges, ancestry.choose_branch(branches))
    assert rows(facts, "branch_name", "full_name", "commit_count", "is_merged") == [
        ("main", "main", 2, False), ("new", "new", 2, False), ("old", "old", 1, True)]
    assert rows(ancestry.choose_branch(branches, "new"), "branch") == [("new",)]
    bare = branches.filter("branch_name <> 'main'").withColumn("is_current", F.col("branch_name") == "old")
    assert rows(ancestry.choose_branch(bare), "branch") == [("old",)]
    assert rows(ancestry.branch_of_commit(c, branches, edges), "hash", "branch") == [
        ("a", "main"), ("b", "main"), ("x", "new")]


def test_branches_by_segments(make, spark):
    """Long chains with forks and merges against plain search, and far fewer segments than commits."""
    rng = random.Random(11)
    parents = {"n0": []}
    for i in range(1, 400):
        up = [f"n{i - 1}" if rng.random() < 0.97 else f"n{rng.randrange(i)}"]
        if rng.random() < 0.03 and i > 2:
            up.append(f"n{rng.randrange(i - 1)}")
        parents[f"n{i}"] = list(dict.fromkeys(up))
    c = make.commits([(h, "A", utc(2020), "", up) for h, up in parents.items()])
    heads = {f"b{i:02}": f"n{rng.randrange(400)}" for i in range(12)} | {"main": "n399"}
    branches = spark.createDataFrame(
        [("r", b, b, b == "main", b == "b03", h) for b, h in heads.items()],
        "repo string, branch_name string, full_name string, is_current boolean, is_remote boolean, last_commit_hash string")

    def closure(head):
        seen, todo = set(), [head]
        while todo:
            h = todo.pop()
            if h not in seen:
                seen.add(h)
                todo += parents[h]
        return seen

    held = {b: closure(h) for b, h in heads.items()}
    edges = ancestry.parent_edges(c)
    facts = ancestry.branch_facts(branches, edges, ancestry.choose_branch(branches))
    assert rows(facts, "branch_name", "commit_count", "is_merged") == sorted(
        (b, len(held[b]), b not in ("main", "b03") and h in held["main"]) for b, h in heads.items())
    first = {h: min((b for b in heads if b != "b03" and h in held[b]), default=None) for h in parents}
    assert dict(rows(ancestry.branch_of_commit(c, branches, edges), "hash", "branch")) == first
    members, links = ancestry.segments(edges, branches.select("repo", F.col("last_commit_hash").alias("hash")))
    assert members.count() == 400 and members.select("top").distinct().count() < 120
    circle = make.commits([("a", "A", utc(2020), "", ["b"]), ("b", "A", utc(2020), "", ["a"])])
    with pytest.raises(ValueError):
        ancestry.segments(ancestry.parent_edges(circle), branches.select("repo", F.lit("zz").alias("hash")))


def test_weekly_bins(make):
    c = make.commits([("a", "A", utc(2020, 1, 4, 10)), ("b", "A", utc(2020, 1, 5, 23)),
                      ("c", "A", utc(2020, 1, 6, 0, 30)), ("d", "A", utc(2020, 1, 20))])
    found = commits.commit_frequency(c, "week")
    assert [(str(a), n) for a, n in rows(found, "period", "commit_count")] == [
        ("2020-01-05", 2), ("2020-01-12", 1), ("2020-01-19", 0), ("2020-01-26", 1)]
    for by in ("day", "month", "quarter", "year", "unknown"):
        total = commits.commit_frequency(c, by).agg(F.sum("commit_count")).first()[0]
        assert total == 4


def test_moving_average(make):
    counts = [5, 1, 2, 3]
    c = make.commits([(f"{m}-{i}", "A", utc(2020, m)) for m, n in enumerate(counts, 1)
                      for i in range(n)])
    found = commits.monthly_commits(c).orderBy("period").collect()
    assert [r.moving_average for r in found] == [None, pytest.approx(8 / 3), 2.0, None]
    assert found[0].trend == "█" * 50 and found[1].trend == "█" * 10
    short = commits.monthly_commits(c.filter("date < '2020-04-01'")).collect()
    assert all(r.moving_average is None for r in short)


def test_asi_trend_treats_equal_times_alike(spark):
    df = spark.createDataFrame([("r", utc(2020, 1, 1), 1.0), ("r", utc(2020, 1, 1), 2.0),
                                ("r", utc(2020, 1, 31), 3.0), ("r", utc(2020, 1, 31), 4.0)],
                               "repo string, date timestamp, asi double")
    assert [x for _, x in rows(persistence.asi_trend(df), "date", "asi_trend")] == [1.5, 3.5]
    inside = df.withColumn("date", F.when(F.month("date") == 1, F.col("date")) - F.make_dt_interval(
        secs=F.when(F.dayofmonth("date") == 31, F.lit(1)).otherwise(F.lit(0)).cast("decimal(18,6)")))
    assert [x for _, x in rows(persistence.asi_trend(inside), "date", "asi_trend")] == [1.5, 2.5]


def test_heat_with_equal_quantiles(make):
    f = make.changes([("h1", "a"), ("h1", "b"), ("h1", "c"), ("h2", "c")])
    assert rows(files.file_heat(f), "filepath", "category") == [
        ("a", "Stable"), ("b", "Stable"), ("c", "Critical")]


def test_persistence_edges(spark):
    one = spark.createDataFrame([("r", "a", utc(2020), 0)],
                                "repo string, hash string, date timestamp, lines_changed long")
    m = persistence.persistence_metrics(one).first().architectural_metrics
    assert (m.age_days, m.age_months, m.churn_rate, m.survival_rate, m.asi) == (0, 1.0, 0.0, 0.0, 0.0)
    two = spark.createDataFrame([("r", "a", utc(2020), 10), ("r", "b", utc(2020, 12, 31), 5)],
                                "repo string, hash string, date timestamp, lines_changed long")
    found = {r.hash: r.architectural_metrics for r in persistence.persistence_metrics(two).collect()}
    assert (found["b"].survival_rate, found["b"].asi) == (1.0, 0.6667)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("r", 3.0)] * 4, "repo string, v double")
    found = rows(stats.histogram(df, "v", 2), "bin", "lower", "upper", "count")
    assert found == [(1, 2.5, 3.0, 0), (2, 3.0, 3.5, 4)]


def test_results_ignore_row_order_and_partitions(make):
    c, f, _, _ = random_history(make, 9)
    def everything(c, f):
        people = contributors.contributors_from_commits(c)
        return [rows(t, *t.columns) for t in (
            files.file_churn(f), files.hotspot_files(f, c), contributors.pareto(people),
            contributors.top_contributors(people, 2), files.top_changed_files(f, 5))]
    shuffled = (c.orderBy(F.rand(1)).repartition(5), f.orderBy(F.rand(2)).repartition(3))
    assert everything(c, f) == everything(*shuffled)


def test_shares_sum_to_one_hundred(make):
    _, f, _, _ = random_history(make, 4)
    total = files.language_distribution(f).agg(F.sum("percentage")).first()[0]
    assert total == pytest.approx(100)


def test_commit_as_of(make, spark):
    c = make.commits([("a", "A", utc(2020, 1, 1), "one\nbody"), ("b", "B", utc(2020, 2, 1), "two"),
                      ("c", "C", utc(2020, 2, 1), "three")])
    targets = spark.createDataFrame([("r", "early", utc(2019)), ("r", "mid", utc(2020, 1, 15)),
                                     ("r", "tie", utc(2020, 2, 1)), ("r", "late", utc(2030))],
                                    "repo string, snapshot_id string, target timestamp")
    found = snapshots.commit_as_of(targets, c)
    assert rows(found, "snapshot_id", "commit_hash", "author", "commit_message") == [
        ("early", "a", "A", "one"), ("late", "c", "C", "three"), ("mid", "a", "A", "one"),
        ("tie", "c", "C", "three")]


def test_directory_tree_order(spark):
    files_df = spark.createDataFrame(
        [("r", p) for p in ("b.txt", "A.md", "src/z.py", "src/Core/x.py", "docs/i.md", "src/a.py")],
        "repo string, filepath string")
    tree = snapshots.directory_tree(files_df)
    ordered = [r.path for r in tree.orderBy("sort_path", "path").collect()]
    assert ordered == ["docs", "docs/i.md", "src", "src/Core", "src/Core/x.py", "src/a.py", "src/z.py",
                       "A.md", "b.txt"]
    assert rows(tree.filter("type = 'directory'"), "path", "children", "depth") == [
        ("docs", 1, 1), ("src", 3, 1), ("src/Core", 1, 2)]


def test_snapshot_from_listing(spark):
    found = spark.createDataFrame([("r", "s1", "c1")],
                                  "repo string, snapshot_id string, commit_hash string")
    tree = spark.createDataFrame([("r", "c1", "a.py", "100644", 10), ("r", "c1", "b", "100644", 5),
                                  ("r", "c2", "z", "100644", 1)],
                                 "repo string, commit_hash string, filepath string, mode string, size long")
    listed = snapshots.listed_snapshot_files(found, tree)
    one = snapshots.snapshot_stats(listed).first()
    assert (one.total_files, one.total_size, one.file_types) == (2, 15, {".py": 1, "no_ext": 1})


def test_threshold_defaults(make):
    c = make.commits([("a", "A", utc(2020)), ("b", "A", utc(2020, 3, 1))])
    assert rows(report.adaptive_thresholds(c, make.changes([])), "high_churn", "stable_days") == [(50, 15)]
    alone = make.changes([("a", "x")])
    assert rows(report.adaptive_thresholds(make.commits([]), alone), "high_churn", "stable_days") == [
        (50, 180)]
    assert rows(report.adaptive_thresholds(c, alone), "high_churn", "stable_days") == [(10, 15)]


def test_pairs_are_counted_by_number(make):
    """Paths do not travel with the pairs; the lesser path is the first one whatever the numbers are."""
    changes = make.changes([(f"h{i}", p) for i in range(3) for p in ("z/long", "a/long", "m/long")])
    numbered, files = coupling._numbered(coupling._distinct_changes(changes), 2)
    pairs = coupling._small_pairs(coupling._members(numbered, coupling._commit_sizes(numbered), 1))
    assert {k for n, k in pairs.dtypes if n in ("file1", "file2")} == {"bigint"}
    assert rows(coupling._named(pairs, files), "file1", "file2", "small") == [
        ("a/long", "m/long", 3), ("a/long", "z/long", 3), ("m/long", "z/long", 3)]


def test_tree_of_odd_paths_without_a_join_of_files(spark):
    names = ["a//b", "/x", "A/İ/Ü.txt", "top", "a/b/", "a/c", "a/c/d", "B/c.d/e", "", "a/x\n"]
    files = spark.createDataFrame([("r", "s", n) for n in names], "repo string, snapshot_id string, filepath string")
    tree = snapshots.directory_tree(files)
    assert tree._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # files do not meet the counts
    above = {"/".join(n.split("/")[:i]) for n in names for i in range(1, n.count("/") + 1)}
    nodes = [(n, "file") for n in names] + [(d, "directory") for d in above]
    parent = lambda p: p.rpartition("/")[0]
    expected = []
    for path, kind in nodes:
        parts = path.lower().split("/")
        mark = "0" if kind == "directory" else "1"
        expected.append((path, kind, parent(path), path.count("/") + 1, path.split("/")[-1],
                         sum(parent(p) == path for p, _ in nodes) if kind == "directory" else -1,
                         "\u0001".join([*("0" + p for p in parts[:-1]), mark + parts[-1]])))
    found = tree.fillna(-1, ["children"])
    assert rows(found, "path", "type", "parent_path", "depth", "name", "children", "sort_path") == sorted(expected)
