import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from revloom.operators.persistence import persistence_metrics
from revloom.operators import commits as commit_ops, contributors
from revloom.plans import analyses
from revloom.sources import documents, dumps, sinks, store, tables, wide_log
from tests.conftest import rows

RS, US = "\x1e", "\x1f"


def put(root, kind, repo, content):
    folder = Path(root) / kind / f"repo={repo}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "dump.txt").write_bytes(content.encode())


@pytest.fixture()
def dump(tmp_path):
    log = (f"{RS}h1{US}Ann | Bee{US}ann@x.org{US}1577880000{US}{US}First line\n\nBody | with\tsigns\n{US}\n"
           "A\ta.py\nA\timg.png\n"
           f"{RS}h2{US}Bob{US}bob@x.org{US}1577966400{US}h1{US}Move{US}\n"
           "R100\ta.py\tlib/b.py\nC75\tlib/b.py\tlib/c.py\nT\tlink\nM\timg.png\nD\tgone.py\n"
           f"{RS}h2{US}Bob{US}bob@x.org{US}1577966400{US}h1{US}Move{US}\nM\timg.png\n"
           f"{RS}h3{US}Bob{US}bob@x.org{US}1578052800{US}h1 h2{US}Merge{US}")
    numstat = (f"{RS}h1{US}\n10\t0\ta.py\n-\t-\timg.png\n"
               f"{RS}h2{US}\n1\t2\t{{ => lib}}/b.py\n3\t0\tlib/c.py\n7\t7\tlib/c.py\n")
    put(tmp_path, "log", "007", log)
    put(tmp_path, "numstat", "007", numstat)
    put(tmp_path, "tree", "007", f"{RS}h1{US}\n100644 blob ab12     10\ta.py\n160000 commit ff00       -\tsub\n"
                                 f"{RS}h2{US}\nlib/b.py\nimg.png\n")
    put(tmp_path, "refs", "007", "main\0h3\x002020-01-03\0Bob\0origin/main\0*\0\n"
                                 "origin/HEAD\0h1\0d\0Ann\0\0\0origin/main\n"
                                 "origin/main\0h1\x002020-01-01\0Ann\0\0 \0\nshort\0h1\n")
    put(tmp_path, "tags", "007", "v1\0h1\x002020-01-01\0Ann\0release\nv2\0h2\nbroken\n")
    return str(tmp_path)


def test_log(spark, dump):
    log = dumps.read_log(spark, dump)
    found = dumps.commits_from_log(log)
    assert rows(found, "repo", "hash", "author_name", "message", "parents") == [
        ("007", "h1", "Ann | Bee", "First line\n\nBody | with\tsigns", []),
        ("007", "h2", "Bob", "Move", ["h1"]), ("007", "h3", "Bob", "Merge", ["h1", "h2"])]
    assert rows(found.select("hash", F.date_format("date", "yyyy-MM-dd HH").alias("d")), "hash", "d")[0] == (
        "h1", "2020-01-01 12")
    assert rows(dumps.changes_from_log(log), "commit_hash", "filepath", "change_type", "old_path") == sorted([
        ("h1", "a.py", "A", None), ("h1", "img.png", "A", None), ("h2", "lib/b.py", "R", "a.py"),
        ("h2", "lib/c.py", "C", "lib/b.py"), ("h2", "img.png", "M", None), ("h2", "img.png", "M", None),
        ("h2", "gone.py", "D", None)])


def test_line_counts_are_not_zero(spark, dump):
    history = tables.read_history(spark, dump)
    assert rows(history.file_changes, "filepath", "change_type", "insertions", "deletions", "total_churn") == [
        ("a.py", "A", 10, 0, 10), ("gone.py", "D", 0, 0, 0), ("img.png", "A", 0, 0, 0),
        ("img.png", "M", 0, 0, 0), ("img.png", "M", 0, 0, 0), ("lib/b.py", "R", 1, 2, 3),
        ("lib/c.py", "C", 7, 7, 14)]
    binary = dumps.read_numstat(spark, dump).filter("is_binary_change")
    assert rows(binary, "filepath") == [("img.png",)]
    wide = commit_ops.export_commits(history.commits, history.file_changes)
    assert wide.agg(F.sum("lines_changed")).first()[0] == 27


def test_tree_refs_tags(spark, dump):
    assert rows(dumps.read_tree(spark, dump), "commit_hash", "filepath", "mode", "size") == [
        ("h1", "a.py", "100644", 10), ("h2", "img.png", None, None), ("h2", "lib/b.py", None, None)]
    refs = dumps.read_refs(spark, dump)
    assert rows(refs, "branch_name", "full_name", "is_current", "is_remote") == [
        ("HEAD", "origin/HEAD", False, True), ("main", "main", True, False),
        ("main", "origin/main", False, True)]
    assert rows(dumps.default_branches(refs), "branch") == [("main",)]
    assert rows(dumps.read_tags(spark, dump), "tag_name", "is_annotated", "subject") == [
        ("v1", True, "release"), ("v2", False, "")]


def test_pipe_log_over_many_splits(spark, tmp_path):
    """Headers are carried over the borders of file splits."""
    text, want_commits, want_changes = "", [], []
    for i in range(400):
        text += f"h{i:03}|Ann|ann@x.org|{1577880000 + i}|fix a | b {i}\n\n"
        want_commits.append((f"h{i:03}", f"fix a | b {i}"))
        for j in range(i % 4):
            text += f"M\tdir/file{j}.py\n"
            want_changes.append((f"h{i:03}", f"dir/file{j}.py"))
    text += "broken line\nnot|enough|parts\nM\tlost.py\n"
    put(tmp_path, "pipe", "r1", text)
    put(tmp_path, "pipe", "r2", "x1|Bob|b@x|1577880000|one\nR090\told\tnew\nX\tskipped\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        commits, changes = dumps.read_pipe_log(spark, f"{tmp_path}/pipe")
        assert rows(commits.filter("repo = 'r1'"), "hash", "message") == want_commits
        assert rows(changes.filter("repo = 'r1'"), "commit_hash", "filepath") == want_changes
        assert rows(changes.filter("repo = 'r2'"), "filepath", "old_path", "change_type") == [
            ("new", "old", "R")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_documents(spark, tmp_path):
    doc = {"repository_info": {"repo_name": "one"}, "commits": [
        {"hash": "a", "author_name": "Ann", "author_email": "a@x", "author_date": "2020-01-01T10:00:00+02:00",
         "commit_date": "2020-01-01T10:00:00+02:00", "subject": "s", "parent_hashes": "p q",
         "lines_changed": 3, "architectural_metrics": {"age_days": 1, "asi": 0.5}},
        {"hash": "b", "commit_date": "not a date"}],
        "file_changes": [{"commit_hash": "a", "commit_date": "2020-01-01T08:00:00Z", "change_type": "R100",
                          "file_path": "x.py", "old_file_path": "y.py"},
                         {"commit_hash": "a", "commit_date": "2020-01-01T08:00:00Z", "file_path": ""},
                         {"commit_hash": "a", "commit_date": None, "file_path": "z"}],
        "contributors": []}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "two.json").write_text(json.dumps({"tags": [{"tag_name": "v1", "commit_hash": "a"}]}, indent=2))
    read = documents.read_documents(spark, str(tmp_path))
    history = documents.history_from_documents(read)
    assert rows(history.commits.withColumn("d", F.date_format("date", "HH:mm")), "repo", "hash", "d", "asi",
                "parents") == [("one", "a", "08:00", 0.5, ["p", "q"])]
    assert rows(history.file_changes, "filepath", "old_path") == [("x.py", "y.py")]
    assert rows(history.tags, "repo", "tag_name") == [("two", "v1")]
    assert history.contributors.count() == 0
    assert rows(documents.missing_sections(read), "repo", "section") == [
        ("one", "contributors"), ("two", "commits"), ("two", "contributors"), ("two", "file_changes"),
        ("two", "repository_info")]


def test_documents_round_trip_in_parts(spark, simple, tmp_path):
    c, f = simple
    wide = persistence_metrics(commit_ops.export_commits(c, f))
    history = tables.History(commits=wide, file_changes=f,
                             contributors=contributors.contributor_export(c, f))
    packed = documents.to_documents(documents.export_form(history), 5)
    assert packed.count() > 1
    packed.select("document").write.text(str(tmp_path / "docs"))
    back = documents.history_from_documents(
        documents.read_documents(spark, str(tmp_path / "docs"), one_per_line=True))
    assert rows(back.commits, "hash", "message", "asi") == rows(
        wide.select("*", "architectural_metrics.asi"), "hash", "message", "asi")
    assert rows(back.file_changes, "commit_hash", "filepath") == rows(f, "commit_hash", "filepath")
    assert rows(back.contributors, "author_name", "commit_count") == [("Alice", 11)]


def test_table_store(spark, simple, tmp_path, caplog):
    c, f = simple
    root = str(tmp_path / "store")
    built = []

    def build():
        built.append(1)
        return tables.History(commits=c, file_changes=f,
                              file_presence=f.select("repo", "commit_hash", "filepath"))
    first = tables.stored_or_built(spark, root, build)
    second = tables.stored_or_built(spark, root, build)
    assert built == [1]
    assert rows(first.commits, "hash") == rows(second.commits, "hash") == rows(c, "hash")
    tables.stored_or_built(spark, root, build, use_store=False)
    assert built == [1, 1]
    assert tables.read_tables(spark, str(tmp_path / "nothing")) is None
    numbers = tables.History(**{n: t.withColumn("repo", F.lit("007")) for n, t in build().tables().items()})
    tables.write_tables(numbers, root + "2")
    assert tables.read_tables(spark, root + "2").commits.first().repo == "007"


def test_stored_tables_are_pruned(spark, simple, tmp_path):
    """Repository filters prune folders, date filters and columns reach the scan."""
    from revloom.operators import clean, files
    c, f = simple
    root = str(tmp_path / "store")
    tables.write_tables(tables.History(commits=c, file_changes=f, file_presence=f.select(
        "repo", "commit_hash", "filepath")), root)
    history = tables.read_tables(spark, root)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    dated = plan(clean.filter_dates(history.commits.filter("repo = 'r'"), "2020-01-02,2020-01-03"))
    assert "GreaterThanOrEqual(date" in dated and "PartitionFilters: [isnotnull(repo" in dated
    churn = plan(files.volatile_files(history.file_changes, 2))
    assert "ReadSchema: struct<filepath:string>" in churn


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("r", (1, "x,y"), ["a"])], "repo string, m struct<b:int,a:string>, l array<string>")
    path = str(tmp_path / "csv")
    assert sinks.write_csv(df, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert back.columns == ["l", "m_a", "m_b", "repo"]
    assert tuple(back.first()) == ('["a"]', "x,y", "1", "r")
    assert not sinks.write_csv(df.filter("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_limited_history_and_views(spark, simple):
    c, f = simple
    cut = tables.limit_history(tables.History(commits=c, file_changes=f), 2)
    assert rows(cut.commits, "hash") == [("c10",), ("c11",)]
    assert rows(cut.file_changes, "filepath") == [("docs/guide.md",), ("main.py",)]
    tables.History(commits=c, file_changes=f).register_views("t_")
    assert spark.sql("SELECT count(*) FROM t_commits JOIN t_file_changes ON hash = commit_hash").first()[0] == 13


def test_build_history(spark, simple):
    c, f = simple
    built = tables.build_history(tables.History(commits=c, file_changes=f))
    assert set(built.tables()) == {"commits", "file_changes", "contributors", "language_statistics",
                                   "commit_patterns"}
    assert rows(built.language_statistics, "language", "file_count", "percentage") == [
        ("Markdown", 2, 50.0), ("Python", 2, 50.0)]
    bare = tables.build_history(tables.History(commits=c, file_changes=f), patterns=False,
                                with_contributors=False, metrics=False)
    assert set(bare.tables()) == {"commits", "file_changes", "language_statistics"}
    assert "architectural_metrics" not in bare.commits.columns


def test_analyses(spark, simple):
    c, f = simple
    wide = commit_ops.export_commits(c, f)
    config = analyses.AnalysisConfig(modules=("commits", "contributors", "files", "hotspots", "activity",
                                              "architectural", "nonsense"), min_file_changes=1)
    outcome = analyses.run(tables.History(commits=wide, file_changes=f), config)
    assert outcome.skipped == {"nonsense": "unknown analysis"}
    for made in outcome.tables.values():
        for table in made.values():
            assert table.count() > 0
    no_changes = analyses.run(tables.History(commits=c), config)
    assert no_changes.skipped["files"] == "missing tables: file_changes"
    assert no_changes.skipped["architectural"].startswith("failed")
    assert no_changes.status(spark).filter("status = 'done'").count() == 3


def test_analyses_filters(spark, simple):
    c, f = simple
    config = analyses.AnalysisConfig(date_range="2020-01-02,2020-01-05T23:00:00", exclude_paths=("^docs/",))
    ready = analyses.filtered(tables.History(commits=c, file_changes=f), config)
    assert ready.commits.count() == 4
    assert rows(ready.file_changes, "filepath") == [("main.py",)] * 4


def test_outcomes_of_a_written_run(spark, simple, tmp_path, monkeypatch):
    """A module that fails when it is computed is reported and leaves nothing; the others are written and counted."""
    c, f = simple
    monkeypatch.setitem(analyses.REGISTRY, "late", analyses.Analysis("late", frozenset({"commits"}), lambda h, _: {
        "fine": h.commits, "bad": h.commits.select(F.raise_error(F.lit("no luck")).cast("string").alias("x"))}))
    config = analyses.AnalysisConfig(modules=("late", "commits", "hotspots", "none"), min_file_changes=1)
    written = analyses.run_and_write(spark, tables.History(commits=c, file_changes=f), f"file://{tmp_path}/out", config)
    status = {(r.analysis, r.table_name): r for r in written.status(spark).collect()}
    assert status["late", None].status == "failed" and "no luck" in status["late", None].reason
    assert status["none", None].status == "skipped" and not (tmp_path / "out" / "late").exists()
    done = [r for r in status.values() if r.status == "done"]
    assert {r.analysis for r in done} == {"commits", "hotspots"} and len(done) == 11
    assert all(written.read(spark, r.analysis, r.table_name).count() == r.rows for r in done)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_records_of_merges_are_numbered(spark, tmp_path):
    """Across files and splits; a merge that equals a parent does not say which record is whose."""
    merge = f"{RS}m{US}Ann{US}a@x.org{US}1577880000{US}p q{US}Merge{US}\n"
    log = [f"{RS}p{US}Ann{US}a@x.org{US}1577880000{US}{US}One{US}\nA\tx\n", merge + "M\tx\n", merge + "A\ty\n",
           merge.replace("m", "n", 1).replace("p q", "p m") + "M\tz\n"]
    put(tmp_path, "log", "r", "".join(log))
    put(tmp_path, "numstat", "r", f"{RS}p{US}\\n1\t0\tx\n{RS}m{US}\n5\t1\tx\n{RS}m{US}\n2\t0\ty\n9\t9\tx\n{RS}n{US}\n3\t0\tz\n".replace("\\n", "\n"))
    filler = "".join(f"{RS}f{i:04}{US}Ann{US}a@x.org{US}1577880000{US}{US}{'word ' * 40}{US}\nA\tf{i}\n" for i in range(400))
    put(tmp_path, "log", "s", filler + merge + "M\tx\n" + merge + f"A\ty\n{filler}")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (most, "20k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            changes = dumps.changes_from_log(dumps.read_log(spark, str(tmp_path), numbered=True))
            assert rows(changes.filter("repo = 'r'"), "commit_hash", "filepath", "record_no", "parent_place") == [
                ("m", "x", 0, 0), ("m", "y", 1, 1), ("n", "z", 0, None), ("p", "x", 0, 0)]
            assert rows(changes.filter("repo = 's' and commit_hash = 'm'"), "filepath", "parent_place") == [("x", 0), ("y", 1)]
            assert changes.filter("repo = 's'").count() == 802
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert rows(dumps.first_parent_changes(changes).filter("repo = 'r'"), "commit_hash", "filepath") == [("m", "x"), ("p", "x")]
    counted = dumps.with_line_counts(changes, dumps.read_numstat(spark, str(tmp_path), numbered=True))
    assert rows(counted.filter("repo = 'r'"), "commit_hash", "filepath", "insertions") == [
        ("m", "x", 5), ("m", "y", 2), ("n", "z", 3), ("p", "x", 1)]


def test_store_with_one_commit_point(spark, simple, tmp_path):
    c, f = simple
    two = lambda df: df.unionByName(df.withColumn("repo", F.lit("007")))
    marks = lambda **of: spark.createDataFrame([(k.strip("_"), v) for k, v in of.items()], "repo string, fingerprint string")
    seen, root = [], f"file://{tmp_path}/store"

    def build(changed):
        seen.append(sorted(r.repo for r in changed.collect()))
        return tables.History(commits=two(c), file_changes=two(f))

    assert store.read_store(spark, root) is None
    store.refresh(spark, root, marks(r="a", _007="a"), build)
    first = store.read_store(spark, root)
    assert rows(first.commits, "repo", "hash") == rows(two(c), "repo", "hash") and first.tags is None
    assert rows(first.file_changes, *f.columns) == rows(two(f), *f.columns)
    # a run that ends between two tables
    broken = tables.History(commits=two(c).limit(1), file_changes=two(f).withColumn(
        "filepath", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        store.refresh(spark, root, marks(r="b", _007="a"), lambda changed: broken)
    assert rows(store.read_store(spark, root).commits, "repo", "hash") == rows(two(c), "repo", "hash")
    # the next one writes what changed, and nothing of what did not
    store.refresh(spark, root, marks(r="b", _007="a"), build)
    assert seen == [["007", "r"], ["r"]]
    folders = sorted(p.parent.name + "/" + p.name for p in (tmp_path / "store/data/commits").glob("version=*/repo=*"))
    assert folders[-1] == "version=3/repo=r" and "version=3/repo=007" not in folders
    assert rows(store.read_store(spark, root).commits, "repo", "hash") == rows(two(c), "repo", "hash")
    store.refresh(spark, root, marks(r="b", _007="a"), build)
    assert len(seen) == 2
    # a repository given up, and the versions that nobody names
    store.refresh(spark, root, marks(r="b"), build)
    assert {r.repo for r in store.read_store(spark, root).commits.collect()} == {"r"}
    assert store.vacuum(spark, root) == [1, 2, 4]
    assert rows(store.read_store(spark, root).commits, "hash") == rows(c, "hash")


def test_fingerprints_of_dumps(spark, dump):
    first = {r.repo: r.fingerprint for r in store.dump_fingerprints(spark, dump).collect()}
    put(dump, "log", "new", f"{RS}x")
    second = {r.repo: r.fingerprint for r in store.dump_fingerprints(spark, dump).collect()}
    assert set(first) == {"007"} and second["007"] == first["007"] and set(second) == {"007", "new"}
    put(dump, "tags", "007", "v9\0h2\n")
    assert {r.repo: r.fingerprint for r in store.dump_fingerprints(spark, dump).collect()}["007"] != first["007"]


def test_wide_log(spark, tmp_path):
    """Messages with blank lines, counts and quoted headers; binary files, renames, empty commits; any splits."""
    ids = {c: c * 40 for c in "abcd"}
    header = lambda c, subject, ups="": (f"{ids[c]}|Ann | Bee|a@x.org|2020-01-02T12:00:00+02:00|Bob|b@x.org|"  # noqa: E731
                                         f"2020-01-03T00:00:00Z|{subject}|{' '.join(ids[u] for u in ups)}|{subject}")
    log = (header("d", "Merge", "cb") + "\n\n"
           + header("c", "Say | it", "b") + f"\n\nBody\n{header('b', 'quoted', 'a')}\n\n3\t4\tlike\n\n{header('a', 'old')}\n\n"
           + "1\t2\ta.py\n-\t-\tb.png\n5\t0\t{x => y}/c.py\n\n"
           + header("b", "No files", "a") + "\n\nlast words\n\n"
           + header("a", "First") + f"\nmore\n{ids['b']}|not a header\n\n7\t0\ta.py\n")
    folder = tmp_path / "repo=r"
    folder.mkdir()
    (folder / "log.txt").write_text(log)
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (most, "100"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            records = wide_log.read_wide_records(spark, str(tmp_path))
            found = {r.hash[0]: r for r in wide_log.commits_from_wide(records).collect()}
            assert set(found) == set("abcd") and found["c"].subject == "Say | it" and found["c"].author_name == "Ann | Bee"
            assert found["c"].message.startswith("Say | it\n\nBody\naaa".replace("aaa", ids["b"])) and "3\t4\tlike" in found["c"].message
            assert found["c"].message.endswith("|old||old") and found["b"].message == "No files\n\nlast words"
            assert found["a"].message == f"First\nmore\n{ids['b']}|not a header"
            assert [(found[c].files_changed, found[c].insertions, found[c].deletions) for c in "abcd"] == [
                (1, 7, 0), (0, 0, 0), (3, 6, 2), (0, 0, 0)]
            assert found["d"].is_merge and found["d"].parents == [ids["c"], ids["b"]] and not found["c"].is_merge
            assert found["a"].committer_name == "Bob" and str(found["a"].author_date - found["a"].date) == "-1 day, 10:00:00"
            assert rows(wide_log.changes_from_wide(records), "filepath", "insertions", "is_binary_change") == [
                ("a.py", 1, False), ("a.py", 7, False), ("b.png", 0, True), ("y/c.py", 5, False)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
