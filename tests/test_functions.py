from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from revloom.functions import paths, scalars, text
from revloom.operators import clean, commits, files
from tests.conftest import days_ago, rows, utc


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn("v").alias("x")).collect()]


def test_suffixes(spark):
    names = [".gitignore", "a.tar.gz", "x.", "..a", ".a.b", "v1.2/x", "a..b", "a.b.", "A.PY"]
    assert column(spark, names, paths.path_suffix) == ["", ".gz", "", "", ".b", "", ".b", "", ".py"]
    assert column(spark, names, paths.path_suffixes) == [
        "no_ext", ".tar.gz", "no_ext", "no_ext", ".b", "no_ext", "..b", "no_ext", ".py"]


def test_directories(spark):
    names = ["README.md", "src/a.py", "src/core/x/a.py"]
    assert column(spark, names, paths.path_dir) == ["root", "src", "src/core/x"]
    assert column(spark, names, paths.path_depth) == [1, 2, 4]
    assert column(spark, names, paths.directory_depth) == [0, 1, 3]
    assert column(spark, names, paths.top_level_dir) == ["README.md", "src", "src"]
    assert column(spark, names, paths.ancestor_dirs) == [[], ["src"], ["src", "src/core", "src/core/x"]]


def test_file_kinds(spark):
    cases = {"tests/test_core.py": True, "src/app/test_main.py": True, "src/app/main_test.py": True,
             "docs/test.md": True, "test_root.py": True, "src/app/main.py": False, "test.py": False,
             "docs/TOC.md": False}
    assert column(spark, list(cases), paths.is_test_file) == list(cases.values())
    configs = {"a.json": True, "app/settings.py": True, "Dockerfile": True, "x/Makefile.am": True,
               "main.py": False, "config/main.py": False}
    assert column(spark, list(configs), paths.is_config_file) == list(configs.values())
    docs = {"a.md": True, "docs/x.py": True, "a/doc/b.c": True, "docsx/a.py": False}
    assert column(spark, list(docs), paths.is_documentation) == list(docs.values())


def test_languages(spark):
    cases = {"a.py": "Python", "x/Dockerfile.prod": "Dockerfile", "GNUmakefile": "Makefile",
             "a.f90": "Fortran", "noext": "Other", "b.H": "C/C++"}
    assert column(spark, list(cases), paths.language_of) == list(cases.values())
    assert column(spark, ["a.PNG", "a.json", "a.rs", "b.tar.gz"], paths.is_binary_path) == [
        True, False, False, True]


def test_topics(spark):
    cases = {"package.json": "Package Management", "src/a.ts": "Core Logic",
             "tests/a.ts": "Other", "a.yml": "Configuration", "test/a.jsx": "UI/Frontend",
             "CHANGELOG": "Documentation", "x.c": "Other"}
    assert column(spark, list(cases), paths.hotspot_topic) == list(cases.values())


def test_group_by_directory(spark):
    def grouped(names, depth):
        df = spark.createDataFrame([("r", n) for n in names], "repo string, filepath string")
        return dict(rows(files.group_by_directory(df, depth), "filepath", "directory"))
    assert grouped(["src/a.py", "src/b.py", "docs/c.md", "README.md"], 1) == {
        "src/a.py": "src", "src/b.py": "src", "docs/c.md": "docs", "README.md": "."}
    assert grouped(["src/core/a.py", "src/utils/b.py", "README.md"], 2) == {
        "src/core/a.py": "src/core", "src/utils/b.py": "src/utils", "README.md": "."}


def test_suffix_filter(spark):
    df = spark.createDataFrame([("a.py",), ("b.js",), ("c.py",), ("D.PY",)], "filepath string")
    assert rows(clean.with_suffix(df, [".py"]), "filepath") == [("a.py",), ("c.py",)]
    assert clean.with_suffix(df, [".md"]).count() == 0
    assert clean.with_suffix(df, []).count() == 0


def test_age_days(spark):
    now = utc(2024)
    df = spark.createDataFrame([(days_ago(10), now), (days_ago(365), days_ago(360)), (now, now)],
                               "a timestamp, b timestamp")
    assert [r[0] for r in df.select(scalars.age_days("a", "b")).collect()] == [10, 5, 0]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.datetimes(min_value=utc(1990).replace(tzinfo=None),
                                       max_value=utc(2030).replace(tzinfo=None)),
                          st.integers(0, 10 ** 9)), min_size=1, max_size=20))
def test_age_is_whole_elapsed_days(spark, pairs):
    data = [(a, seconds) for a, seconds in pairs]
    df = spark.createDataFrame(data, "a timestamp, s long").withColumn(
        "b", F.col("a") + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)")))
    found = [r[0] for r in df.select(scalars.age_days("a", "b")).collect()]
    assert found == [seconds // 86400 for _, seconds in pairs]


def test_human_size(spark):
    sizes = [0, 512, 1023, 1024, 1280, 1536, 10 ** 6, 5 * 1024 ** 3, 3 * 1024 ** 4, 2 * 1024 ** 5]
    assert column(spark, sizes, scalars.human_size, "long") == [
        "0.0B", "512.0B", "1023.0B", "1.0KB", "1.2KB", "1.5KB", "976.6KB", "5.0GB", "3.0TB", "2048.0TB"]


def test_content_preview(spark):
    long_line = "x" * 600
    texts = ["", None, "a\0b", "one", "1\n2\n3\n4\n5", "1\n2\n3\n4\n5\n6\n7", long_line]
    assert column(spark, texts, scalars.content_preview) == [
        None, None, "<binary file, 3 bytes>", "one", "1\n2\n3\n4\n5",
        "1\n2\n3\n4\n5\n... (2 more lines)", "x" * 500 + "..."]


def test_rename_target(spark):
    cases = {"a/{x => y}/b": "a/y/b", "x => y": "y", "a/{s => }/b": "a/b", "plain/p": "plain/p",
             "{a => b}/c.py": "b/c.py"}
    assert column(spark, list(cases), text.rename_target) == list(cases.values())
    assert column(spark, ["R100", "M", "T", "C75", ""], text.change_kind) == ["R", "M", None, "C", None]
    assert column(spark, ["12", "-", ""], text.line_count) == [12, 0, 0]


MESSAGES = [("h1", "Fix: handle null"), ("h2", "feat: new login"), ("h3", "Update docs"),
            ("h4", "Apply PATCH for fixture"), ("h5", "Introduce feature flags"),
            ("h6", "resolve bug, Fix bug"), ("h7", "prefix suffix addendum")]


def test_keyword_commits(spark):
    df = spark.createDataFrame(MESSAGES, "hash string, message string")
    assert rows(commits.bug_fix_commits(df), "hash", "keywords_matched") == [
        ("h1", ["fix"]), ("h4", ["patch"]), ("h6", ["bug", "fix", "resolve"])]
    assert rows(commits.feature_commits(df), "hash", "keywords_matched") == [
        ("h2", ["feat"]), ("h5", ["feature", "introduce"])]


def test_keyword_commits_on_a_stream(spark, tmp_path):
    """A narrow transform runs on an append stream as it is."""
    df = spark.createDataFrame(MESSAGES, "hash string, message string")
    df.write.parquet(str(tmp_path / "in"))
    stream = commits.bug_fix_commits(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    job = (stream.writeStream.format("memory").queryName("fixes")
           .option("checkpointLocation", str(tmp_path / "state")).start())
    job.processAllAvailable()
    job.stop()
    assert {r.hash for r in spark.table("fixes").collect()} == {"h1", "h4", "h6"}


def test_date_filters(spark):
    df = spark.createDataFrame([(i, utc(2020, 1, i)) for i in range(1, 6)], "i int, date timestamp")
    assert clean.filter_dates(df, "2020-01-02,2020-01-04T12:00:00").count() == 3
    assert clean.filter_dates(df, "nonsense").count() == 5
    assert clean.filter_dates(df.drop("date"), "2020-01-02,2020-01-03").count() == 5
    assert clean.recent(df, "2020-01-05 12:00:00", 2).count() == 3


def test_conform_and_flatten(spark):
    df = spark.createDataFrame([("x", 3, (1, 2.0))], "name string, total_commits long, "
                                                    "m struct<a:int,b:double>")
    fixed = clean.conform(df, clean.CONTRIBUTOR_ALIASES)
    assert fixed.columns == ["author_name", "commit_count", "m"]
    assert clean.find_count_column(fixed) == "commit_count"
    assert clean.find_count_column(df) is None
    assert clean.flatten(df).columns == ["name", "total_commits", "m_a", "m_b"]


def test_to_schema(spark):
    from revloom.schema import FILE_PRESENCE
    df = spark.createDataFrame([(7, "h", 1.5)], "repo int, commit_hash string, extra double")
    fixed = clean.to_schema(df, FILE_PRESENCE)
    assert tuple(fixed.first()) == ("7", "h", None, 1.5)
    assert fixed.columns == ["repo", "commit_hash", "filepath", "extra"]


def test_exclude_keeps_missing_paths(spark):
    df = spark.createDataFrame([("a.png",), ("b.py",), (None,)], "filepath string")
    assert rows(clean.exclude_paths(df, [r"\.png$"]), "filepath") == [("b.py",), (None,)]
