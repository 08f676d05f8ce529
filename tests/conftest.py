import os
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
               .config("spark.log.level", "ERROR").getOrCreate())
    yield session
    session.stop()


def utc(year, month=1, day=1, hour=12, minute=0, second=0):
    return datetime(year, month, day, hour, minute, second, tzinfo=timezone.utc)


class Tables:
    """Small hand-made tables."""

    def __init__(self, spark):
        self.spark = spark

    def commits(self, rows):
        """rows: (hash, author, date[, message[, parents]])"""
        full = []
        for name, author, date, *rest in rows:
            message, parents = list(rest) + ["", []][len(rest):]
            full.append(("r", name, author, f"{author.lower()}@x.org", date, message, parents))
        return self.spark.createDataFrame(
            full, "repo string, hash string, author_name string, author_email string, "
                  "date timestamp, message string, parents array<string>")

    def changes(self, rows):
        """rows: (commit, path[, type[, insertions, deletions[, old path]]])"""
        full = []
        for commit, path, *rest in rows:
            kind, ins, dels, old = (list(rest) + ["M", 0, 0, None][len(rest):])
            full.append(("r", commit, path, kind, ins, dels, ins + dels, old))
        return self.spark.createDataFrame(
            full, "repo string, commit_hash string, filepath string, change_type string, "
                  "insertions long, deletions long, total_churn long, old_path string")


@pytest.fixture(scope="session")
def make(spark):
    return Tables(spark)


@pytest.fixture(scope="session")
def simple(make):
    """Eleven commits of one author: three files added, ten edits of main.py, one more file."""
    commits = [("c01", "Alice", utc(2020, 1, 1), "Initial")]
    changes = [("c01", p, "A", 1, 0) for p in ("README.md", "main.py", "utils.py")]
    for i in range(2, 11):
        commits.append((f"c{i:02}", "Alice", utc(2020, 1, i), f"Update {i}", [f"c{i - 1:02}"]))
        changes.append((f"c{i:02}", "main.py", "M", 1, 1))
    commits.append(("c11", "Alice", utc(2020, 1, 11), "Add docs", ["c10"]))
    changes.append(("c11", "docs/guide.md", "A", 1, 0))
    return make.commits(commits), make.changes(changes)


@pytest.fixture(scope="session")
def complex_history(make):
    """Three authors, a branch and a merge."""
    commits = make.commits([
        ("a1", "Alice", utc(2021, 1, 1), "start"), ("b1", "Bob", utc(2021, 1, 5), "feature", ["a1"]),
        ("a2", "Alice", utc(2021, 1, 8), "core", ["a1"]),
        ("m1", "Alice", utc(2021, 1, 20), "merge", ["a2", "b1"]),
        *[(f"d{i}", who, utc(2021, 2, i), "edit", ["m1" if i == 1 else f"d{i - 1}"])
          for i, who in enumerate(("Alice", "Bob", "Charlie", "Alice", "Bob"), 1)]])
    changes = make.changes([("a1", "main.py", "A"), ("b1", "feature_x.py", "A"), ("a2", "core.py", "A"),
                            *[(f"d{i}", "core.py", "M") for i in range(1, 6)]])
    return commits, changes


@pytest.fixture(scope="session")
def refactor(make):
    commits = make.commits([("c1", "Alice", utc(2022, 1, 1), "add"),
                            ("c2", "Alice", utc(2022, 1, 21), "move\nall of it", ["c1"])])
    changes = make.changes([
        ("c1", "old_module/file1.py", "A"), ("c1", "old_module/file2.py", "A"),
        ("c2", "new_core/file1.py", "R", 0, 0, "old_module/file1.py"),
        ("c2", "new_core/file2.py", "R", 0, 0, "old_module/file2.py")])
    return commits, changes


def rows(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()],
                  key=lambda r: tuple((x is None, str(x)) for x in r))


def days_ago(n, now=utc(2024)):
    return now - timedelta(days=n)
