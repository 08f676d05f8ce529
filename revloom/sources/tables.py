"""Table store and the bundle of tables that analyses read."""

import logging
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from revloom.operators import ancestry, commits as commit_ops, contributors, files, lifetimes
from revloom.operators.clean import to_schema
from revloom.operators.persistence import persistence_metrics
from revloom.plans.runtime import remove_path, settle
from revloom.plans.skew import measured
from revloom.schema import COMMITS, FILE_CHANGES, FILE_PRESENCE
from revloom.sources import dumps

log = logging.getLogger(__name__)

# table -> its schema; the last ones may be absent
REQUIRED = {"commits": COMMITS, "file_changes": FILE_CHANGES}
OPTIONAL = {"file_presence": FILE_PRESENCE, "branches": None, "tags": None}


@dataclass(frozen=True)
class History:
    """Lazy tables of many repositories; parts that nobody reads are never computed."""

    commits: DataFrame | None = None
    file_changes: DataFrame | None = None
    file_presence: DataFrame | None = None
    branches: DataFrame | None = None
    tags: DataFrame | None = None
    contributors: DataFrame | None = None
    language_statistics: DataFrame | None = None
    commit_patterns: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)
                if getattr(self, f.name) is not None}

    def has(self, names) -> bool:
        """All of the named tables are there."""
        return set(names) <= set(self.tables())

    def register_views(self, prefix: str = "") -> None:
        """SQL access: one temporary view per table."""
        for name, table in self.tables().items():
            table.createOrReplaceTempView(prefix + name)


def limit_history(history: History, newest: int | None) -> History:
    """The newest commits of every repository and their changes and files."""
    if newest is None:
        return history
    kept = commit_ops.newest(history.commits, newest)
    # changes and listings are large: not shuffled where the kept commits can be broadcast
    keys, _ = measured(kept.select("repo", F.col("hash").alias("commit_hash")))
    cut = {name: getattr(history, name).join(keys, ["repo", "commit_hash"], "left_semi")
           for name in ("file_changes", "file_presence") if getattr(history, name) is not None}
    return History(commits=kept, **cut, branches=history.branches, tags=history.tags)


def branch_history(history: History, wanted: str | None = None, first_parent: bool = False) -> History:
    """The commits and changes that the chosen branch of each repository reaches (``wanted``, else the first of
    the usual names, else the current one); with ``first_parent`` along first parents only."""
    choice = ancestry.choose_branch(history.branches, wanted)
    heads = history.branches.withColumnRenamed("branch_name", "branch").join(choice, ["repo", "branch"]).select(
        "repo", F.col("last_commit_hash").alias("hash")).distinct()
    edges = ancestry.parent_edges(history.commits)
    if first_parent:
        edges = edges.filter(F.col("place") == 0)
    # one head per repository: one row per commit
    inside = settle(ancestry.reachable(edges, heads).select("repo", "hash").distinct())
    keys = inside.withColumnRenamed("hash", "commit_hash")
    cut = {name: getattr(history, name).join(keys, ["repo", "commit_hash"], "left_semi")
           for name in ("file_changes", "file_presence") if getattr(history, name) is not None}
    return History(**{**history.tables(), **cut,
                      "commits": history.commits.join(inside, ["repo", "hash"], "left_semi")})


def read_history(spark: SparkSession, root: str, *, tree: bool = False, refs: bool = False,
                 tags: bool = False) -> History:
    """Base tables from dumps; optional kinds only where asked for."""
    records = dumps.read_log(spark, root)
    changes = dumps.with_line_counts(dumps.changes_from_log(records),
                                     dumps.read_numstat(spark, root))
    return History(
        commits=dumps.commits_from_log(records), file_changes=changes,
        file_presence=dumps.presence_from_tree(dumps.read_tree(spark, root)) if tree else None,
        branches=dumps.read_refs(spark, root) if refs else None,
        tags=dumps.read_tags(spark, root) if tags else None)


def build_history(base: History, *, newest: int | None = None, patterns: bool = True,
                  with_contributors: bool = True, metrics: bool = True) -> History:
    """The extraction: commits with line totals (and persistence metrics), changes with path facts,
    branches, contributors, languages and patterns."""
    base = limit_history(base, newest)
    # settled: patterns, bounds of the metrics and the result all read it
    wide = settle(commit_ops.export_commits(base.commits, base.file_changes))
    if base.file_presence is not None:
        heads = lifetimes.listed_head_files(base.file_presence, base.commits)
    else:
        sequence = lifetimes.commit_sequence(base.commits)
        heads = lifetimes.head_files(lifetimes.file_lifetimes(base.file_changes, sequence))
    branches = base.branches
    if branches is not None and "parents" in base.commits.columns:
        default = (dumps.default_branches(branches) if "symref" in branches.columns
                   else ancestry.choose_branch(branches))
        branches = ancestry.branch_facts(branches, ancestry.parent_edges(base.commits), default)
    return History(
        commits=persistence_metrics(wide) if metrics else wide,
        file_changes=base.file_changes, file_presence=base.file_presence, branches=branches,
        tags=base.tags,
        contributors=(contributors.contributor_export(base.commits, base.file_changes)
                      if with_contributors else None),
        language_statistics=files.language_statistics(heads),
        commit_patterns=commit_ops.commit_patterns(wide) if patterns else None)


def write_tables(history: History, root: str) -> None:
    """Parquet by repository. Rows are range partitioned first: a large repository is written by
    several tasks, small ones share a task, and files stay sorted by commit for pruning. An optional
    table that the history lacks is removed from the store."""
    keys = {"commits": "hash", "branches": "full_name", "tags": "tag_name"}
    for name in (*REQUIRED, *OPTIONAL):
        table = getattr(history, name)
        if table is None:
            remove_path(next(iter(history.tables().values())).sparkSession, f"{root}/{name}")
        else:
            key = keys.get(name, "commit_hash")
            (table.repartitionByRange("repo", key).sortWithinPartitions("repo", key)
             .write.mode("overwrite").partitionBy("repo").parquet(f"{root}/{name}"))


def read_tables(spark: SparkSession, root: str) -> History | None:
    """The stored tables, None unless commits and changes are there and readable; listing, branches and
    tags come where they were stored."""
    found = {}
    for name, schema in (REQUIRED | OPTIONAL).items():
        try:
            stored = spark.read.parquet(f"{root}/{name}").schema
        except AnalysisException as error:
            if name in OPTIONAL:
                continue
            log.warning("no stored table %s: %s", name, error)
            return None
        # repository names stay text even when they look like numbers
        typed = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "repo" else f
                              for f in stored.fields])
        # optional columns (parents, old_path) that were not stored stay away
        known = typed if schema is None else T.StructType(
            [f for f in schema.fields if f.name in typed.fieldNames()])
        found[name] = to_schema(spark.read.schema(typed).parquet(f"{root}/{name}"), known)
    return History(**found)


def stored_or_built(spark: SparkSession, root: str, build, use_store: bool = True) -> History:
    """Stored tables if complete, else build, write and read them back."""
    history = read_tables(spark, root) if use_store else None
    if history is None:
        write_tables(build(), root)
        history = read_tables(spark, root)
    return history
