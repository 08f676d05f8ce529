"""Readers of history dumps written by plain git on the user's side.

Layout: ``<root>/<kind>/repo=<name>/<files>`` with kind log, numstat, tree, refs or tags. In log,
numstat and tree every record starts with the byte 0x1E and its fields end with 0x1F, then path lines
follow. No message or name can break the records, and large dumps split at them.

    log      git log --all --reverse -m -M -C --name-status --pretty=format:%x1e%H%x1f%an%x1f%ae%x1f%ct%x1f%P%x1f%B%x1f
    numstat  git log --all -m -M -C --numstat --pretty=format:%x1e%H%x1f
    tree     per commit: printf '\\x1e%s\\x1f\\n' $commit; git ls-tree -r --long $commit
    refs     git for-each-ref refs/heads refs/remotes --format=
             %(refname:short)%00%(objectname)%00%(committerdate:iso)%00%(authorname)%00
             %(upstream:short)%00%(HEAD)%00%(symref:short)
    tags     git tag -l --format=%(refname:short)%00%(objectname)%00%(taggerdate:iso)%00
             %(taggername)%00%(subject)

With ``-m`` a merge is listed once per parent, in the order of its parents, but for parents from which it does not
differ. ``numbered=True`` counts the records of a commit; where there are as many as parents (one for other commits),
the count is the ``parent_place``, else it is null: a merge that equals one of its parents does not say which. Changes
of place 0 are those of a log with ``--first-parent -m`` (:func:`first_parent_changes`).

``read_pipe_log`` reads the older layout with ``|`` between header fields, line by line.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from revloom.functions import text
from revloom.plans.runtime import settle

RECORD, FIELD = "\x1e", "\x1f"


def _records(spark: SparkSession, root: str, kind: str, separator: str = RECORD,
             placed: bool = False) -> DataFrame:
    """Records of a kind of dump; with ``placed`` also ``_at``, which orders them as they were written."""
    rows = (spark.read.schema("value string, repo string").option("lineSep", separator)
            .text(f"{root}/{kind}"))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("record"))
    return rows.select("*", *([place.alias("_at")] if placed else [])).filter(F.trim("value") != "")


def _record_no(key: str) -> Column:
    """Number of a record among those of its commit, from 0: a group has a row per parent."""
    return F.row_number().over(W.partitionBy("repo", key).orderBy("_at")) - 1


def _readable_date(p) -> Column:
    return F.timestamp_seconds(p[3].try_cast("long"))


def rejected_records(spark: SparkSession, root: str) -> DataFrame:
    """(repo, rejected): log records that :func:`read_log` skips, with fields or a time that cannot be read."""
    rows = _records(spark, root, "log").select("repo", F.split("value", FIELD, 7).alias("p"))
    bad = (F.size("p") != 7) | _readable_date(F.col("p")).isNull()
    return rows.filter(bad).groupBy("repo").agg(F.count(F.lit(1)).alias("rejected"))


def read_log(spark: SparkSession, root: str, numbered: bool = False) -> DataFrame:
    """One row per log record: header fields and the block of path lines. Malformed records are skipped;
    :func:`rejected_records` counts them.

    ``numbered`` adds ``record_no`` and ``parent_place``. Only records of merges are shuffled for that, by commit; the
    dump is read once for them and once for all others.
    """
    if not numbered:
        return _log_records(spark, root)
    single = _log_records(spark, root, True).filter(F.size("parents") < 2).withColumns(
        {"record_no": F.lit(0), "parent_place": F.lit(0)})
    merges = _log_records(spark, root, True).filter(F.size("parents") > 1).withColumn("record_no", _record_no("hash"))
    records = F.count(F.lit(1)).over(W.partitionBy("repo", "hash"))
    whole = merges.withColumn("parent_place", F.when(records == F.size("parents"), F.col("record_no")))
    return single.unionByName(whole).drop("_at")


def _log_records(spark: SparkSession, root: str, placed: bool = False) -> DataFrame:
    parts = F.split("value", FIELD, 7)
    at = ["_at"] if placed else []
    rows = _records(spark, root, "log", placed=placed).select("repo", *at, parts.alias("p")).filter(
        F.when(F.size("p") == 7, _readable_date(F.col("p")).isNotNull()).otherwise(False))
    return rows.select(
        *at,
        "repo", F.trim(F.col("p")[0]).alias("hash"), F.col("p")[1].alias("author_name"),
        F.col("p")[2].alias("author_email"),
        _readable_date(F.col("p")).alias("date"),
        F.filter(F.split(F.col("p")[4], " "), lambda x: x != "").alias("parents"),
        F.regexp_replace(F.col("p")[5], r"\s+$", "").alias("message"), F.col("p")[6].alias("body"))


def commits_from_log(log: DataFrame) -> DataFrame:
    """Commits, each hash once per repository."""
    return log.drop("body", "record_no", "parent_place").dropDuplicates(["repo", "hash"])


def _lines(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("*", F.posexplode(F.split(column, "\n")).alias("line_no", "line")).drop(column)


def changes_from_log(log: DataFrame) -> DataFrame:
    """One row per changed path; renames and copies give the new path and keep the old one.

    A commit that is listed once per parent keeps its repeated rows; those of a numbered log say which they are.
    """
    numbers = [c for c in ("record_no", "parent_place") if c in log.columns]
    lines = _lines(log.select("repo", F.col("hash").alias("commit_hash"), *numbers, "body"), "body")
    parts = F.split("line", "\t")
    rows = lines.filter(F.contains("line", F.lit("\t"))).select(
        "repo", "commit_hash", *numbers, text.change_kind(parts[0]).alias("change_type"),
        parts[1].alias("_first"), F.get(parts, F.lit(2)).alias("_second"))
    return rows.filter(F.col("change_type").isNotNull()).select(
        "repo", "commit_hash", *numbers, F.coalesce("_second", "_first").alias("filepath"), "change_type",
        F.when(F.col("_second").isNotNull(), F.col("_first")).alias("old_path"))


def first_parent_changes(changes: DataFrame) -> DataFrame:
    """Changes against the first parent, each once: what a merge brought to the branch it was made on."""
    return changes.filter(F.col("parent_place") == 0).drop("record_no", "parent_place")


def read_numstat(spark: SparkSession, root: str, numbered: bool = False) -> DataFrame:
    """(repo, commit_hash[, record_no], line_no, filepath, insertions, deletions, is_binary_change)."""
    parts = F.split("value", FIELD, 2)
    rows = _records(spark, root, "numstat", placed=numbered).select(
        "repo", F.trim(parts[0]).alias("commit_hash"), parts[1].alias("body"), *(["_at"] if numbered else []))
    numbers = ["record_no"] if numbered else []
    if numbered:
        rows = rows.withColumn("record_no", _record_no("commit_hash")).drop("_at")
    cells = F.split("line", "\t")
    return (_lines(rows, "body").filter(F.size(cells) >= 3)
            .select("repo", "commit_hash", *numbers, "line_no",
                    text.rename_target(cells[2]).alias("filepath"),
                    text.line_count(cells[0]).alias("insertions"),
                    text.line_count(cells[1]).alias("deletions"),
                    (cells[0] == "-").alias("is_binary_change")))


def with_line_counts(changes: DataFrame, numstat: DataFrame) -> DataFrame:
    """Join numstat to change rows; the last numstat row of a (commit, path) wins, missing is 0. Where both are
    numbered, a record of a merge gets the counts of the same record only."""
    record = ["record_no"] if "record_no" in changes.columns and "record_no" in numstat.columns else []
    key = ["repo", "commit_hash", *record, "filepath"]
    # a hash in front: rows are sorted for both steps, and the texts of a repository begin alike; a short one, as it is shuffled
    code = F.hash(*[F.col(c).cast("string") for c in key])
    last = numstat.withColumn("_code", code).groupBy("_code", *key).agg(
        F.max_by(F.struct("insertions", "deletions"), "line_no").alias("_s"))
    joined = changes.withColumn("_code", code).join(last, ["_code", *key], "left").drop("_code")
    return joined.withColumns({
        "insertions": F.coalesce("_s.insertions", F.lit(0).cast("long")),
        "deletions": F.coalesce("_s.deletions", F.lit(0).cast("long"))}).withColumn(
        "total_churn", F.col("insertions") + F.col("deletions")).drop("_s")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Tree listings: blobs only, with mode, object id and size ('-' is 0). Name-only lines have none of these."""
    parts = F.split("value", FIELD, 2)
    rows = _records(spark, root, "tree").select(
        "repo", F.trim(parts[0]).alias("commit_hash"), parts[1].alias("body"))
    # fields are split once for the filter and once for the columns, on single characters: a listing is the largest dump
    cells = _lines(rows, "body").filter(F.trim("line") != "").select(
        "repo", "commit_hash", F.split("line", "\t", 2).alias("_cells"))
    told = cells.select("repo", "commit_hash", "_cells", F.filter(
        F.split(F.trim(F.col("_cells")[0]), " "), lambda x: x != "").alias("_meta"))
    long_form = F.size("_cells") == 2
    return told.filter(~long_form | (F.size("_meta") >= 4) & (F.get("_meta", F.lit(1)) == "blob")).select(
        "repo", "commit_hash", F.element_at("_cells", -1).alias("filepath"),
        F.when(long_form, F.get("_meta", F.lit(0))).alias("mode"), F.when(long_form, F.get("_meta", F.lit(2))).alias("blob"),
        F.when(long_form, text.line_count(F.get("_meta", F.lit(3)))).alias("size"))


def presence_from_tree(tree: DataFrame) -> DataFrame:
    return tree.select("repo", "commit_hash", "filepath")


def _cells(spark: SparkSession, root: str, kind: str, least: int) -> DataFrame:
    rows = _records(spark, root, kind, "\n").select(
        "repo", F.split("value", "\u0000").alias("c"))
    return rows.filter(F.size("c") >= least)


def _cell(i: int):
    return F.coalesce(F.get("c", F.lit(i)), F.lit(""))


def read_refs(spark: SparkSession, root: str) -> DataFrame:
    """Local and remote branches; remote names lose ``origin/``."""
    rows = _cells(spark, root, "refs", 4)
    remote = F.startswith(_cell(0), F.lit("origin/"))
    return rows.select(
        "repo", F.regexp_replace(_cell(0), "^origin/", "").alias("branch_name"),
        _cell(0).alias("full_name"), ((F.trim(_cell(5)) == "*") & ~remote).alias("is_current"),
        remote.alias("is_remote"), _cell(1).alias("last_commit_hash"),
        _cell(2).alias("last_commit_date"), _cell(3).alias("last_commit_author"),
        _cell(4).alias("upstream"), _cell(6).alias("symref"))


def default_branches(refs: DataFrame) -> DataFrame:
    """(repo, branch) that ``origin/HEAD`` points to, ``main`` where there is none."""
    target = F.when(F.col("full_name").isin("origin", "origin/HEAD") & (F.col("symref") != ""),
                    F.regexp_replace("symref", "^.*/", ""))
    return refs.groupBy("repo").agg(F.coalesce(F.max(target), F.lit("main")).alias("branch"))


def read_tags(spark: SparkSession, root: str) -> DataFrame:
    """Tags; short rows are padded with '', annotated tags are those with a date."""
    return _cells(spark, root, "tags", 2).select(
        "repo", _cell(0).alias("tag_name"), _cell(1).alias("commit_hash"),
        _cell(2).alias("tagger_date"), _cell(3).alias("tagger_name"), _cell(4).alias("subject"),
        (_cell(2) != "").alias("is_annotated"))


def read_pipe_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(commits, changes) of logs with ``hash|name|email|seconds|subject`` header lines.

    ``path`` holds ``repo=<name>`` folders. Path lines belong to the header above them, so order
    counts: inside a file split it is the order of the lines, between splits it is the offset of the
    split. Each split fills its headers down alone and takes the last header of the splits before it.
    Lines without a tab that hold ``|`` are headers; further ``|`` stay in the subject.
    """
    lines = spark.read.schema("value string, repo string").text(path).select(
        "repo", "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"))
    is_header = F.contains("value", F.lit("|")) & ~F.contains("value", F.lit("\t"))
    # settled: line numbers must not change between the two reads below
    marked = settle(lines.filter(F.trim("value") != "").withColumn(
        "_header", F.when(is_header, F.col("value"))))
    per_split = marked.groupBy("_file", "_block").agg(F.max_by(
        "_header", F.when(F.col("_header").isNotNull(), F.col("_line"))).alias("_last"))
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = per_split.select("_file", "_block",
                               F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    inside = (W.partitionBy("_file", "_block").orderBy("_line")
              .rowsBetween(W.unboundedPreceding, 0))
    filled = marked.join(carried, ["_file", "_block"]).withColumn(
        "_head", F.coalesce(F.last("_header", ignorenulls=True).over(inside), F.col("_carry")))
    h = F.split("_head", r"\|", 5)
    commits = (filled.filter(F.col("_header").isNotNull() & (F.size(h) == 5))
               .select("repo", h[0].alias("hash"), h[1].alias("author_name"),
                       h[2].alias("author_email"),
                       F.timestamp_seconds(h[3].try_cast("long")).alias("date"),
                       h[4].alias("message"))
               .filter(F.col("date").isNotNull()).dropDuplicates(["repo", "hash"]))
    cells = F.split("value", "\t")
    kind = text.change_kind(cells[0])
    rows = filled.filter(F.col("_header").isNull() & F.contains("value", F.lit("\t"))
                         & (F.size(h) == 5) & kind.isNotNull())
    second = F.get(cells, F.lit(2))
    changes = rows.select(
        "repo", h[0].alias("commit_hash"), F.coalesce(second, cells[1]).alias("filepath"),
        kind.alias("change_type"), F.when(second.isNotNull(), cells[1]).alias("old_path"))
    return commits, changes
