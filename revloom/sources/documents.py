"""JSON export documents: one object with all tables of a repository, or of a part of it."""

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from revloom.functions import paths, text
from revloom.operators import files
from revloom.operators.clean import flatten, parse_dates
from revloom.plans.skew import measured
from revloom.schema import EXPORT_DOCUMENT
from revloom.sources.tables import History

log = logging.getLogger(__name__)

SECTIONS = ("commits", "file_changes", "branches", "contributors", "tags", "language_statistics")


def read_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """One row per document with a ``repo`` column (its repository_info.repo_name, else its file)."""
    raw = spark.read.schema(EXPORT_DOCUMENT).option("multiLine", not one_per_line).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return raw.withColumn("repo", F.coalesce("repository_info.repo_name", stem))


def section(documents: DataFrame, name: str) -> DataFrame:
    """One table of the documents; a missing or empty key gives no rows."""
    rows = documents.select("repo", F.explode(name).alias("_r")).select("repo", "_r.*")
    return rows


def missing_sections(documents: DataFrame) -> DataFrame:
    """(repo, section) of required keys that are missing or empty, for a warning."""
    required = ("commits", "file_changes", "contributors")
    empty = F.array(*[F.when(F.coalesce(F.size(F.col(n)), F.lit(0)) <= 0, F.lit(n))
                      for n in required],
                    F.when(F.col("repository_info").isNull(), F.lit("repository_info")))
    return documents.select("repo", F.explode(F.filter(empty, lambda x: x.isNotNull()))
                            .alias("section"))


def history_from_documents(documents: DataFrame) -> History:
    """Typed tables: dates parsed to UTC, nested metrics flattened, canonical names."""
    commits = parse_dates(flatten(section(documents, "commits")), ["commit_date", "author_date"],
                          required="commit_date")
    commits = commits.withColumns({
        "date": F.col("commit_date"), "message": F.col("subject"),
        "parents": F.filter(F.split("parent_hashes", " "), lambda x: x != "")})
    commits = commits.withColumnsRenamed(
        {c: c.removeprefix("architectural_metrics_") for c in commits.columns})
    changes = parse_dates(section(documents, "file_changes"), ["commit_date"],
                          required="commit_date")
    # R100 and the like lose their score
    changes = changes.withColumn("change_type", F.coalesce(
        text.change_kind("change_type"), F.col("change_type")))
    changes = changes.withColumnsRenamed({"file_path": "filepath", "commit_date": "date",
                                          "old_file_path": "old_path"}).filter(
        F.col("filepath").isNotNull() & (F.col("filepath") != ""))
    return History(commits=commits, file_changes=changes,
                   branches=section(documents, "branches"), tags=section(documents, "tags"),
                   contributors=section(documents, "contributors"),
                   language_statistics=section(documents, "language_statistics"))


def export_form(history: History) -> dict[str, DataFrame]:
    """Commits, changes and contributors under the names of the document (``repo`` stays)."""
    iso = "yyyy-MM-dd'T'HH:mm:ssXXX"
    c = history.commits
    kept = [x for x in ("is_merge", "message_length", "files_changed", "insertions", "deletions",
                        "lines_changed", "architectural_metrics") if x in c.columns]
    stamp = F.date_format("date", iso)
    commits = c.select(
        "repo", "hash", "author_name", "author_email", stamp.alias("author_date"),
        stamp.alias("commit_date"), F.substring_index("message", "\n", 1).alias("subject"),
        F.col("message").alias("full_message"),
        (F.array_join("parents", " ") if "parents" in c.columns else F.lit("")).alias("parent_hashes"),
        *kept)
    changes = history.file_changes
    dated = changes if "date" in changes.columns else files.date_changes(changes, c)
    path = F.col("filepath")
    old = F.col("old_path") if "old_path" in changes.columns else F.lit("")
    out = {"commits": commits, "file_changes": dated.select(
        "repo", "commit_hash", F.date_format("date", iso).alias("commit_date"), "change_type",
        path.alias("file_path"), F.coalesce(old, F.lit("")).alias("old_file_path"),
        paths.path_suffix(path).alias("file_extension"), paths.language_of(path).alias("language"),
        paths.is_binary_path(path).alias("is_binary"),
        paths.directory_depth(path).alias("directory_depth"))}
    if history.contributors is not None:
        out["contributors"] = history.contributors.withColumns({
            x: F.date_format(x, iso) for x in ("first_commit_date", "last_commit_date")})
    return out


def to_documents(tables: dict[str, DataFrame], rows_per_document: int = 10_000) -> DataFrame:
    """(repo, part, document): JSON documents of at most about ``rows_per_document`` rows each.

    A repository of any size is cut into as many parts as its largest table needs, so no document has
    to hold an unbounded group.
    """
    pieces = None
    for name, table in tables.items():
        sizes = table.groupBy("repo").agg(F.greatest(F.lit(1), F.ceil(
            F.count(F.lit(1)) / F.lit(rows_per_document))).cast("int").alias("_parts"))
        body = F.struct(*[F.col(c) for c in table.columns if c != "repo"])
        packed = table.select("repo", body.alias(name), F.xxhash64(*[
            c for c, kind in table.dtypes if not kind.startswith("map")]).alias("_h"))
        # counted first: the rows are shuffled once, by part, and not by repository before
        side, _ = measured(sizes)
        parts = packed.join(side, ["repo"]).select("repo", F.pmod("_h", F.col("_parts")).cast("int").alias("part"), name)
        pieces = parts if pieces is None else pieces.unionByName(parts, allowMissingColumns=True)
    # rows of all tables meet in one grouping; a table without rows in a part is missing there
    lists = [F.when(F.count(F.col(name)) > 0, F.collect_list(name)).alias(name) for name in tables]
    pieces = pieces.groupBy("repo", "part").agg(*lists)
    info = F.struct(F.col("repo").alias("repo_name")).alias("repository_info")
    return pieces.select("repo", "part", F.to_json(F.struct(info, *tables)).alias("document"))
