"""Cleaning, derived columns and filters."""

import logging

from pyspark.sql import DataFrame, functions as F, types as T

from revloom.functions import paths, scalars, text

log = logging.getLogger(__name__)

# fixed values: accepted names per column, first match wins
COMMIT_ALIASES = {"commit_hash": ("commit_hash", "hash")}
CONTRIBUTOR_ALIASES = {"commit_count": ("commit_count", "commits", "total_commits"),
                       "author_name": ("author_name", "name", "contributor")}


def conform(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rename the first accepted name that exists to the wanted name."""
    found = {}
    for wanted, accepted in aliases.items():
        have = next((name for name in accepted if name in df.columns), None)
        if have and have != wanted:
            found[have] = wanted
    return df.withColumnsRenamed(found)


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its types, null where missing; further columns stay as they are."""
    known = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
             for f in schema.fields]
    names = set(schema.fieldNames())
    return df.select(*known, *[c for c in df.columns if c not in names])


def find_count_column(df: DataFrame) -> str | None:
    """First column whose name holds both "commit" and "count"."""
    return next((c for c in df.columns if "commit" in c.lower() and "count" in c.lower()), None)


def parse_dates(df: DataFrame, columns, required: str | None = None) -> DataFrame:
    """Lenient timestamp parsing: bad text becomes null; rows without ``required`` are dropped."""
    parsed = df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in columns})
    return parsed.filter(F.col(required).isNotNull()) if required else parsed


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Add year, month (first day), day_of_week and hour."""
    return df.withColumns({"year": F.year(date), "month": scalars.month_start(date),
                           "day_of_week": scalars.day_name(date), "hour": F.hour(date)})


def with_path_columns(df: DataFrame, path: str = "filepath") -> DataFrame:
    """Add file_extension, filename, directory, path_depth and top_level_dir."""
    return df.withColumns({
        "file_extension": paths.path_suffixes(path), "filename": paths.path_name(path),
        "directory": paths.path_dir(path), "path_depth": paths.path_depth(path),
        "top_level_dir": paths.top_level_dir(path)})


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Replace every struct column ``k`` by columns ``k_<field>`` (one level)."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            columns += [F.col(field.name)[sub].alias(f"{field.name}{separator}{sub}")
                        for sub in field.dataType.names]
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def drop_invalid_changes(df: DataFrame, date: str = "date", path: str = "filepath") -> DataFrame:
    return df.filter(F.col(date).isNotNull() & F.col(path).isNotNull() & (F.col(path) != ""))


def parse_range(span: str) -> tuple[str, str] | None:
    """Split ``start,end``; invalid text gives None and a warning."""
    import datetime
    try:
        start, end = (datetime.datetime.fromisoformat(x.strip()) for x in span.split(","))
    except ValueError:
        log.warning("ignoring invalid date range %r", span)
        return None
    as_utc = [x if x.tzinfo else x.replace(tzinfo=datetime.timezone.utc) for x in (start, end)]
    return tuple(x.isoformat() for x in as_utc)


def filter_dates(df: DataFrame, span: str | None, date: str = "date") -> DataFrame:
    """Rows with ``start <= date <= end``; tables without the column pass unchanged."""
    bounds = parse_range(span) if span else None
    if bounds is None or date not in df.columns:
        return df
    start, end = (F.lit(b).cast("timestamp") for b in bounds)
    return df.filter(F.col(date).between(start, end))


def exclude_paths(df: DataFrame, patterns, path: str = "filepath") -> DataFrame:
    """Drop rows whose path matches any of the patterns; rows without a path stay."""
    for pattern in patterns:
        df = df.filter(~F.coalesce(F.col(path).rlike(pattern), F.lit(False)))
    return df


def frequent_files(changes: DataFrame, least: int = 2) -> DataFrame:
    """Keep the change rows of files with at least ``least`` rows."""
    if least <= 1:
        return changes
    often = (changes.groupBy("repo", "filepath").agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") >= least).select("repo", "filepath"))
    return changes.join(often, ["repo", "filepath"], "left_semi")


def repair_text(df: DataFrame) -> DataFrame:
    """Replace invalid UTF-8 in every string column."""
    text_columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.make_valid_utf8(c) for c in text_columns})


def normalise_changes(raw: DataFrame) -> DataFrame:
    """Status letter, rename target and churn for raw change rows (``status``, ``path``)."""
    return (raw.withColumn("change_type", text.change_kind("status"))
            .filter(F.col("change_type").isNotNull())
            .withColumn("filepath", text.rename_target("path"))
            .withColumn("total_churn", F.col("insertions") + F.col("deletions"))
            .drop("status", "path"))


def recent(df: DataFrame, as_of, days: int, date: str = "date") -> DataFrame:
    """Rows dated at or after ``as_of`` minus ``days``."""
    clock = as_of if not isinstance(as_of, str) else F.lit(as_of).cast("timestamp")
    return df.filter(F.col(date) >= clock - F.make_dt_interval(F.lit(days)))


def with_suffix(df: DataFrame, suffixes, path: str = "filepath") -> DataFrame:
    return df.filter(paths.has_suffix(path, suffixes))
