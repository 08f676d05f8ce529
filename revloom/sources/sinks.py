"""CSV and JSON output."""

import logging

from pyspark.sql import DataFrame, functions as F, types as T

from revloom.operators.clean import flatten

log = logging.getLogger(__name__)


def write_csv(df: DataFrame, path: str) -> bool:
    """CSV with a header of sorted columns; structs become ``k_sub``, lists and maps JSON text.
    Empty data writes nothing."""
    if df.isEmpty():
        log.warning("no data for %s", path)
        return False
    flat = flatten(df)
    columns = [F.to_json(f.name).alias(f.name)
               if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
               for f in sorted(flat.schema.fields, key=lambda f: f.name)]
    flat.select(*columns).write.mode("overwrite").option("header", True).option(
        "escape", '"').csv(path)
    return True


def metric_rows(patterns: DataFrame) -> DataFrame:
    """A one-row-per-repository table as (repo, metric, value) text rows."""
    metrics = [f.name for f in patterns.schema.fields if f.name != "repo"]
    as_text = [(F.to_json(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
                else F.col(f.name).cast("string")).alias(f.name)
               for f in patterns.schema.fields if f.name != "repo"]
    return patterns.select("repo", *as_text).unpivot("repo", metrics, "metric", "value")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines by repository; text keeps all characters, other types are written as text."""
    df.write.mode("overwrite").partitionBy("repo").json(path)
