"""Registration of queries. A column list gives names and types of the result for both engines.

Types: none = text, ``l`` = long, ``d`` = double (6 digits), ``e`` = double (12 digits, for means that
often end in a 5 at the seventh digit), ``t`` = time as text, ``b`` = boolean.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from revloom.catalog.adapters import Tables, half_up, with_tables


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def _typed(columns: str):
    return [(item.partition(":")[0], item.partition(":")[2]) for item in columns.split()]


def shape(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _typed(columns):
        c = F.col(name)
        out.append({"l": lambda: c.cast("long"), "d": lambda: F.round(c.cast("double"), 6),
                    "e": lambda: F.round(c.cast("double"), 12),
                    "t": lambda: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "b": lambda: c,
                    "": lambda: c.cast("string")}[kind]().alias(name))
    return df.select(*out)


def _sql_shape(columns: str) -> str:
    form = {"l": "CAST({0} AS BIGINT)", "d": half_up("CAST({0} AS DOUBLE)", 6),
            "e": half_up("CAST({0} AS DOUBLE)", 12),
            "t": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "b": "{0}", "": "CAST({0} AS VARCHAR)"}
    return ", ".join(f"{form[kind].format(name)} AS {name}" for name, kind in _typed(columns))


def query(key: str, columns: str, sql: str | None = None, *needs: str,
          extra: dict[str, str] | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key`` with its SQL twin."""
    def register(fn):
        text = None
        if sql is not None:
            text = with_tables(f"SELECT {_sql_shape(columns)} FROM ({sql}) AS result", *needs,
                               extra=extra)
        QUERIES[key] = Query(
            lambda spark, sf_dir: shape(fn(Tables(spark, sf_dir)), columns), text)
        return fn
    return register
