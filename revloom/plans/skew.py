"""Joins and top-n that hold up when one key owns a large share of the rows."""

from pyspark.sql import DataFrame, Window as W, functions as F

from revloom.plans.runtime import settle

SALTS = 16
# Spark prunes row_number() <= n before the shuffle up to this n (windowGroupLimitThreshold)
GROUP_LIMIT = 1000
# a side is broadcast only after its rows were counted and are no more than this
BROADCAST_ROWS = 200_000


def attach(rows: DataFrame, scalars: DataFrame, keys, spread, salts: int = SALTS) -> DataFrame:
    """Left join a table with one row per key onto ``rows``.

    A hot key is spread over ``salts`` tasks by the hash of the ``spread`` columns; the scalar side
    is copied once per salt. No broadcast is forced: the planner picks it when the measured size
    of the scalar side allows it.
    """
    keys = list(keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = scalars.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def join_by_number(rows: DataFrame, other: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on text keys, with a hash of them in front: a sort compares its first column as a number, and texts only where
    the hash is equal. Without it rows of one repository are told apart by comparing whole rows."""
    keys = list(keys)
    if any(rows.schema[k].dataType != other.schema[k].dataType for k in keys):
        return rows.join(other, keys, how)  # types that are not the same hash differently
    code = F.xxhash64(*keys)
    return rows.withColumn("_code", code).join(other.withColumn("_code", code), ["_code", *keys], how).drop("_code")


def top_n(rows: DataFrame, keys, order, n: int, spread, salts: int = 64) -> DataFrame:
    """The first ``n`` rows per key.

    Small ``n``: every task keeps its own first ``n`` before the shuffle. Large ``n``: the same is
    done per (key, salt), so that no task sorts more than its share; at most ``salts * n`` rows
    per key reach the second step.
    """
    keys = list(keys)
    if n > GROUP_LIMIT:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
        local = W.partitionBy(*keys, "_salt").orderBy(*order)
        rows = (salted.withColumn("_rank", F.row_number().over(local))
                .filter(F.col("_rank") <= n).drop("_rank", "_salt"))
    window = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def measured(side: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Compute a side that should be small, once, and tell whether it may be broadcast.

    Runs one job. Used where the other side is so large that even writing its shuffle is worth
    avoiding.
    """
    rows = settle(side)
    small = rows.count() <= limit
    return (F.broadcast(rows) if small else rows), small


def attach_measured(rows: DataFrame, scalars: DataFrame, keys, spread,
                    limit: int = BROADCAST_ROWS) -> DataFrame:
    """:func:`attach` without a shuffle of ``rows`` where the counted scalar side is small."""
    side, small = measured(scalars, limit)
    return rows.join(side, list(keys), "left") if small else attach(rows, side, keys, spread)
