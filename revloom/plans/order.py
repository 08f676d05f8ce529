"""Running values over a total order, without one task per key.

``W.partitionBy(key).orderBy(...)`` sends a whole key to one task. Here the rows are range
partitioned on (key, order), so that a hot key covers many partitions of equal size; each partition
is summed up on its own and then shifted by the totals of the partitions before it. The per-partition
totals are at most (partitions + keys) rows. The order must be unique within a key.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from revloom.plans.runtime import settle


def _blocks(rows: DataFrame, keys, order) -> DataFrame:
    """Range partition and settle; ``_block`` is the partition, ``_slot`` the place in it.

    The result is settled because it is read twice below: range bounds come from a sample, and
    both reads must see the same ones.
    """
    sort = [F.col(k).asc() for k in keys] + list(order)
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    numbered = ranged.withColumn("_slot", F.monotonically_increasing_id())
    return settle(numbered).withColumn("_block", F.shiftright("_slot", 33))


def with_position(rows: DataFrame, keys, order, totals=()) -> DataFrame:
    """Add ``position`` (from 1 within the key) and ``running_<c>`` for every column in ``totals``."""
    keys = list(keys)
    blocks = _blocks(rows, keys, order)
    sums = [F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in totals]]
    per_block = blocks.groupBy(*keys, "_block").agg(*sums, F.min("_slot").alias("_low"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    shifts = per_block.select(
        *keys, "_block", "_low",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_base_{c}") for c in totals])
    within = W.partitionBy(*keys, "_block").orderBy("_slot")
    running = within.rowsBetween(W.unboundedPreceding, 0)
    # settled: the planner knows its size, and does not shuffle the rows where it can be broadcast
    shifted = blocks.join(settle(shifts), [*keys, "_block"])
    # rows of a key stand together in a block, so places differ from numbers by a constant
    return shifted.select(
        *rows.columns,
        (F.col("_slot") - F.col("_low") + 1 + F.col("_base")).alias("position"),
        *[(F.sum(c).over(running) + F.col(f"_base_{c}")).alias(f"running_{c}") for c in totals])


def carry_last(rows: DataFrame, keys, order, value: str, out: str) -> DataFrame:
    """Add ``out``: the latest non-null ``value`` at or before the row."""
    keys = list(keys)
    blocks = _blocks(rows, keys, order)
    per_block = (blocks.filter(F.col(value).isNotNull()).groupBy(*keys, "_block")
                 .agg(F.max_by(value, "_slot").alias("_last")))
    spine = blocks.select(*keys, "_block").distinct().join(per_block, [*keys, "_block"], "left")
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = spine.select(*keys, "_block",
                           F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    within = (W.partitionBy(*keys, "_block").orderBy("_slot")
              .rowsBetween(W.unboundedPreceding, 0))
    return blocks.join(carried, [*keys, "_block"]).select(
        *rows.columns,
        F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("_carry")).alias(out))


# rows of one segment are sorted by one task
SEGMENT = 1 << 20


def segment_of(position):
    """Number of the segment that holds a dense position."""
    return F.floor(F.col(position) / F.lit(SEGMENT)) if isinstance(position, str) else (
        F.floor(position / F.lit(SEGMENT)))


def running_sum(rows: DataFrame, keys, position: str, value: str, out: str) -> DataFrame:
    """Running sum along a dense position (one row per key and position).

    Dense positions cut a key into segments of equal size: sum within the segment, then add the
    totals of the segments before it.
    """
    keys = list(keys)
    cut = rows.withColumn("_segment", segment_of(position))
    totals = cut.groupBy(*keys, "_segment").agg(F.sum(value).alias("_total"))
    before = W.partitionBy(*keys).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(*keys, "_segment",
                           F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = (W.partitionBy(*keys, "_segment").orderBy(position)
              .rowsBetween(W.unboundedPreceding, 0))
    return cut.join(shifts, [*keys, "_segment"]).select(
        *rows.columns, (F.sum(value).over(within) + F.col("_base")).alias(out))
