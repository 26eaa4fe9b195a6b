"""Ordered windows whose partitions may be arbitrarily large.

A plain window puts all rows of one key into one task. The functions here cut
each key's order into blocks, solve every block on its own, carry one summary
row per block through a second, much smaller window and join the carried value
back. A key that holds a third of all rows is thus spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scalarscape.session import cut_lineage


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: str,
    block: Column,
    states: dict[str, Column],
) -> DataFrame:
    """Add, for each ``name: expr`` of ``states``, column ``name``: the last non-null ``expr`` of the rows before this one.

    ``block`` must be non-decreasing along ``order`` within a key (for example
    ``floor(order / 1024)``). ``order`` must be unique within a key; nulls in
    ``order`` sort first. A key's first row gets null. An empty table stays empty.
    """
    work = df.withColumn("_blk", block)
    inner = Window.partitionBy(*keys, "_blk").orderBy(F.col(order).asc_nulls_first())
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    within = work.select(
        "*", *[F.last(expr, ignorenulls=True).over(before).alias(f"_in_{name}") for name, expr in states.items()]
    )
    tails = work.groupBy(*keys, "_blk").agg(
        *[
            F.max_by(expr, F.when(expr.isNotNull(), F.col(order))).alias(f"_tail_{name}")
            for name, expr in states.items()
        ]
    )
    outer = Window.partitionBy(*keys).orderBy(F.col("_blk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *keys,
        "_blk",
        *[F.last(f"_tail_{name}", ignorenulls=True).over(outer).alias(f"_carry_{name}") for name in states],
    )
    condition = [F.col(f"w.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_blk"]]
    joined = within.alias("w").join(carried.alias("c").hint("merge"), condition, "left")
    return joined.select(
        *[F.col(f"w.{c}") for c in df.columns],
        *[F.coalesce(F.col(f"w._in_{name}"), F.col(f"c._carry_{name}")).alias(name) for name in states],
    )


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one, in the order (``bucket``, ``order``), per key.

    ``bucket`` splits each key into pieces of bounded size, for example the high
    bits of the hash that orders the rows; null values count as 0.
    """
    amount = F.coalesce(F.col(value), F.lit(0))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("_before", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    totals = df.groupBy(*keys, bucket).agg(F.sum(amount).alias("_total"))
    starts = totals.select(*keys, bucket, F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_start"))
    condition = [F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, bucket]]
    joined = within.alias("w").join(starts.alias("s"), condition)
    return joined.select(*[F.col(f"w.{c}") for c in df.columns], (F.col("w._before") + F.col("s._start")).alias(out))


def running_number(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the row's number from 1 within ``keys`` in ``order`` (ascending, unique within a key; nulls first).

    The rows are range-partitioned by keys and order, so a key that holds most rows lies in
    many partitions; each counts its own and adds what came before.
    """
    ranged = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).withColumn("_one", F.lit(1)))
    counted = running_total(ranged, keys, "_part", order, "_one", "_before")
    return counted.select(*df.columns, (F.col("_before") + 1).cast("int").alias(out))
