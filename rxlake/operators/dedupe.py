"""Keyed de-duplication, canonical pairs and stable numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rxlake.session import checkpointed


def _pick(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    """One row per key by an aggregate rather than a window.

    Each map task keeps one row per key before the shuffle, so a key that holds most of the table
    costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    chosen = df.groupBy(*keys).agg(pick(F.struct(*[F.col(c) for c in rest]), rank).alias("__row"))
    return chosen.select(*[F.col(k) for k in keys], *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(
        *df.columns
    )


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in ``order``; later rows are ignored."""
    return _pick(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key in ``order``; earlier rows are overwritten."""
    return _pick(df, keys, order, F.max_by)


def canonical_pair(left: Column, right: Column) -> Column:
    """``struct(a, b)`` with ``a < b``, or null for a self-pair or a missing side."""
    return F.when(left < right, F.struct(left.alias("a"), right.alias("b"))).when(
        left > right, F.struct(right.alias("a"), left.alias("b"))
    )


def number_rows(df: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Contiguous numbers in partition order without moving rows.

    Row counts of the partitions are summed up in a table with one row per partition, the only part
    that goes through a single window. The input is read twice, so its partitions must not change
    between reads: a file scan or a checkpointed table.
    """
    offset = F.lit((1 << 33) - 1)
    numbered = df.withColumn("__id", F.monotonically_increasing_id()).select(
        "*",
        F.shiftright("__id", 33).alias("__part"),
        F.col("__id").bitwiseAND(offset).alias("__at"),
    )
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # One row per partition of the input: bounded by the partition count, whatever the row count.
    return numbered.join(F.broadcast(starts), "__part").select(
        *df.columns, (F.col("__before") + F.col("__at") + F.lit(start)).alias(name)
    )


def number_in_order(df: DataFrame, order: list, name: str) -> DataFrame:
    """Contiguous 1-based numbers in global sort order.

    Range partitioning spreads the sort over all tasks; the sorted table is cut by a checkpoint so that
    both reads of :func:`number_rows` see the same partitions.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return number_rows(checkpointed(ordered), name)


def assign_molecule_ids(keys: DataFrame, column: str) -> DataFrame:
    """``MOL`` + six-digit number in sorted order of the distinct non-empty keys."""
    distinct = keys.select(F.col(column)).filter(F.col(column) != "").distinct()
    numbered = number_in_order(distinct, [column], "__no")
    return numbered.select(molecule_id(F.col("__no")).alias("molecule_id"), F.col(column))


def molecule_id(number: Column) -> Column:
    """Six digits at least; larger numbers keep all their digits."""
    text = number.cast("string")
    return F.concat(F.lit("MOL"), F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text))
