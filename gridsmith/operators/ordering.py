"""Positions and carried values over row order, without one task per group.

A plain window puts a whole group into one task. Here the order key is given as levels, coarse to
fine: counts per level are prefix-summed (small tables), and only rows that share every level are
sorted together. A group holding a third of all rows is thus spread over as many tasks as it has
chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def positions(df: DataFrame, group: list[str], levels: list[list[str]], order: list[str], name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row in its group, by ``levels`` then ``order``.

    Rows are shuffled once, by group and all levels; the offsets come from counts that are
    combined map-side first and meet the rows in the same partitioning. Keys must not be NULL:
    a NULL-safe join would need a partitioning of its own, a second shuffle of all rows.
    """
    keys = group + [k for level in levels for k in level]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts
    base = F.lit(0)
    for depth in range(len(levels)):
        # Rows before this chunk inside its parent chunk.
        parent = group + [k for level in levels[:depth] for k in level]
        chunk = parent + levels[depth]
        totals = counts.groupBy(*chunk).agg(F.sum("_n").alias("_n")) if depth + 1 < len(levels) else counts
        before = Window.partitionBy(*parent).orderBy(*levels[depth]).rowsBetween(
            Window.unboundedPreceding, -1)
        part = totals.select(*chunk, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_off{depth}"))
        offsets = offsets.join(part, chunk)
        base = base + F.col(f"_off{depth}")
    offsets = offsets.select(*keys, base.alias("_base"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    placed = df.withColumn("_local", local).join(offsets, keys)
    return placed.select(*df.columns, (F.col("_base") + F.col("_local") - 1).alias(name))


def numbered(df: DataFrame, order: str, name: str, chunk_rows: int = 1_000_000) -> DataFrame:
    """Dense 0-based positions by a numeric order column, over the whole table."""
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / chunk_rows))
    return positions(chunked, [], [["_chunk"]], [order], name).drop("_chunk")


def carried(df: DataFrame, values: dict[str, Column], table: list[str], block: list[str],
            order: list[str]) -> DataFrame:
    """Per new column, the last non-NULL of its expression in earlier rows of the same table.

    ``block`` cuts a table into order-consistent pieces. Each block is scanned on its own; the
    last value of every block is then carried over the blocks, one short row per block. Table and
    block must not be NULL.
    """
    local_w = Window.partitionBy(*table, *block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sort_key = F.struct(*order)
    prepared = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    local = prepared.select(
        "*", *[F.last(f"_v_{n}", ignorenulls=True).over(local_w).alias(f"_l_{n}") for n in values])
    ends = prepared.groupBy(*table, *block).agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), sort_key)).alias(f"_e_{n}") for n in values])
    block_w = Window.partitionBy(*table).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *table, *block,
        *[F.last(f"_e_{n}", ignorenulls=True).over(block_w).alias(f"_c_{n}") for n in values])
    # The same keys as the window's, so the rows are not shuffled again.
    return local.join(ends, table + block).select(
        *df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values])
