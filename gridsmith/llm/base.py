"""What the operators share: the registry, staging, global ranks, connected components, block tables."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsmith.session import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A staged copy of ``df`` with ``name``: the 0-based place of each row in the global order.

    A range-partitioned sort numbers the rows of each partition; the partitions' row counts, one
    short row each, are prefix-summed. No task sees more than its own range.
    """
    placed = staged(df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_row") - F.shiftleft(F.col("_part").cast("long"), 33)
    return placed.join(offsets, "_part").select(*df.columns, (F.col("_off") + local).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for ``edges(a, b)``: root is the smallest node reachable. Isolated nodes are not listed.

    Each round takes the smallest label among neighbours (combined map-side, so a node of any degree
    is one short row per task) and then jumps to the label's own label. Every round ends in a staged
    table; only the count of changed labels comes to the driver.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "labels")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("near")))
        hooked = staged(labels.join(near, "node").select(
            "node", F.least("root", "near").alias("root"), F.col("root").alias("was")), "labels")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = staged(hooked.join(up, "root").select(
            "node", F.least("root", "up").alias("root"), "was"), "labels")
        labels = jumped.select("node", "root")
        if jumped.where("root <> was").isEmpty():
            return labels


def block_tables(bits: int, radius: int, blocks: int) -> list[list[tuple[int, int]]]:
    """Per table, the (shift, width) of its leading blocks.

    Two words within ``radius`` bits differ in at most ``radius`` of the blocks, so they agree on
    all leading blocks of at least one table.
    """
    if not radius < blocks <= bits:
        raise ValueError("more blocks than the radius are needed")
    cuts = [i * bits // blocks for i in range(blocks + 1)]
    cut = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(blocks)]
    return [list(c) for c in combinations(cut, blocks - radius)]


def block_keys(fingerprint: Column, radius: int, blocks: int, bits: int = 64) -> Column:
    """Array of (table, key): the permuted fingerprint's leading bits in each block table."""
    keys = []
    for t, lead in enumerate(block_tables(bits, radius, blocks)):
        key = F.lit(0).cast("long")
        for shift, width in lead:
            part = F.shiftrightunsigned(fingerprint, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(F.struct(F.lit(t).alias("table"), key.alias("key")))
    return F.array(*keys)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
