"""The query registry and the ways values are written messily."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.session import file_system

SPLIT_BYTES = 64 << 20

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


def file_count(spark: SparkSession, sf_dir: str, name: str, least: int = 1, each: int = SPLIT_BYTES) -> int:
    """Into how many files the rows of a table are written: one for each ``each`` bytes, so that no task's share grows with it."""
    size = sum(file_system(spark, f)[0].getFileStatus(file_system(spark, f)[1]).getLen() for f in table(spark, sf_dir, name).inputFiles())
    return max(least, -(-size // each))


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for queries whose time goes into cell work: a file with fewer splits than there are cores
    is dealt evenly to all of them by its first column, others are read as they lie."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    size = sum(file_system(spark, f)[0].getFileStatus(file_system(spark, f)[1]).getLen() for f in rows.inputFiles()[:cores])
    return rows.repartition(cores, rows.columns[0]) if size < cores * SPLIT_BYTES else rows


def case(selector: Column, *choices: Column | str | None) -> Column:
    """The i-th choice for selector value i."""
    out = None
    for i, choice in enumerate(choices):
        value = choice if isinstance(choice, Column) else F.lit(choice)
        out = F.when(selector == i, value) if out is None else out.when(selector == i, value)
    return out


def us_text(c: Column) -> Column:
    return F.format_number(c, 2)


def vn_text(c: Column) -> Column:
    return F.translate(F.format_number(c, 2), ",.", ".,")


def plain_text(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def comma_text(c: Column) -> Column:
    return F.translate(plain_text(c), ".", ",")
