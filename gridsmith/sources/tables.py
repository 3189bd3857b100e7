"""Published tables: write once, look up, replace without a moment of loss."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.session import file_system


OLD = "__replaced"  # what a table is called between its removal and its successor's arrival


def catalog_name(name: str) -> str:
    """A name as the catalog takes it: ASCII letters, digits and underscores; all else is an underscore."""
    return re.sub(r"[^A-Za-z0-9_]", "_", name) or "table"


def identifier(name: str) -> str:
    """A table's name, with its database before a dot, as SQL text writes it."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def is_published(spark: SparkSession, path: str) -> bool:
    """A finished table: its folder has the success mark, which a write that died has not.

    A replacement that died after it had put the old table aside is undone first.
    """
    path = path.rstrip("/")
    system, target = file_system(spark, path)
    done = lambda where: system.exists(file_system(spark, f"{where}/_SUCCESS")[1])
    if done(path):
        return True
    if not done(path + OLD):
        return False
    system.delete(target, True)
    return system.rename(file_system(spark, path + OLD)[1], target)


def in_catalog(spark: SparkSession, name: str) -> bool:
    """Whether a table is in the catalog; a replacement that died half way is undone first, as for folders."""
    if spark.catalog.tableExists(identifier(name)):
        return True
    if not spark.catalog.tableExists(identifier(name + OLD)):
        return False
    spark.sql(f"ALTER TABLE {identifier(name + OLD)} RENAME TO {identifier(name)}")
    return True


def publish(df: DataFrame, name: str, overwrite: bool = False, path: str | None = None,
            order: list[str] | None = None) -> str:
    """Write a table and say what happened: ``published`` or ``skipped``; empty is an error.

    The target is a catalog table, or a Parquet folder if ``path`` is given. With ``order`` the
    files hold the rows in that order (a range shuffle, then a sort inside each task). Either is
    written beside its place and looked at; then the old table is renamed, the new one takes its
    name, and the old one goes. So an empty table or a failed write leaves what was there before,
    and a run that dies between the renames leaves an old table that the next look-up puts back.
    """
    spark = df.sparkSession
    present = is_published(spark, path) if path else in_catalog(spark, name)
    if present and not overwrite:
        return "skipped"
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order)
    if path:
        replace_folder(df, name, path.rstrip("/"))
    else:
        replace_in_catalog(df, name)
    return "published"


def replace_folder(df: DataFrame, name: str, path: str, empty: bool = False) -> None:
    """Write beside a folder and take its place; without rows only if it may be ``empty``."""
    spark = df.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}"
    try:
        df.write.parquet(fresh)
        # Asked of the written files, so the job does not run twice.
        if not empty and spark.read.schema(df.schema).parquet(fresh).isEmpty():
            raise ValueError(f"no data after cleaning: {name}")
        take_place(spark, fresh, path)
    finally:
        system, source = file_system(spark, fresh)
        system.delete(source, True)


def take_place(spark: SparkSession, fresh: str, path: str) -> None:
    """Move a finished folder to its place; what is there goes aside first, and goes only when the new one has come."""
    system, source = file_system(spark, fresh)
    target, old = (file_system(spark, p)[1] for p in (path, path + OLD))
    system.mkdirs(target.getParent())
    if is_published(spark, path):
        system.delete(old, True)
        if not system.rename(target, old):
            raise OSError(f"cannot put aside the table at {path}")
    else:
        system.delete(target, True)
    if not system.rename(source, target):
        raise OSError(f"cannot move the table to {path}")
    system.delete(old, True)


def publish_together(df: DataFrame, key: str, paths: dict[str, str], order: list[str] | None = None) -> dict[str, str]:
    """Write many tables of one schema in one job; ``paths`` says where the rows of each value of ``key`` go.

    Returns an error for each table that has no rows. The tables are moved one by one, each as by
    :func:`publish`.
    """
    spark = df.sparkSession
    fresh = f"{next(iter(paths.values())).rstrip('/')}.{uuid.uuid4().hex}"
    if order:
        df = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).drop(*order)
    errors = {}
    try:
        df.write.partitionBy(key).parquet(fresh)
        for value, path in paths.items():
            system, folder = file_system(spark, f"{fresh}/{key}={value}")
            if not system.exists(folder):
                errors[value] = "no data after cleaning"
                continue
            system.create(file_system(spark, f"{fresh}/{key}={value}/_SUCCESS")[1]).close()
            take_place(spark, f"{fresh}/{key}={value}", path.rstrip("/"))
    finally:
        system, folder = file_system(spark, fresh)
        system.delete(folder, True)
    return errors


def replace_in_catalog(df: DataFrame, name: str) -> None:
    spark = df.sparkSession
    fresh = f"{name}__{uuid.uuid4().hex}"
    try:
        df.write.format("parquet").saveAsTable(identifier(fresh))
        if spark.table(identifier(fresh)).isEmpty():
            raise ValueError(f"no data after cleaning: {name}")
        if in_catalog(spark, name):
            spark.sql(f"DROP TABLE IF EXISTS {identifier(name + OLD)}")
            spark.sql(f"ALTER TABLE {identifier(name)} RENAME TO {identifier(name + OLD)}")
        spark.sql(f"ALTER TABLE {identifier(fresh)} RENAME TO {identifier(name)}")
        spark.sql(f"DROP TABLE IF EXISTS {identifier(name + OLD)}")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {identifier(fresh)}")


def first_table(spark: SparkSession, database: str | None = None) -> str | None:
    """First table of a database by name; the catalog keeps no creation order."""
    names = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
    return names[0] if names else None


def stored_place(file: str, start: str) -> str:
    """SQL of a text that sorts like the stored order of splits: by folder, number of the part file, name, first byte.

    Part numbers are written with five digits at least, so among them the longer one is the larger.
    """
    name = f"substring_index({file}, '/', -1)"
    number = f"substring_index({name}, '-', 2)"
    digits = f"CASE WHEN startswith({name}, 'part-') THEN length({number}) ELSE 0 END"
    return (f"concat_ws(' ', substring({file}, 1, length({file}) - length({name})), "
            f"lpad(CAST({digits} AS STRING), 4, '0'), {name}, lpad(CAST({start} AS STRING), 20, '0'))")


def with_scan_order(df: DataFrame) -> DataFrame:
    """Add ``block, seq``: the order in which a file-backed table stores its rows."""
    block = F.expr(stored_place("_metadata.file_path", "_metadata.file_block_start"))
    return df.select("*", block.alias("block"), F.monotonically_increasing_id().alias("seq"))
