"""Compact schema descriptions: type labels, example values, sample rows, schema text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.plans.submission import each
from gridsmith.sources.tables import with_scan_order


def type_label(c: Column) -> Column:
    """INTEGER, REAL, DATE, BOOLEAN or TEXT by what the type name contains, in that order."""
    t = F.upper(F.trim(c))
    return (
        F.when(t.contains("INT"), "INTEGER")
        .when(t.rlike("REAL|FLOAT|DOUBLE|NUMERIC|DECIMAL"), "REAL")
        .when(t.rlike("DATE|TIME"), "DATE")
        .when(t.contains("BOOL"), "BOOLEAN")
        .otherwise("TEXT")
    )


def column_types(df: DataFrame) -> DataFrame:
    """``idx, column, label``: the schema as rows."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "idx int, column string, dtype string").select(
        "idx", "column", type_label(F.col("dtype")).alias("label"))


def plain_text(c: Column, dtype: str) -> Column:
    """A value as text; floating numbers without exponent between 1e-4 and 1e16, as ``12.0``."""
    if dtype not in ("double", "float"):
        return c.cast("string")
    short = c.cast("string")
    digits = F.regexp_replace(F.regexp_replace(
        short.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    inside = (F.abs(c) >= 1e-4) & (F.abs(c) < 1e16)
    return F.when(c == 0, "0.0").when(inside, digits).otherwise(F.lower(short))


def quoted(c: Column) -> Column:
    """Text in single quotes; in double quotes if it holds a single one and no double one."""
    s = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        s = F.replace(s, F.lit(char), F.lit("\\" + name))
    single = F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), s, F.lit('"'))
    return F.when(c.contains("'") & ~c.contains('"'), double).otherwise(single)


def leaves(name: str, kind: T.DataType) -> list[str]:
    """The paths of a column's plain fields, in the order in which structs are compared."""
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields for leaf in leaves(f"{name}.`{f.name}`", f.dataType)]
    return [name]


ROWS = -1  # the column number under which the sample rows travel


def earliest(df: DataFrame, order: list[str], n_values: int, n_rows: int = 0) -> DataFrame:
    """``idx, rank, value``: the first ``n_values`` distinct non-NULL values of every column as text, and
    under ROWS the first ``n_rows`` rows, cells joined by a comma, missing ones written NULL.

    One scan of the table: each task keeps the earliest few of what it reads, so it passes on a handful
    of short rows for each column whatever the number of rows, and no column is grouped by its
    values. A value among the first of the table is among the first of the task that holds it there.
    """
    names = [c for c in df.columns if c not in order]
    kinds = dict(df.dtypes)
    keys = [leaf for o in order for leaf in leaves(f"`{o}`", df.schema[o].dataType)]
    texts = df.select(*[F.col(k).alias(f"o{i}") for i, k in enumerate(keys)],
                      *[plain_text(F.col(f"`{c}`"), kinds[c]).alias(f"v{i}") for i, c in enumerate(names)])
    depth, width, rows_at = len(keys), len(names), ROWS

    def first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[dict] = [{} for _ in range(width)]  # value -> its place
        heads: list[tuple[tuple, str]] = []
        fields = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fields = list(batch.schema)[:depth]
            at = pc.sort_indices(pa.Table.from_batches([batch.select(range(depth))]),
                                 sort_keys=[(f.name, "ascending") for f in fields], null_placement="at_start")

            def place(spot: int, batch: pa.RecordBatch = batch, at: pa.Array = at) -> tuple:
                values = (batch.column(i)[at[spot].as_py()].as_py() for i in range(depth))
                return tuple((v is not None, v) for v in values)

            start = place(0)
            for c, values in enumerate(known):
                # Rows mostly come in stored order: later batches hold nothing earlier.
                if len(values) == n_values and start > max(values.values()):
                    continue
                column = batch.column(depth + c).take(at)
                for value in pc.unique(column.drop_null())[:n_values]:
                    here = place(pc.index(column, value).as_py())
                    values[value.as_py()] = min(here, values.get(value.as_py(), here))
                known[c] = dict(sorted(values.items(), key=lambda v: v[1])[:n_values])
            if n_rows and (len(heads) < n_rows or start < heads[-1][0]):
                for spot in range(min(n_rows, batch.num_rows)):
                    cells = (batch.column(depth + c)[at[spot].as_py()].as_py() for c in range(width))
                    heads.append((place(spot), ", ".join("NULL" if v is None else v for v in cells)))
                heads = sorted(heads, key=lambda h: h[0])[:n_rows]
        found = [(c, p, v) for c, values in enumerate(known) for v, p in values.items()] + [(rows_at, p, v) for p, v in heads]
        if found:
            places = pa.array([{f.name: v for f, (_, v) in zip(fields, p, strict=True)} for _, p, _ in found], pa.struct(fields))
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _, _ in found], pa.int32()), places, pa.array([v for _, _, v in found], pa.string())],
                names=["idx", "place", "value"])

    found = texts.mapInArrow(first_of_task, T.StructType([
        T.StructField("idx", T.IntegerType()), T.StructField("place", T.StructType(texts.schema.fields[:depth])),
        T.StructField("value", T.StringType())]))
    # Values of a column meet over tasks; equal rows stay rows of their own.
    own = F.when(F.col("idx") == ROWS, F.col("place"))
    met = found.groupBy("idx", "value", own.alias("own")).agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("idx").orderBy("place"))
    limit = F.when(F.col("idx") == ROWS, n_rows).otherwise(n_values)
    return met.select("idx", rank.alias("rank"), "value").where(F.col("rank") <= limit)


def example_values(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """``idx, column, rank, value``: the first ``n`` distinct non-NULL values of every column, from one scan."""
    names = [c for c in df.columns if c not in order]
    column = F.get(F.array(*[F.lit(c) for c in names]), F.col("idx"))
    return earliest(df, order, n).select("idx", column.alias("column"), "rank", "value")


def sample_rows(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """``rank, line``: the first rows, cells joined by a comma, missing ones written NULL."""
    names = [c for c in df.columns if c not in order]
    kinds = dict(df.dtypes)
    first = df.orderBy(*order).limit(n)
    line = F.concat_ws(", ", *[F.coalesce(plain_text(F.col(f"`{c}`"), kinds[c]), F.lit("NULL")) for c in names])
    return first.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"), line.alias("line"))


def m_schema(df: DataFrame, table: str, order: list[str], keys: list[str] | None = None,
             foreign_keys: list[str] | None = None, n_rows: int = 3, n_values: int = 3) -> DataFrame:
    """``table_name, text``: one row describing the table for a prompt.

    One scan, run when the row is asked for: everything that depends on rows comes from :func:`earliest`,
    the rest is known from the schema.
    """
    names = [c for c in df.columns if c not in order]
    if not names:
        return df.sparkSession.createDataFrame(
            [(table, f"【DB_ID】 {table}\n(no columns found)")], "table_name string, text string")
    kinds = dict(df.dtypes)
    text_columns = [i for i, c in enumerate(names) if kinds[c] == "string"]
    shown = F.when(F.col("idx").isin(text_columns), quoted(F.col("value"))).otherwise(F.col("value"))
    lists = earliest(df, order, n_values, n_rows).groupBy("idx").agg(
        F.array_sort(F.collect_list(F.struct("rank", shown.alias("value")))).alias("list")).select(
        "idx", F.when(F.col("idx") == ROWS, F.array_join("list.value", "\n")).otherwise(F.array_join("list.value", ", ")).alias("list"))
    by_column = lists.agg(F.map_from_entries(F.collect_list(F.struct("idx", "list"))).alias("lists"))

    def line(i: int, name: str) -> Column:
        examples = F.col("lists")[F.lit(i)]
        return F.concat(
            F.lit("("), F.concat(F.lit(f"{name}:"), type_label(F.lit(kinds[name]))), F.lit(", Primary Key" if name in (keys or []) else ""),
            F.when(examples.isNotNull(), F.concat(F.lit(", Examples: ["), examples, F.lit("]"))).otherwise(""), F.lit("),"))

    # The marks around the parts of a description.
    opening = [f"【DB_ID】 {table}", "【Schema】", f"# Table: {table}", "["]
    rows = F.col("lists")[F.lit(ROWS)]
    closing = "\n".join(["【Foreign keys】", *foreign_keys]) if foreign_keys else None
    parts = [*map(F.lit, opening), *[line(i, c) for i, c in enumerate(names)], F.lit("]"),
             F.concat(F.lit(f"Sample rows from `{table}`:\n"), rows), F.lit(closing).cast("string")]
    return by_column.select(F.lit(table).alias("table_name"), F.concat_ws("\n", *parts).alias("text"))


def describe_tables(spark: SparkSession, databases: dict[str, str], workers: int = 4) -> DataFrame:
    """``db_id, text``: the description of every database's published table, rows in stored order.

    One scan and one short text per table. A table that cannot be read is described as unavailable,
    with the reason.
    """
    def one(db_id: str) -> str:
        return m_schema(with_scan_order(spark.read.parquet(databases[db_id])), db_id, ["block", "seq"]).first().text

    rows = [(db_id, text if error is None else f"(schema unavailable: {error})")
            for db_id, text, error in each(sorted(databases), one, workers)]
    return spark.createDataFrame(rows, "db_id string, text string")
