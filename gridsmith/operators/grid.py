"""Shaping a raw grid: empty rows and columns, header rows, names, ditto marks.

A grid has ``table_id``, the row order ``block, seq`` and the text cells ``c0..cN``. All operators
work on many tables at once, keyed by ``table_id``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.functions import text
from gridsmith.functions import vocabulary as V
from gridsmith.operators.ordering import carried, null_safe

TABLE = ["table_id"]
ORDER = ["block", "seq"]
PIECE_ROWS = 100_000  # rows of a block that one window takes


def cell_columns(grid: DataFrame) -> list[str]:
    return sorted((c for c in grid.columns if re.fullmatch(r"c\d+", c)), key=lambda c: int(c[1:]))


def drop_empty_rows(grid: DataFrame, cells: list[str] | None = None) -> DataFrame:
    """Drop rows whose cells are all NULL or blank."""
    return grid.where(~text.is_blank(F.concat_ws("", *(cells or cell_columns(grid)))))


def column_facts(grid: DataFrame, cells: list[str] | None = None, table: list[str] = TABLE) -> DataFrame:
    """One row per table and column: does it hold any text, ditto mark, or text that NFC may change.

    One aggregate over the grid decides three later steps, so that tables without ditto marks
    never pay for the fill, and ASCII columns never leave the JVM.
    """
    cells = cells or cell_columns(grid)
    flags = grid.groupBy(*table).agg(*[
        F.struct(
            F.coalesce(F.bool_or(~text.is_blank(F.col(c))), F.lit(False)).alias("filled"),
            F.coalesce(F.bool_or(text.is_ditto(F.col(c))), F.lit(False)).alias("ditto"),
            F.coalesce(F.bool_or(text.may_change_under_nfc(F.col(c))), F.lit(False)).alias("nfc"),
        ).alias(c) for c in cells])
    long = flags.select(*table, F.explode(F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(c).alias("cell"), F.col(c).alias("f"))
        for i, c in enumerate(cells)])).alias("x"))
    return long.select(*table, "x.idx", "x.cell", "x.f.*")


def drop_empty_columns(grid: DataFrame, facts: list | None = None) -> DataFrame:
    """Keep the columns that hold text anywhere, the header included (for one table)."""
    cells = cell_columns(grid)
    rows = facts if facts is not None else column_facts(grid).collect()
    filled = {r.cell for r in rows if r.filled}
    return grid.drop(*[c for c in cells if c not in filled])


def _holds_number(texts: Column) -> Column:
    """Some cell looks like a number, a percentage or an amount: one search over the joined row."""
    return F.array_join(texts, "\x01").rlike(r"(?Ui)(?:^|\x01)(?:" + V.NUMERIC_LOOKING + r")(?=$|\x01)")


def classify_rows(grid: DataFrame, strict: bool = False, cells: list[str] | None = None) -> DataFrame:
    """Add ``row_type``: empty, title, data, header_candidate or ambiguous.

    Text that reads as a number makes a row a data row; with ``strict`` every cell is just text.
    """
    cells = cells or cell_columns(grid)
    n_filled = sum((F.col(c).isNotNull().cast("int") for c in cells), F.lit(0))
    stripped = F.array(*[text.blank_to_null(F.col(c)) for c in cells])
    facts = grid.select("*", n_filled.alias("_filled"), F.array_compact(stripped).alias("_texts")).select(
        "*", F.size(F.array_distinct("_texts")).alias("_unique"),
        F.lit(False).alias("_number") if strict else _holds_number(F.col("_texts")).alias("_number"))
    row_type = (
        F.when(F.col("_filled") == 0, "empty")
        .when(~F.col("_number") & (F.col("_unique") <= 2)
              & ((F.col("_filled") <= 2) | (F.col("_unique") == 1)), "title")
        .when(F.col("_number"), "data")
        .when((F.col("_unique") >= 2) & (F.col("_filled") >= 2), "header_candidate")
        .otherwise("ambiguous")
    )
    return facts.withColumn("row_type", row_type).drop("_filled", "_texts", "_unique", "_number")


def head_rows(grid: DataFrame, table: list[str] = TABLE, order: list[str] = ORDER) -> DataFrame:
    """The scanned head of every table with its ``row_no``. Each task keeps its own first rows
    before the shuffle, so a huge table sends few rows."""
    w = Window.partitionBy(*table).orderBy(*order)
    return grid.withColumn("row_no", F.row_number().over(w)).where(
        F.col("row_no") <= V.HEADER_SCAN_ROWS).withColumn("row_no", F.col("row_no") - 1)


def detect_header(rows: DataFrame, table: list[str] = TABLE) -> DataFrame:
    """``header_idx array<int>, data_start int, method`` per table, from typed head rows.

    The types of at most 30 rows are written as one word per table, a letter per row, and the
    rules are regular expressions over that word.
    """
    letter = F.upper(F.substring("row_type", 1, 1))
    word = rows.groupBy(*table).agg(F.concat_ws("", F.transform(
        F.array_sort(F.collect_list(F.struct("row_no", letter.alias("t")))), lambda x: x["t"])).alias("w"))

    def length(pattern: str, group: int) -> Column:
        return F.length(F.regexp_extract("w", pattern, group))

    # Lead of empty and title rows, ambiguous rows before the first header, then the header run.
    lead = r"^([ET]*A*)"
    run = r"(H[HA]{0,5})"
    n_run = length(lead + run, 2)
    first = length(lead + run, 1)
    long_run = n_run >= V.MAX_HEADER_ROWS
    n_header = F.when(long_run, 1).otherwise(n_run)
    after = first + n_header
    gap = F.length(F.regexp_extract(F.expr("substring(w, _after + 1)"), "^E*", 0))
    found = (F.col("_n") > 0) & (F.col("_after") + F.col("_gap") < F.length("w"))
    # Without a usable run: the row above the first data row, empty rows skipped.
    above = length(r"^([^D]*[^DE])E*D", 1) - 1
    first_data = length(r"^([^D]*)D", 1)
    fallback_hit = F.col("w").rlike(r"^[^D]*[^DE]E*D")
    several = F.length("w") > 1
    return (
        word.withColumn("_first", first).withColumn("_n", n_header).withColumn("_after", after)
        .withColumn("_gap", gap)
        .select(
            *table,
            F.when(found, F.sequence(F.col("_first"), F.col("_after") - 1))
            .when(fallback_hit, F.array(above))
            .when(several, F.array(F.lit(0)))
            .otherwise(F.array().cast("array<int>")).alias("header_idx"),
            F.when(found, F.col("_after") + F.col("_gap"))
            .when(fallback_hit, first_data)
            .when(several, 1).otherwise(0).alias("data_start"),
            F.when(found, "auto").otherwise("fallback").alias("method"),
        )
    )


def merge_header_rows(head: DataFrame, header: DataFrame, cells: list[str] | None = None,
                      table: list[str] = TABLE) -> DataFrame:
    """``table, cell, idx, header_text``: the distinct parts of the header rows, top to bottom."""
    cells = cells or cell_columns(head)
    chosen = head.join(header.select(*table, "header_idx"), table, "left").where(
        F.array_contains("header_idx", F.col("row_no")))
    parts = chosen.select(*table, "row_no", F.posexplode(
        F.array(*[text.blank_to_null(F.col(c)) for c in cells])).alias("idx", "part"))
    merged = parts.groupBy(*table, "idx").agg(F.nullif(F.array_join(F.array_distinct(F.array_compact(F.transform(
        F.array_sort(F.collect_list(F.struct("row_no", "part"))), lambda x: x["part"]))), " - "), F.lit(""))
        .alias("header_text"))
    return merged.withColumn("cell", F.element_at(F.array(*[F.lit(c) for c in cells]), F.col("idx") + 1))


def clean_column_names(names: DataFrame, ascii_names: bool = False) -> DataFrame:
    """``header_text`` at ``idx`` to ``name``."""
    return names.withColumn("name", text.column_name(F.col("header_text"), F.col("idx"), ascii_names))


def unique_names(names: DataFrame, table: list[str] = TABLE) -> DataFrame:
    """Give repeated names the smallest free suffix from ``_2`` on; ``idx`` order, per table.

    The names of one table, a short text per column, meet in a list and are walked through once.
    """
    # Local, so that it travels to the executors by value.
    @F.pandas_udf("array<string>")
    def distinct(lists: pd.Series) -> pd.Series:
        def one(wanted: list[str]) -> list[str]:
            taken, tried, out = set(), {}, []
            for name in wanted:
                unique = name
                while unique in taken:
                    tried[name] = tried.get(name, 1) + 1
                    unique = f"{name}_{tried[name]}"
                taken.add(unique)
                out.append(unique)
            return out
        return lists.map(one)

    lists = names.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("idx", "name"))).alias("n"))
    unique = lists.select(*table, F.explode(F.arrays_zip(
        F.transform("n", lambda x: x["idx"]).alias("i"), distinct(F.transform("n", lambda x: x["name"])).alias("u"))).alias("x"))
    return names.drop("name").join(
        unique.select(*table, F.col("x.i").alias("idx"), F.col("x.u").alias("name")), [*table, "idx"])


def data_rows(grid: DataFrame, starts: DataFrame, table: list[str] = TABLE,
              order: list[str] = ORDER) -> DataFrame:
    """Rows from the first data row on; ``starts`` has one row per table with its order key."""
    first = starts.select(*table, F.struct(*order).alias("_start"))
    return (
        grid.alias("l").join(first.alias("r"), null_safe("l", "r", table))
        .where(F.struct(*[F.col(f"l.{o}") for o in order]) >= F.col("r._start")).select("l.*")
    )


def fill_ditto(grid: DataFrame, cells: list[str], table: list[str] = TABLE, block: list[str] = ORDER[:1],
               order: list[str] = ORDER) -> DataFrame:
    """Replace ditto marks by the nearest cell above that is neither NULL nor a mark.

    Blocks are cut into pieces of rows by the last, numeric order column, as a block of short lines holds millions of them.
    """
    if not cells:
        return grid
    pieces = grid.withColumn("_piece", F.floor(F.col(order[-1]) / PIECE_ROWS))
    values = {f"_above_{c}": F.when(F.col(c).isNotNull() & ~text.is_ditto(F.col(c)), F.col(c)) for c in cells}
    filled = carried(pieces, values, table, [*block, "_piece"], order)
    return filled.select(*[
        F.when(text.is_ditto(F.col(c)), F.coalesce(F.col(f"_above_{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
        if c in cells else F.col(c) for c in grid.columns])
