"""Raw grids from delimited files of unknown encoding, delimiter and width."""

from __future__ import annotations

import csv
import re
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsmith.functions import vocabulary as V
from gridsmith.session import staged
from gridsmith.sources.spans import quoted_records, read_pieces

HEAD_LINES = 1000
NARROW = 16  # columns up to which all tables share a grid

# Windows-1252 is not a charset of the CSV reader. It is read as Latin-1 and the 32 control
# positions are then mapped to the characters that Windows-1252 has there.
WHOLE_FILE_BLOCK_ROWS = 1_000_000
LATIN1_CONTROLS = bytes(range(0x80, 0xA0)).decode("latin-1")
WINDOWS_CHARACTERS = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")
BYTE_ORDER_MARK = "\ufeff"


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_id, uri, path, error`` of the files under a path, empty ones included; nothing is read.

    Each requested path is listed on its own: one that is not there is a row with an error.
    """
    listed: list[tuple[str, str, str | None]] = []
    for one in [path] if isinstance(path, str) else path:
        try:
            listed += [(name, unquote(name), None) for name in spark.read.format("binaryFile").load(one).inputFiles()]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            listed.append((one, one, f"file not found: {one}"))
    named = spark.createDataFrame(listed, "uri string, path string, error string")
    # The file names that scans report have a single slash after the scheme of local files.
    return named.select(F.regexp_replace("uri", "^file:/+", "file:/").alias("file_id"), "uri", "path", "error")


def _count(text: Column | str, char: str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def delimiters_outside_quotes(text: str, sep: str) -> Column:
    """How often a delimiter stands outside quoted cells.

    A quoted cell opens and closes next to a delimiter or an end. A quote mark anywhere else is
    text, and so is what follows it: then a line may count too wide, never too narrow.
    """
    edge = re.escape(sep)
    cell = rf'(?<=^|{edge})[ \t]*"[^"]*+(?:""[^"]*+)*+"(?={edge}|$)'
    bare = F.when(F.contains(text, F.lit('"')), F.regexp_replace(text, cell, "")).otherwise(F.col(text))
    # Most delimiters stand nowhere in a line: it is not searched for cells then.
    return F.when(~F.contains(text, F.lit(sep)), 0).otherwise(_count(bare, sep))


def line_facts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per file: whether it begins with a byte order mark of UTF-16, whether it is UTF-8 throughout, whether a quoted cell spans lines,
    and per delimiter the most fields of a line and the evidence for it.

    Evidence is how many lines agree on the delimiter's number; where cells span lines, and lines
    are no records, how often it stands beside a quote mark.

    One scan of the raw text serves all: lines are counted by file and delimiter counts first, a
    few short rows per file and task. A line with an odd number of quote marks opens or closes a
    cell that spans lines. All that is combined is numbers, which a hash table takes: bytes or a struct
    would have every task sort all lines of its split first.
    """
    counts = [f"n{i}" for i in range(len(V.DELIMITERS))]
    beside = [f"q{i}" for i in range(len(V.DELIMITERS))]
    at_quotes = lambda d: _count("value", f'"{d}') / 2 + _count("value", f'{d}"') / 2
    # Signs of UTF-16 have a zero byte before or behind them, which would part delimiters from quote marks.
    # The first split of a file is read by one task, whose row numbers are the lower 33 bits of the id.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    mark = F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).isin("FFFE", "FEFF").cast("int")
    bare = F.when(F.contains("value", F.lit("\0")), F.translate("value", "\0", "")).otherwise(F.col("value"))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.when(F.col("_metadata.file_block_start") == 0, row * 2 + mark).alias("head"),
        F.is_valid_utf8("value").alias("valid"), bare.alias("value")).select(
        "file_id", "head", "valid", "value",
        *[delimiters_outside_quotes("value", d).alias(n) for n, d in zip(counts, V.DELIMITERS, strict=True)])
    kinds = lines.groupBy("file_id", *counts).agg(
        *[F.sum(at_quotes(d)).alias(q) for q, d in zip(beside, V.DELIMITERS, strict=True)],
        F.count(F.lit(1)).alias("lines"), F.bool_and("valid").alias("utf8"),
        F.bool_or(_count("value", '"') % 2 == 1).alias("odd"),
        F.min("head").alias("head"))
    one = kinds.groupBy("file_id").agg(
        F.bool_and("utf8").alias("utf8"), F.bool_or("odd").alias("quoted_newlines"),
        (F.min("head") % 2 == 1).alias("marked"),
        *[(F.max(n) + 1).alias(f"w{i}") for i, n in enumerate(counts)])
    votes = kinds.select("file_id", "lines", F.posexplode(F.array(*counts)).alias("sep", "n"))
    agreed = votes.groupBy("file_id", "sep", "n").agg(F.sum("lines").alias("lines")).groupBy("file_id", "sep").agg(
        F.max(F.when(F.col("n") > 0, F.col("lines"))).alias("lines"))
    quoted = kinds.select("file_id", F.posexplode(F.array(*beside)).alias("sep", "q")).groupBy("file_id", "sep").agg(
        F.sum("q").alias("q"))
    odd = kinds.groupBy("file_id").agg(F.bool_or("odd").alias("odd"))
    both = agreed.join(quoted, ["file_id", "sep"]).join(odd, "file_id")
    evidence = F.when(F.col("odd") & (F.col("q") > 0), F.col("q")).when(~F.col("odd"), F.col("lines").cast("double"))
    best = both.withColumn("evidence", evidence).where("evidence IS NOT NULL").groupBy("file_id").agg(
        F.map_from_entries(F.collect_list(F.struct("sep", "evidence"))).alias("agreed"))
    return one.join(best, "file_id", "left")


def head_choice(head: Column) -> Column:
    """The delimiter that the first characters of a file suggest; a comma if they suggest none."""
    n_chars, delimiters = V.DELIMITER_SAMPLE_CHARS, V.DELIMITERS

    # Local, so that it travels to the executors by value.
    @F.pandas_udf("string")
    def sniff(heads: pd.Series) -> pd.Series:
        def one(sample: str) -> str:
            try:
                return csv.Sniffer().sniff(sample[:n_chars].lstrip("\ufeff"), delimiters=delimiters).delimiter
            except csv.Error:
                return ","
        return heads.map(one)

    return sniff(head)


def head_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file_id, head``: the first lines of each file. Each task keeps its own before the shuffle."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.substring("value", 1, V.DELIMITER_SAMPLE_CHARS).alias("value"))
    w = Window.partitionBy("file_id").orderBy("block", "seq")
    first = lines.withColumn("n", F.row_number().over(w)).where(F.col("n") <= HEAD_LINES)
    return first.groupBy("file_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n").alias("head"))


def sniff_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_id, path, encoding, sep, quoted_newlines, width, error`` per file and per missing path.

    Encoding: UTF-16 by its byte order mark, UTF-8 if all of the file is, else Windows-1252. The
    delimiter is the one with most evidence in the whole file; where several are equal, what the head of the file suggests if it is among them, else the first of the list.
    """
    listed = list_files(spark, path)
    paths = [r["path"] for r in listed.where("error IS NULL").collect()]
    if not paths:
        return listed.select("file_id", "path", F.lit("UTF-8").alias("encoding"), F.lit(",").alias("sep"),
                             F.lit(False).alias("quoted_newlines"), F.lit(0).alias("width"), "error")
    facts = staged(line_facts(spark, paths), "facts")
    most = F.array_max(F.map_values("agreed"))
    tied = F.map_keys(F.map_filter("agreed", lambda _, evidence: evidence == most))
    evidence = staged(listed.join(facts, "file_id", "left").withColumn("tied", F.array_sort(tied)), "evidence")
    unclear = [r["path"] for r in evidence.where(F.size("tied") > 1).select("path").collect()]
    if unclear:
        heads = head_texts(spark, unclear).select("file_id", head_choice(F.col("head")).alias("choice"))
        evidence = evidence.join(heads, "file_id", "left")
    else:
        evidence = evidence.withColumn("choice", F.lit(None).cast("string"))
    names = F.array(*[F.lit(d) for d in V.DELIMITERS])
    chosen = F.when(F.array_contains("tied", F.array_position(names, F.col("choice")).cast("int") - 1), F.col("choice")).otherwise(
        F.coalesce(F.get(names, F.get(F.col("tied"), F.lit(0))), F.lit(",")))
    marked = F.coalesce("marked", F.lit(False))
    encoding = F.when(marked, "UTF-16").when(F.col("utf8") | F.col("utf8").isNull(), "UTF-8").otherwise("cp1252")
    width = F.coalesce(*[F.when(F.col("sep") == d, F.col(f"w{i}")) for i, d in enumerate(V.DELIMITERS)])
    return evidence.withColumn("sep", chosen).select(
        "file_id", "path", encoding.alias("encoding"), "sep",
        F.coalesce("quoted_newlines", F.lit(False)).alias("quoted_newlines"),
        F.coalesce(width, F.lit(0)).alias("width"), "error")


def _reader(spark: SparkSession, encoding: str, sep: str, whole_files: bool):
    return (
        spark.read.option("sep", sep).option("header", False).option("escape", '"')
        .option("encoding", "ISO-8859-1" if encoding == "cp1252" else encoding)
        .option("multiLine", whole_files).option("maxColumns", 1_000_000)
    )


def _record_widths(spark: SparkSession, paths: list[str], encoding: str, sep: str) -> dict[str, int]:
    """Per file the most fields of a record that may span lines: records wider than the schema come back whole."""
    records = (
        _reader(spark, encoding, sep, True).option("columnNameOfCorruptRecord", "whole")
        .schema("c0 string, whole string").csv(paths))
    widths = records.select(F.col("_metadata.file_path").alias("table_id"), "c0", (delimiters_outside_quotes("whole", sep) + 1).alias("n")).groupBy(
        "table_id").agg(F.max("n").alias("n"), F.count("c0").alias("records"))
    return {r["table_id"]: r["n"] or 1 for r in widths.collect()}


def _quoted_records(spark: SparkSession, paths: list[str], encoding: str, sep: str) -> tuple[DataFrame, dict[str, int]]:
    """``table_id, block, seq, record`` of files with cells over several lines, read in splits, and the width of each file."""
    raw = read_pieces(spark, paths, "\n")
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1") if encoding == "cp1252" else F.col("value")
    # Line ends of two characters count as one, in cells too.
    lines = raw.withColumn("value", F.regexp_replace(text, "\r$", ""))
    records = staged(quoted_records(lines, sep).where(F.trim("record") != ""), "records")
    widths = records.groupBy("table_id").agg(F.max(delimiters_outside_quotes("record", sep) + 1).alias("n"))
    return records, {r["table_id"]: r["n"] or 1 for r in widths.collect()}


def width_class(width: int) -> int:
    """Tables of one class share a grid: those of up to 16 columns, then up to 64, 256 and so on."""
    step = 0
    while width > NARROW << 2 * step:
        step += 1
    return step


def _cell(name: str, encoding: str) -> Column:
    c = F.col(name)
    if encoding == "cp1252":
        c = F.translate(c, LATIN1_CONTROLS, WINDOWS_CHARACTERS)
    if name == "c0":
        c = F.ltrim(c, F.lit(BYTE_ORDER_MARK))
    return F.nullif(c, F.lit("")).alias(name)


def _grid_parts(spark: SparkSession, sniffed: list, apart: bool) -> list[tuple[int, list[str], DataFrame]]:
    """``(width class, files, grid)``: one scan per encoding and delimiter, and per width class if they are kept ``apart``."""
    groups: dict[tuple, list] = {}
    for f in sniffed:
        if f["error"] is None and f["width"]:
            # UTF-16 cannot be split at line ends by the reader; other files are, and records put together.
            whole = f["quoted_newlines"] or f["encoding"] == "UTF-16"
            groups.setdefault((f["encoding"], f["sep"], whole), []).append(f)
    parts = []
    for (encoding, sep, whole), files in sorted(groups.items()):
        paths = [f["path"] for f in files]
        in_splits = whole and encoding != "UTF-16"
        found: dict[str, int] = {}
        if in_splits:
            records, found = _quoted_records(spark, paths, encoding, sep)
        elif whole:
            found = _record_widths(spark, paths, encoding, sep)
        widths = {f["file_id"]: max(f["width"], found.get(f["file_id"], 1)) for f in files}
        classes: dict[int, list] = {}
        for f in files:
            classes.setdefault(width_class(widths[f["file_id"]]) if apart else 0, []).append(f)
        for step, mine in sorted(classes.items()):
            ids = [f["file_id"] for f in mine]
            cells = [f"c{i}" for i in range(max(widths[i] for i in ids))]
            schema = ", ".join(f"{c} string" for c in cells)
            if in_splits:
                rows = records.where(F.col("table_id").isin(ids)) if len(classes) > 1 else records
                options = {"sep": sep, "escape": '"', "maxColumns": "1000000"}
                grid = rows.select("table_id", "block", "seq", F.from_csv("record", F.lit(schema), options).alias("cells")).select(
                    "table_id", "block", "seq", "cells.*")
                place = [F.col(c) for c in ("table_id", "block", "seq")]
            else:
                grid = _reader(spark, encoding, sep, whole).schema(schema).csv([f["path"] for f in mine])
                seq = F.monotonically_increasing_id()
                # A file that cannot be split is cut into blocks of rows instead of bytes.
                row_block = F.floor(seq.bitwiseAND(F.lit((1 << 33) - 1)) / WHOLE_FILE_BLOCK_ROWS)
                place = [F.col("_metadata.file_path").alias("table_id"),
                         (row_block if whole else F.col("_metadata.file_block_start")).alias("block"), seq.alias("seq")]
            parts.append((step, ids, grid.select(*place, *[_cell(c, encoding) for c in cells])))
    return parts


def _one_grid(parts: list[DataFrame]) -> DataFrame:
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    ordered = sorted((c for c in out.columns if c not in ("table_id", "block", "seq")), key=lambda c: int(c[1:]))
    return out.select("table_id", "block", "seq", *ordered)


def read_grid(spark: SparkSession, path: str | list[str], sniffed: list | None = None) -> DataFrame:
    """``table_id, block, seq, c0..cN`` for all files: one scan per encoding and delimiter.

    ``table_id`` is the file, ``block`` the byte offset of the split (or a block of rows) and ``seq`` rises within it, so
    ``(block, seq)`` is the row order of the file although many tasks read it. The width is given
    to the reader, which would otherwise take it from the first row, often a title; surplus
    columns turn out empty and are dropped later.
    """
    rows = sniffed if sniffed is not None else sniff_files(spark, path).collect()
    parts = [grid for _, _, grid in _grid_parts(spark, rows, False)]
    return _one_grid(parts) if parts else spark.createDataFrame([], "table_id string, block bigint, seq bigint, c0 string")


def read_grids(spark: SparkSession, sniffed: list) -> list[tuple[list[str], DataFrame]]:
    """``(files, grid)`` per width class, each grid as by :func:`read_grid`.

    No file carries more than four times its own columns (sixteen if it has fewer), however wide another
    one is; there are as many grids as powers of four between the narrowest and the widest.
    """
    classes: dict[int, list] = {}
    for step, ids, grid in _grid_parts(spark, sniffed, True):
        classes.setdefault(step, []).append((ids, grid))
    return [([i for ids, _ in parts for i in ids], _one_grid([grid for _, grid in parts])) for _, parts in sorted(classes.items())]
