"""Files to typed tables: one table, or a whole folder at once."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from gridsmith.functions import text
from gridsmith.operators import grid as G
from gridsmith.operators.cells import clean_cells
from gridsmith.operators.typing import apply_types, drop_duplicates, profile
from gridsmith.plans.submission import each
from gridsmith.session import fresh_path, staged
from gridsmith.sources.files import read_grid, read_grids, sniff_files
from gridsmith.sources.tables import catalog_name, is_published, publish, publish_together


@dataclass
class Shape:
    """What the driver keeps of a table: one short entry per column, no data rows."""

    names: dict[str, str] = field(default_factory=dict)
    start: tuple[int, int] | None = None
    method: str = "fallback"
    ditto: list[str] = field(default_factory=list)
    nfc: list[str] = field(default_factory=list)


def typed_head(grid: DataFrame, facts: DataFrame, strict: bool = False) -> DataFrame:
    """The head rows of every table, at most 30, with their type; empty columns count as NULL."""
    cells = G.cell_columns(grid)
    filled = facts.where("filled").groupBy("table_id").agg(F.collect_set("cell").alias("_filled"))
    head = G.head_rows(grid).join(filled, "table_id").select(
        "table_id", *G.ORDER, "row_no",
        *[F.when(F.array_contains("_filled", F.lit(c)), F.col(c)).alias(c) for c in cells])
    return G.classify_rows(head, strict, cells)


def header_names(head: DataFrame, header: DataFrame, facts: DataFrame, ascii_names: bool = False) -> DataFrame:
    """One row per table and surviving column with its final, unique name."""
    merged = G.merge_header_rows(head, header).select("table_id", "cell", "header_text")
    survivors = facts.where("filled").select(
        "table_id", "cell",
        (F.row_number().over(Window.partitionBy("table_id").orderBy("idx")) - 1).alias("idx"))
    names = survivors.join(merged, ["table_id", "cell"], "left")
    return G.unique_names(G.clean_column_names(names, ascii_names))


def table_shapes(grid: DataFrame, strict: bool = False, ascii_names: bool = False) -> dict[str, Shape]:
    """The shape of every table of the grid, from one scan for the column facts and one for the heads;
    the rest works on those two small tables."""
    facts = staged(G.column_facts(grid), "facts")
    head = staged(typed_head(grid, facts, strict), "head")
    header = staged(G.detect_header(head), "header")
    names = header_names(head, header, facts, ascii_names)
    shapes: dict[str, Shape] = {}
    for r in names.join(facts.select("table_id", "cell", "ditto", "nfc"), ["table_id", "cell"]).orderBy(
            "table_id", "idx").collect():
        shape = shapes.setdefault(r.table_id, Shape())
        shape.names[r.cell] = r.name
        if r.ditto:
            shape.ditto.append(r.cell)
        if r.nfc:
            shape.nfc.append(r.cell)
    at = F.max_by(F.struct(*G.ORDER), F.when(F.col("row_no") == F.col("data_start"), 1))
    starts = head.join(header, "table_id").groupBy("table_id", "method").agg(
        at.alias("start"), F.count(F.lit(1)).alias("n"))
    for r in starts.collect():
        shapes[r.table_id].method = r.method
        if r.n > 1 and r.start is not None:
            shapes[r.table_id].start = (r.start.block, r.start.seq)
    return shapes


def by_table(df: DataFrame, label: str, tables: list[str] | None = None) -> DataFrame:
    """Write rows to the shared folder, a subfolder per table, and read them back.

    Later passes are columnar, pruned to the table they want, and independent of the tasks that
    computed the rows. To part tables, each task sorts its rows; rows of a single one of known
    ``tables`` are written as they come.
    """
    keyed = df.withColumn("table_key", F.sha2("table_id", 256))
    path = fresh_path(df.sparkSession, label)
    if tables and len(tables) == 1:
        df.write.parquet(f"{path}/table_key={folder_key(tables[0])}")
    else:
        keyed.write.partitionBy("table_key").parquet(path)
    return df.sparkSession.read.schema(keyed.schema).parquet(path)


def stage_grid(grid: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """The non-empty rows: raw files are parsed once, and row numbers are fixed."""
    return by_table(G.drop_empty_rows(grid), "grid", tables)


def folder_key(table_id: str) -> str:
    """The subfolder in which :func:`by_table` keeps a table."""
    return hashlib.sha256(table_id.encode()).hexdigest()


def cleaned_rows(grid: DataFrame, shapes: dict[str, Shape]) -> DataFrame:
    """Data rows of all usable tables with ditto marks filled and cells cleaned.

    Tables take the way they need: only those with ditto marks pass the window and its shuffle, only
    those with text that NFC changes pass the Unicode step. A grid of :func:`by_table` is pruned to
    each way's folders, so every row is read once.
    """
    usable = {t: s for t, s in shapes.items() if s.start}
    cells = [c for c in G.cell_columns(grid) if any(c in s.names for s in usable.values())]
    ways: dict[tuple[bool, bool], dict[str, Shape]] = {}
    for t, s in usable.items():
        ways.setdefault((bool(s.ditto), bool(s.nfc)), {})[t] = s
    parts = []
    for _, tables in sorted(ways.items()):
        # An Arrow table is a relation whose size Spark knows. A list is not: the rows would be taken for the smaller side,
        # and broadcast or sorted by table in one task.
        starts = grid.sparkSession.createDataFrame(pa.table({
            "table_id": pa.array(list(tables), pa.string()), "block": pa.array([s.start[0] for s in tables.values()], pa.int64()),
            "seq": pa.array([s.start[1] for s in tables.values()], pa.int64())}))
        mine = grid
        if len(ways) > 1 and "table_key" in grid.columns:
            mine = grid.where(F.col("table_key").isin([folder_key(t) for t in tables]))
        rows = G.data_rows(mine.select("table_id", *G.ORDER, *cells), starts)
        rows = G.fill_ditto(rows, [c for c in cells if any(c in s.ditto for s in tables.values())])
        parts.append(clean_cells(rows, cells, [c for c in cells if any(c in s.nfc for s in tables.values())]))
    return reduce(DataFrame.unionByName, parts)


def typed_table(rows: DataFrame, shape: Shape, votes: list[Row], typed_dates: bool = False,
                typed_bools: bool = False, keep_order: bool = False) -> DataFrame:
    """One table's clean rows to its typed, deduplicated rows under the final names."""
    cells = list(shape.names)
    order = G.ORDER if keep_order else []
    typed = apply_types(rows.select(*order, *cells), votes, typed_dates, typed_bools)
    distinct = drop_duplicates(typed, cells, order or None)
    return distinct.select(*[F.col(c).alias(n) for c, n in shape.names.items()], *order)


def clean_table(spark: SparkSession, path: str, strict: bool = False, ascii_names: bool = False,
                bool_digits: bool = True, typed_dates: bool = False, typed_bools: bool = False,
                keep_order: bool = False) -> DataFrame:
    """One messy file to a typed table; no columns when there are no data rows.

    ``keep_order`` adds ``block, seq``, the place of each row's first copy in the file.
    """
    grid = stage_grid(read_grid(spark, path)).drop("table_key")
    shapes = table_shapes(grid, strict, ascii_names)
    usable = {t: s for t, s in shapes.items() if s.start}
    if not usable:
        return spark.createDataFrame([], "struct<>")
    (table_id, shape), = usable.items()
    # The votes and every later action read the clean cells; they are made once.
    rows = staged(cleaned_rows(grid, usable), "clean")
    votes = profile(rows, list(shape.names), bool_digits=bool_digits).collect()
    return typed_table(rows, shape, votes, typed_dates, typed_bools, keep_order)


STATUS = "path string, table_name string, status string, error string, n_columns int"


def clean_corpus(spark: SparkSession, path: str, target: str | None = None, overwrite: bool = False,
                 strict: bool = False, ascii_names: bool = False, bool_digits: bool = True,
                 keep_order: bool = True, workers: int = 4, database: str | None = None) -> DataFrame:
    """Clean and publish every file under ``path``; one status row per file.

    Sniffing, shapes and profiles are computed for all files of a width class in the same few jobs, so
    a wide file costs narrow ones nothing; tables of one schema (names, types, ways of writing) are written by one job. ``target`` is a folder;
    without it tables go to the catalog, to ``database`` or the current one, under names that it
    takes (a blank in a file's name becomes an underscore). A file that fails, a path that is not there, and a file
    whose table name an earlier one has are status rows; the others go on.
    """
    sniffed = sniff_files(spark, path).collect()

    def prepared(files: tuple[list[str], DataFrame]) -> tuple[dict[str, Shape], dict[str, list[Row]], DataFrame | None]:
        """Shapes, votes and clean rows of the tables of one width class."""
        grid = stage_grid(files[1], files[0])
        shapes = {t: s for t, s in table_shapes(grid.drop("table_key"), strict, ascii_names).items() if s.start}
        if not shapes:
            return {}, {}, None
        rows = by_table(cleaned_rows(grid, shapes), "clean", list(shapes))
        found: dict[str, list[Row]] = {}
        for v in profile(rows, G.cell_columns(rows), ["table_id"], bool_digits).collect():
            found.setdefault(v["table_id"], []).append(v)
        return shapes, found, rows

    usable: dict[str, Shape] = {}
    votes: dict[str, list[Row]] = {}
    clean: dict[str, tuple[int, DataFrame]] = {}  # the class of a file, and the clean rows of its class
    broken: dict[str, str] = {}
    for number, ((ids, _), result, error) in enumerate(each(read_grids(spark, sniffed), prepared, workers)):
        broken |= {i: error for i in ids} if error else {}
        if result:
            usable, votes = usable | result[0], votes | result[1]
            clean |= {t: (number, result[2]) for t in result[0]}
    named = spark.createDataFrame([(f["path"],) for f in sniffed], "path string").select(
        "path", text.table_name(F.col("path")).alias("name")).collect()
    names = {r["path"]: r["name"] if target else catalog_name(r["name"]) for r in named}
    # Equal names are settled before anything is written: the first file by path has it.
    owner: dict[str, str] = {}
    for f in sorted(sniffed, key=lambda f: f["path"]):
        if not f["error"]:
            owner.setdefault(names[f["path"]], f["path"])

    def usable_shape(file: Row) -> Shape:
        if file["error"]:
            raise ValueError(file["error"])
        first = owner[names[file["path"]]]
        if first != file["path"]:
            raise ValueError(f"table name {names[file['path']]} is taken by {first}")
        if file["file_id"] in broken:
            raise ValueError(broken[file["file_id"]])
        shape = usable.get(file["file_id"])
        if shape is None:
            raise ValueError(f"no data after cleaning: {names[file['path']]}")
        return shape

    def write(file: Row) -> tuple[str, int]:
        """One table by a job of its own."""
        shape = usable_shape(file)
        mine = clean[file["file_id"]][1].where(F.col("table_key") == folder_key(file["file_id"])).drop("table_key")
        table = typed_table(mine, shape, votes[file["file_id"]], keep_order=keep_order)
        name = names[file["path"]]
        status = publish(table, f"{database}.{name}" if database else name, overwrite, f"{target}/{name}" if target else None,
                         G.ORDER if keep_order else None)
        return status, len(shape.names)

    def write_together(files: list[Row]) -> dict[str, tuple[str, int] | str]:
        """Tables of one schema by one job: per path its status and width, or what failed."""
        keys = {folder_key(f["file_id"]): f for f in files}
        shape, n_columns = usable[files[0]["file_id"]], len(usable[files[0]["file_id"]].names)
        key = "table_key"
        while key in shape.names.values():
            key += "_"
        mine = clean[files[0]["file_id"]][1].where(F.col("table_key").isin(list(keys)))
        order = G.ORDER if keep_order else []
        typed = apply_types(mine.select("table_key", *order, *shape.names), votes[files[0]["file_id"]])
        distinct = drop_duplicates(typed, list(shape.names), order or None, ["table_key"])
        rows = distinct.select(F.col("table_key").alias(key), *[F.col(c).alias(n) for c, n in shape.names.items()], *order)
        errors = publish_together(rows, key, {k: f"{target}/{names[f['path']]}" for k, f in keys.items()}, order)
        return {f["path"]: f"{errors[k]}: {names[f['path']]}" if k in errors else ("published", n_columns) for k, f in keys.items()}

    together: dict[tuple, list[Row]] = {}
    for file in sniffed if target else []:
        shape = usable.get(file["file_id"])
        if shape is None or file["error"] or owner[names[file["path"]]] != file["path"] or (
                not overwrite and is_published(spark, f"{target}/{names[file['path']]}")):
            continue
        kinds = tuple(sorted((v["column"], v["type"], v["style"], v["has_time"]) for v in votes[file["file_id"]] if v["column"] in shape.names))
        together.setdefault((clean[file["file_id"]][0], tuple(shape.names.items()), kinds), []).append(file)
    written: dict[str, tuple[str, int] | str] = {}
    for _, found, _ in each([files for files in together.values() if len(files) > 1], write_together, workers):
        # A job that failed leaves its tables to jobs of their own, so one bad table is one bad row.
        written |= found or {}
    alone = [f for f in sniffed if f["path"] not in written]
    done = each(alone, write, workers)
    rows = [(f["path"], names[f["path"]], r[0] if r else "failed", e, r[1] if r else None) for f, r, e in done]
    rows += [(p, names[p], "failed", r, None) if isinstance(r, str) else (p, names[p], r[0], None, r[1]) for p, r in written.items()]
    return spark.createDataFrame(rows, STATUS)
