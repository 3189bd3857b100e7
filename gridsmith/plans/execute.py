"""Run sets of SQL texts; answers are tables, errors are values."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import islice
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from gridsmith.operators.ordering import null_safe
from gridsmith.operators.questions import gold_sql
from gridsmith.plans.submission import each
from gridsmith.session import fresh_path, staged
from gridsmith.sources.tables import stored_place

CELLS = "query bigint, part string, seq bigint, col_idx int, num double, str string"
ALL_CELLS = ("SELECT query, part, seq, col_idx, cell.num, cell.str FROM ("
             "SELECT query, part, seq, posexplode(cells) AS (col_idx, cell) FROM ({}))")
STATUS = "query bigint, db_id string, sql string, n_cols int, error string"
CHUNK = 1024  # statements that the driver holds at once
PACK = 64  # short statements of one database that share a job
ALIKE = 16  # so many statements of one shape share jobs of their own
SHAPES = 10_000  # shapes with failures that the driver remembers
SHORT_JOBS = 4  # short jobs that are submitted in place of a long one
SHORT_BYTES = 64 << 20  # what a short statement reads, and the most its result is estimated to have
SMALL_BYTES = 8 << 20  # what a small statement reads and gives: its rows take less time than the compiling of code for them
# Small statements run many at once: no code is compiled for them, and a table is not split.
SMALL = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.files.minPartitionNum": "1",
         "spark.sql.files.maxPartitionBytes": str(SMALL_BYTES), "spark.sql.files.openCostInBytes": str(64 << 10)}
SCAN_NODES = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}
SHARED_SETTINGS = ["spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions"]


def cell_value(name: str, dtype: str) -> str:
    """A result cell as ``struct(num, str)`` in SQL: numbers and booleans in ``num``, all else in ``str``."""
    numeric = dtype in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal")
    if numeric:
        return f"named_struct('num', CAST({name} AS DOUBLE), 'str', CAST(NULL AS STRING))"
    nested = dtype.startswith(("array", "map", "struct"))
    text = f"to_json({name})" if nested else f"CAST({name} AS STRING)"
    return f"named_struct('num', CAST(NULL AS DOUBLE), 'str', {text})"


class Database(NamedTuple):
    """Two sessions with the same views: one for any statement, one in which small ones run."""

    session: SparkSession
    small: SparkSession


def open_database(spark: SparkSession, tables: dict[str, str]) -> Database:
    """Sessions of their own with the tables as temporary views; ``tables`` maps name to Parquet path.

    For small statements a table is one partition, so that their rows pass no exchange.
    """
    opened = Database(spark.newSession(), spark.newSession())
    for session in opened:
        for key in SHARED_SETTINGS:
            session.conf.set(key, spark.conf.get(key))
    for key, value in SMALL.items():
        opened.small.conf.set(key, value)
    for name, path in tables.items():
        view = opened.session.read.parquet(path)
        view.createOrReplaceTempView(name)
        opened.small.read.schema(view.schema).parquet(path).coalesce(1).createOrReplaceTempView(name)
    for session in opened:
        session.conf.set("spark.sql.runSQLOnFiles", "false")
    return opened


# What a last semicolon may be followed by, and the texts in which one means nothing.
LEXEMES = re.compile(r"""(?P<blank>\s+|--[^\n]*|/\*.*?\*/)|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|.""", re.DOTALL)


def as_query(sql: str) -> str:
    """The text as a subquery: a statement that is no query cannot be parsed there. A last semicolon
    is cut, also one before comments."""
    end = None
    for m in LEXEMES.finditer(sql):
        if m.group("blank") is None:
            end = (m.start() if end is None else end) if m.group() == ";" else None
    return f"SELECT * FROM (\n{sql[:end].strip()}\n)"


def plan_leaves(plan) -> list:
    """All leaves of an analysed plan, those of subqueries in expressions included. Few calls: each is a round trip to the JVM."""
    inner = plan.subqueriesAll()
    leaves = [p.collectLeaves() for p in [plan, *[inner.apply(i) for i in range(inner.size())]]]
    return [group.apply(i) for group in leaves for i in range(group.size())]


def only_scans(plan) -> bool:
    """Whether a plan with one leaf is a chain of nodes that scan, filter and project."""
    while (kind := plan.nodeName()) in SCAN_NODES:
        if kind == "LogicalRelation":
            return True
        plan = plan.children().head()
    return False


def analysed(session: SparkSession, sql: str) -> tuple[DataFrame, bool, int]:
    """The statement as a DataFrame, whether it only scans, filters and projects one table, and the bytes
    it reads or is estimated to give, whichever are more.

    Its tables must be the database's own: no files and no tables of other databases.
    """
    result = DataFrame(session._jsparkSession.sql(as_query(sql)), session)
    execution = result._jdf.queryExecution()
    plan = execution.analyzed()
    leaves = plan_leaves(plan)
    for leaf in leaves:
        kind = leaf.nodeName()
        if kind == "HiveTableRelation" or kind == "LogicalRelation" and leaf.catalogTable().isDefined():
            raise PermissionError("the statement reads a table of another database")
    weight = max(plan.stats().sizeInBytes(), sum(leaf.stats().sizeInBytes() for leaf in leaves))
    if weight >= SMALL_BYTES:  # before it is optimised a plan carries all columns
        plan_run = execution.optimizedPlan()
        read = plan_run.collectLeaves()
        weight = max(plan_run.stats().sizeInBytes(), sum(read.apply(i).stats().sizeInBytes() for i in range(read.size())))
    return result, len(leaves) == 1 and only_scans(plan), weight


LITERAL = re.compile(r"""(?P<name>`[^`]*`)|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\b\d[\w.]*""", re.DOTALL)


def shape(db_id: str, sql: str) -> int:
    """A number that statements of a database share which differ in numbers and quoted texts only."""
    return hash((db_id, LITERAL.sub(lambda m: m.group("name") or "?", sql)))


class Prepared(NamedTuple):
    """A statement that could be analysed: its rows of cells as a query not yet run."""

    number: int
    db_id: str
    cells: str
    n_cols: int
    weight: int
    shape: int

    @property
    def short(self) -> bool:
        """Whether it reads little and is estimated to give little, so that it may share a job with others."""
        return self.weight < SHORT_BYTES

    @property
    def small(self) -> bool:
        return self.weight < min(SMALL_BYTES, SHORT_BYTES)


def statement_cells(session: SparkSession, number: int, db_id: str, sql: str) -> Prepared:
    """A statement's rows as arrays of cells, with what keeps them in their place."""
    result, scan, weight = analysed(session, sql)
    kinds = [kind for _, kind in result.dtypes]
    names = ", ".join(f"c{i}" for i in range(len(kinds)))
    cells = ", ".join(cell_value(f"c{i}", kind) for i, kind in enumerate(kinds))
    # The id is partition number and row number in one: rows keep their place in the result.
    part = (stored_place("input_file_name()", "input_file_block_start()") if scan
            else "lpad(CAST(shiftright(monotonically_increasing_id(), 33) AS STRING), 20, '0')")
    rows = (f"SELECT CAST({number} AS BIGINT) AS query, {part} AS part, monotonically_increasing_id() AS seq, array({cells}) AS cells "
            f"FROM ({as_query(sql)}) AS t({names})")
    return Prepared(number, db_id, rows, len(kinds), weight, shape(db_id, sql))


def pack_size(ran: int, failed: int) -> int:
    """How many short statements share a job, by how many have failed so far: what costs fewest jobs if each fails by itself."""
    return min(PACK, max(1, round((ran / failed) ** 0.5))) if failed else PACK


def packs(statements: list[Prepared], most: Callable[[Prepared], int]) -> list[list[Prepared]]:
    """Statements of a database and of a kind that run as one job each, ``most`` of a statement's shape at the most.

    ``ALIKE`` or more statements of one shape share jobs of their own, as they tend to fail together.
    """
    by_shape: dict[int, list[Prepared]] = {}
    for s in statements:
        by_shape.setdefault(s.shape, []).append(s)
    found, mixed = [], []
    for group in by_shape.values():
        if len(group) >= ALIKE or most(group[0]) == 1:
            n = most(group[0])
            found += [group[i:i + n] for i in range(0, len(group), n)]
        else:
            mixed += group
    mixed.sort(key=most, reverse=True)
    while mixed:
        n = next((i for i in range(1, len(mixed)) if i >= most(mixed[i])), len(mixed))
        found, mixed = found + [mixed[:n]], mixed[n:]
    return found


class Failures:
    """How many short statements ran and failed, by shape for those of whose shape one has failed, else all together."""

    def __init__(self) -> None:
        self.ran, self.failed = 0, 0
        self.shapes: dict[int, list[int]] = {}

    def most(self, s: Prepared) -> int:
        return pack_size(*self.shapes.get(s.shape, (self.ran, self.failed)))

    def add(self, ended: list[tuple[Prepared, bool]]) -> None:
        ran, failed = Counter(s.shape for s, _ in ended), Counter(s.shape for s, wrong in ended if wrong)
        for key, n in ran.items():
            if key in self.shapes:
                self.shapes[key][0] += n
                self.shapes[key][1] += failed[key]
            elif key in failed:
                self.failed += 1
                self.ran += 1
                self.shapes[key] = [n, failed[key]]
            else:
                self.ran += n
        for key in list(self.shapes)[:-SHAPES]:
            del self.shapes[key]


def run_queries(spark: SparkSession, queries: DataFrame, databases: dict[str, dict[str, str]],
                workers: int = 4) -> tuple[DataFrame, DataFrame]:
    """Run ``instance_id, db_id, sql`` and return ``(answers, cells)``.

    ``answers`` is ``instance_id, n_rows, n_cols, error``; ``cells`` is ``instance_id, row_idx, col_idx,
    num, str`` with rows in result order; a statement that only scans, filters and projects gives its
    rows in the order in which the table stores them, whichever task reads which file. Every distinct text runs once, distributed, and writes its
    cells to the shared folder. Short statements of a database share a job; if it fails, its halves
    run again, down to the statement whose error it is, or each statement alone where both halves fail; the more statements
    of a shape (the text without its numbers and quoted texts) have failed, the fewer of them share a job. Small ones are
    run without code of their own, as compiling it takes longer than their rows. Short jobs keep the driver busier than the tasks, so
    ``SHORT_JOBS`` times as many are submitted at once. The driver reads the texts in chunks and appends their status
    to a table: it holds one chunk, a folder's name per job and the counts of up to ``SHAPES`` shapes, and no result row.
    """
    base, statuses = fresh_path(spark, "answers"), fresh_path(spark, "statuses")
    opened = {d: s for d, s, e in each(sorted(databases), lambda d: open_database(spark, databases[d]), workers) if not e}
    texts = staged(queries.select("db_id", "sql").distinct().withColumn("number", F.monotonically_increasing_id()), "texts")
    folders: list[str] = []

    def prepared(r: Row) -> Prepared:
        if r["db_id"] not in opened:
            raise LookupError(f"database not found: {r['db_id']}")
        return statement_cells(opened[r["db_id"]].session, r["number"], r["db_id"], r["sql"])

    def write(pack: list[Prepared]) -> str:
        folder, text = f"{base}/{pack[0].number}-{len(pack)}", ALL_CELLS.format(" UNION ALL ".join(s.cells for s in pack))
        if pack[0].small:
            # Results share files, else each statement makes one.
            opened[pack[0].db_id].small.sql(text).coalesce(-(-len(pack) // 8)).write.parquet(folder)
        else:
            opened[pack[0].db_id].session.sql(text).write.parquet(folder)
        return folder

    def run(jobs: list[list[Prepared]], at_once: int) -> list[tuple[list[Prepared], str | None, str | None]]:
        ended, parents = [], list(range(len(jobs)))
        while jobs:
            done = each(jobs, write, at_once)
            ended += [d for d in done if d[2] is None or len(d[0]) == 1]
            failed = Counter(parent for d, parent in zip(done, parents) if d[2])
            again = [(d[0], parent) for d, parent in zip(done, parents) if d[2] and len(d[0]) > 1]
            cut = [(pack[i:i + n], number) for number, (pack, parent) in enumerate(again)
                   for n in [1 if failed[parent] > 1 else -(-len(pack) // 2)] for i in range(0, len(pack), n)]
            jobs, parents = [pack for pack, _ in cut], [number for _, number in cut]
        return ended

    # An empty table first, for the case that there is no statement.
    spark.createDataFrame([], STATUS).write.parquet(statuses)
    failures = Failures()
    waiting = texts.toLocalIterator()
    while chunk := list(islice(waiting, CHUNK)):
        ready = each(chunk, prepared, workers)
        good = [s for _, s, error in ready if error is None]
        done = run([[s] for s in good if not s.short], workers)
        for small in (False, True):
            jobs = [pack for d in opened for pack in packs(
                [s for s in good if s.short and s.db_id == d and s.small == small], failures.most)]
            done += run(jobs, workers * SHORT_JOBS)
        failures.add([(s, bool(error)) for pack, _, error in done for s in pack if s.short])
        folders += [folder for _, folder, error in done if error is None]
        failed = {pack[0].number: error for pack, _, error in done if error}
        rows = [(r["number"], r["db_id"], r["sql"], s.n_cols if s and r["number"] not in failed else None,
                 error or failed.get(r["number"])) for r, s, error in ready]
        spark.createDataFrame(rows, STATUS).coalesce(1).write.mode("append").parquet(statuses)
    status = spark.read.schema(STATUS).parquet(statuses)
    written = spark.read.schema(CELLS).parquet(*folders) if folders else spark.createDataFrame([], CELLS)
    per_part = written.where("col_idx = 0").groupBy("query", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("least"))
    before = Window.partitionBy("query").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per statement and split, staged so that its size is known: it is broadcast if it is small, and cells are never
    # gathered by statement.
    offsets = staged(per_part.select(
        "query", "part", "n", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("off")), "offsets")
    sizes = offsets.groupBy("query").agg(F.sum("n").alias("n_rows"))
    tagged = queries.select("instance_id", "db_id", "sql").alias("l").join(
        status.alias("r"), null_safe("l", "r", ["db_id", "sql"])).select("l.instance_id", "r.query", "r.n_cols", "r.error")
    answers = tagged.join(sizes, "query", "left").select(
        "instance_id",
        F.when(F.col("error").isNull(), F.coalesce("n_rows", F.lit(0))).alias("n_rows"),
        F.when(F.col("error").isNull(), F.col("n_cols")).alias("n_cols"), "error")
    places = staged(offsets.join(tagged.select("instance_id", "query"), "query").select("instance_id", "query", "part", "off"), "places")
    cells = written.join(places, ["query", "part"]).select(
        "instance_id", (F.col("off") + F.col("seq")).alias("row_idx"), "col_idx", "num", "str")
    return answers, cells


def gold_answers(spark: SparkSession, questions: DataFrame, databases: dict[str, dict[str, str]],
                 workers: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(answers, cells, summary)`` of the gold statements; ``answers`` keeps the question's ``pos``.

    ``summary`` is one row: questions with a statement, without one, failed, and the first ten errors.
    """
    gold = gold_sql(questions)
    runnable = gold.where(F.col("gold").isNotNull()).select("instance_id", "pos", "db_id", F.col("gold").alias("sql"))
    # Ids may repeat in a question file, positions may not.
    answers, cells = run_queries(
        spark, runnable.select(F.col("pos").alias("instance_id"), "db_id", "sql"), databases, workers)
    answers = answers.withColumnRenamed("instance_id", "pos").join(runnable.select("instance_id", "pos"), "pos")
    cells = cells.withColumnRenamed("instance_id", "pos")
    first = answers.where(F.col("error").isNotNull()).orderBy("pos").limit(10).select(
        "pos", F.concat_ws(": ", "instance_id", "error").alias("text"))
    summary = (
        gold.select("pos", "gold").join(answers.select("pos", "error"), "pos", "left").join(first, "pos", "left")
        .agg(
            F.count("gold").alias("n_gold"), F.count_if(F.col("gold").isNull()).alias("n_missing"),
            F.count("error").alias("n_errors"),
            # At most ten texts reach this list.
            F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))),
                        lambda x: x["text"]).alias("first_errors")))
    return answers, cells, summary
