"""Grid shaping: one small grid per customer, made of that customer's orders under title and header
rows, and events with blank rows, blank columns and ditto marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from bindings.registry import case, query, wide, vn_text
from gridsmith.functions import vocabulary as V
from gridsmith.operators import grid as G
from gridsmith.plans.cleaning import header_names, typed_head
from gridsmith.session import staged

FIRST = ["Mã", "Khách", "Giá", "Ngày", "Giá"]
SECOND = ["đơn", "Khách", "bán", "đặt", "mua"]


def customer_grids(spark, sf):
    """Customers by key modulo 4: title and header; title and two header rows; title only; header and
    an empty row. Data rows follow in order-key order."""
    orders = wide(spark, sf, "orders")
    kind = F.col("o_custkey") % 4
    none = F.lit(None).cast("string")

    def row(*cells):
        return F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells])

    title = row(F.concat(F.lit("BÁO CÁO "), F.col("o_custkey").cast("string")), none, none, none, none)
    empty = row(none, none, none, none, none)
    tops = case(
        kind, F.array(title, row(*FIRST)), F.array(title, row(*FIRST), row(*SECOND)), F.array(title),
        F.array(row(*FIRST), empty))
    heads = orders.select("o_custkey").distinct().select("o_custkey", F.posexplode(tops).alias("seq", "cells")).select(
        "o_custkey", F.lit(0).cast("bigint").alias("block"), F.col("seq").cast("bigint").alias("seq"), "cells")
    price = vn_text(F.col("o_totalprice"))
    body = orders.select(
        "o_custkey", (F.floor(F.col("o_orderkey") / 1000) + 1).alias("block"), F.col("o_orderkey").alias("seq"),
        row(F.col("o_orderkey").cast("string"), F.concat(F.lit("Khách "), F.col("o_custkey").cast("string")), price,
            F.date_format("o_orderdate", "dd/MM/yyyy"), price).alias("cells"))
    rows = heads.unionByName(body)
    return rows.select(
        F.concat(F.lit("khach-"), F.col("o_custkey").cast("string")).alias("table_id"), "block", "seq",
        *[F.col("cells")[i].alias(f"c{i}") for i in range(5)])


CUSTOMERS = "WITH c AS (SELECT DISTINCT o_custkey AS k, 'khach-' || o_custkey AS table_id FROM orders) "


@query("row_types", CUSTOMERS + """
    SELECT table_id, 0::BIGINT AS block, 0::BIGINT AS seq, CASE WHEN k % 4 = 3 THEN 'header_candidate' ELSE 'title' END AS row_type FROM c
    UNION ALL SELECT table_id, 0, 1, CASE WHEN k % 4 = 3 THEN 'empty' ELSE 'header_candidate' END FROM c WHERE k % 4 <> 2
    UNION ALL SELECT table_id, 0, 2, 'header_candidate' FROM c WHERE k % 4 = 1
    UNION ALL SELECT 'khach-' || o_custkey, o_orderkey // 1000 + 1, o_orderkey, 'data' FROM orders""")
def row_types(spark, sf):
    return G.classify_rows(customer_grids(spark, sf)).select("table_id", "block", "seq", "row_type")


@query("row_types_strict", """
    SELECT row_type, count(*) AS n FROM (
      SELECT CASE WHEN k % 4 = 3 THEN 'header_candidate' ELSE 'title' END AS row_type FROM (SELECT DISTINCT o_custkey AS k FROM orders)
      UNION ALL SELECT CASE WHEN k % 4 = 3 THEN 'empty' ELSE 'header_candidate' END FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE k % 4 <> 2
      UNION ALL SELECT 'header_candidate' FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE k % 4 = 1
      UNION ALL SELECT 'header_candidate' FROM orders) GROUP BY row_type""")
def row_types_strict(spark, sf):
    """Every cell counts as text: data rows look like header rows."""
    typed = G.classify_rows(customer_grids(spark, sf), strict=True)
    return typed.groupBy("row_type").agg(F.count(F.lit(1)).alias("n"))


@query("header_rows", CUSTOMERS + """
    SELECT table_id, CASE k % 4 WHEN 0 THEN '1' WHEN 1 THEN '1,2' ELSE '0' END AS header_rows,
           CAST(CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) AS data_start,
           CASE WHEN k % 4 = 2 THEN 'fallback' ELSE 'auto' END AS method FROM c""")
def header_rows(spark, sf):
    head = G.classify_rows(G.head_rows(customer_grids(spark, sf)))
    return G.detect_header(head).select(
        "table_id", F.array_join(F.transform("header_idx", lambda i: i.cast("string")), ",").alias("header_rows"),
        "data_start", "method")


@query("header_rows_strict", CUSTOMERS + """, n AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
    SELECT table_id, CASE
             WHEN k % 4 = 0 THEN CASE WHEN n + 1 >= 6 THEN '1' ELSE '0' END
             WHEN k % 4 = 1 THEN CASE WHEN n + 2 >= 6 THEN '1' ELSE '0' END
             WHEN k % 4 = 2 THEN CASE WHEN n >= 6 THEN '1' ELSE '0' END
             ELSE '0' END AS header_rows,
           CAST(CASE
             WHEN k % 4 = 0 THEN CASE WHEN n + 1 >= 6 THEN 2 ELSE 1 END
             WHEN k % 4 = 1 THEN CASE WHEN n + 2 >= 6 THEN 2 ELSE 1 END
             WHEN k % 4 = 2 THEN CASE WHEN n >= 6 THEN 2 ELSE 1 END
             ELSE 2 END AS INTEGER) AS data_start,
           CASE
             WHEN k % 4 = 0 THEN CASE WHEN n + 1 >= 6 THEN 'auto' ELSE 'fallback' END
             WHEN k % 4 = 1 THEN CASE WHEN n + 2 >= 6 THEN 'auto' ELSE 'fallback' END
             WHEN k % 4 = 2 THEN CASE WHEN n >= 6 THEN 'auto' ELSE 'fallback' END
             ELSE 'auto' END AS method
    FROM c JOIN n USING (k)""")
def header_rows_strict(spark, sf):
    """Without numbers to tell data rows, a header is found only where a run of six rows starts."""
    head = G.classify_rows(G.head_rows(customer_grids(spark, sf)), strict=True)
    return G.detect_header(head).select(
        "table_id", F.array_join(F.transform("header_idx", lambda i: i.cast("string")), ",").alias("header_rows"),
        "data_start", "method")


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


MERGED = [f if f == s else f"{f} - {s}" for f, s in zip(FIRST, SECOND)]


@query("merged_headers", CUSTOMERS + f"""
    SELECT table_id, CAST(i AS INTEGER) AS idx, CASE k % 4 WHEN 1 THEN {_list(MERGED)}[i + 1]
             WHEN 2 THEN CASE WHEN i = 0 THEN 'BÁO CÁO ' || k END ELSE {_list(FIRST)}[i + 1] END AS header_text
    FROM c, range(5) r(i)""")
def merged_headers(spark, sf):
    head = G.classify_rows(G.head_rows(customer_grids(spark, sf)))
    return G.merge_header_rows(head, G.detect_header(head), [f"c{i}" for i in range(5)]).select(
        "table_id", "idx", "header_text")


NAMES_SQL = CUSTOMERS + f"""
    SELECT table_id, CAST(i AS INTEGER) AS idx, CASE k % 4 WHEN 1 THEN {_list(['mã_đơn', 'khách', 'giá_bán', 'ngày_đặt', 'giá_mua'])}[i + 1]
             WHEN 2 THEN CASE WHEN i = 0 THEN 'báo_cáo_' || k ELSE 'col_' || i END
             ELSE {_list(['mã', 'khách', 'giá', 'ngày', 'giá_2'])}[i + 1] END AS name
    FROM c, range(5) r(i)"""


@query("header_names", NAMES_SQL)
def named_columns(spark, sf):
    """Header texts to final, unique column names, for all grids at once."""
    grid = staged(G.drop_empty_rows(customer_grids(spark, sf)), "grid")
    facts = staged(G.column_facts(grid), "facts")
    head = staged(typed_head(grid, facts), "head")
    return header_names(head, G.detect_header(head), facts).select("table_id", "idx", "name")


@query("column_names", """
    SELECT doc_id, turn AS idx, CASE WHEN t = '' THEN 'col_' || turn ELSE t END AS name FROM (
      SELECT doc_id, turn, trim(regexp_replace(lower(text), '[^\\pL\\pN_]+', '_', 'g'), '_') AS t
      FROM (SELECT conv_id AS doc_id, turn, text FROM conversations))""")
def column_names(spark, sf):
    """Whole texts as header cells."""
    from gridsmith.functions import text

    df = wide(spark, sf, "conversations")
    name = text.column_name(F.col("text"), F.col("turn"))
    return df.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), name.alias("name"))


@query("unique_names", """
    WITH o AS (SELECT l_orderkey AS table_id, lower(l_returnflag) AS base, row_number() OVER (
                 PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey, l_suppkey) AS idx FROM lineitem),
    n AS (SELECT *, row_number() OVER (PARTITION BY table_id, base ORDER BY idx) AS rn FROM o)
    SELECT table_id, CAST(idx AS INTEGER) AS idx, CASE WHEN rn = 1 THEN base ELSE base || '_' || rn END AS name FROM n""")
def unique_column_names(spark, sf):
    """The return flags of an order's few lines as repeated column names of one table."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")
    names = wide(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("table_id"), F.row_number().over(w).alias("idx"), F.lower("l_returnflag").alias("name"))
    return G.unique_names(names)


@query("data_rows", """
    SELECT 'khach-' || o_custkey AS table_id, CAST(o_orderkey AS VARCHAR) AS code, strftime(o_orderdate, '%d/%m/%Y') AS day
    FROM orders""")
def sliced_rows(spark, sf):
    grid = G.drop_empty_rows(customer_grids(spark, sf))
    head = G.classify_rows(G.head_rows(grid))
    starts = G.detect_header(head).join(head, "table_id").where(F.col("row_no") == F.col("data_start"))
    return G.data_rows(grid, starts.select("table_id", "block", "seq")).select(
        "table_id", F.col("c0").alias("code"), F.col("c3").alias("day"))


def event_grid(spark, sf):
    """Events as a grid per type: blank rows, a blank column, ditto marks in one column."""
    key = F.col("event_id")
    blank = key % 5 == 0
    cells = {
        "c0": F.when(blank, F.lit(" \t")).otherwise(key.cast("string")),
        "c1": F.when(blank, None).when(key % 7 == 3, case(key % 5 - 1, *V.DITTO_MARKS[:4])).when(
            key % 11 == 6, None).otherwise(F.col("user_id").cast("string")),
        "c2": F.when(blank, None).when(F.col("event_type") == "click", F.lit("  ")).otherwise(F.col("props")),
        "c3": F.lit(None).cast("string"),
    }
    return wide(spark, sf, "events").select(
        F.col("event_type").alias("table_id"), F.floor(key / 500).alias("block"), key.alias("seq"),
        *[c.alias(n) for n, c in cells.items()])


@query("drop_empty_rows", "SELECT event_type AS table_id, event_id AS seq FROM events WHERE event_id % 5 <> 0")
def non_empty_rows(spark, sf):
    return G.drop_empty_rows(event_grid(spark, sf)).select("table_id", "seq")


@query("drop_empty_columns", """
    SELECT event_type AS table_id, c AS cell,
           CASE c WHEN 'c3' THEN false WHEN 'c2' THEN event_type <> 'click' ELSE true END AS filled, c = 'c1' AS ditto
    FROM (SELECT DISTINCT event_type FROM events), (VALUES ('c0'), ('c1'), ('c2'), ('c3')) v(c)""")
def column_flags(spark, sf):
    return G.column_facts(event_grid(spark, sf)).select("table_id", "cell", "filled", "ditto")


@query("surviving_columns", """
    SELECT event_type AS table_id, event_id AS seq, CAST(event_id AS VARCHAR) AS c0,
           CASE WHEN event_id % 7 = 3 THEN CASE event_id % 5 WHEN 1 THEN '"' WHEN 2 THEN '''' WHEN 3 THEN 'nt' ELSE 'nt.' END
                WHEN event_id % 11 <> 6 THEN CAST(user_id AS VARCHAR) END AS c1,
           CASE WHEN event_type <> 'click' THEN props END AS c2
    FROM events WHERE event_id % 5 <> 0""")
def surviving_columns(spark, sf):
    """Every table's grid without its empty columns: clicks lose one more than the others."""
    grid = G.drop_empty_rows(event_grid(spark, sf))
    facts = G.column_facts(grid).collect()
    kept = [G.drop_empty_columns(grid.where(F.col("table_id") == t), [r for r in facts if r.table_id == t])
            for t in sorted({r.table_id for r in facts})]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept).drop("block")


DITTO_SQL = """
    WITH g AS (SELECT event_type AS table_id, event_id AS seq, event_id % 7 = 3 AS mark,
                      CASE WHEN event_id % 7 = 3 OR event_id % 11 = 6 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS v,
                      CASE event_id % 5 WHEN 1 THEN '"' WHEN 2 THEN '''' WHEN 3 THEN 'nt' ELSE 'nt.' END AS m
               FROM events WHERE event_id % 5 <> 0)
    SELECT table_id, seq, CASE WHEN mark THEN coalesce(last_value(v IGNORE NULLS) OVER (
             PARTITION BY table_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m) ELSE v END AS value
    FROM g"""


@query("ditto_marks", DITTO_SQL)
def ditto_marks(spark, sf):
    grid = G.drop_empty_rows(event_grid(spark, sf))
    return G.fill_ditto(grid, ["c1"]).select("table_id", "seq", F.col("c1").alias("value"))
