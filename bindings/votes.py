"""Profiles, type votes, conversion, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import case, comma_text, plain_text, query, wide, us_text, vn_text
from gridsmith.operators import typing as T
from gridsmith.operators.cells import clean_cells
from gridsmith.session import staged


def styled(spark, sf):
    """Line items as five tables, each with its own mix of number styles."""
    price = F.col("l_extendedprice")
    tbl = F.col("l_suppkey") % 5
    turn = F.col("l_partkey") % 2 == 0
    cell = case(
        tbl, vn_text(price), us_text(price), plain_text(price),
        F.when(turn, us_text(price)).otherwise(vn_text(price)), comma_text(price))
    return wide(spark, sf, "lineitem").select(tbl.cast("int").alias("tbl"), cell.alias("price"))


@query("number_styles", """
    WITH m AS (
      SELECT CAST(l_suppkey % 5 AS INTEGER) AS tbl, CASE
          WHEN l_suppkey % 5 IN (0, 4) THEN 'vn' WHEN l_suppkey % 5 = 2 THEN 'plain'
          WHEN l_suppkey % 5 = 3 AND l_partkey % 2 = 1 THEN 'vn'
          WHEN l_extendedprice >= 1000 THEN 'us' ELSE 'plain' END AS s
      FROM lineitem),
    c AS (SELECT tbl, count(*) AS n, count(*) FILTER (s = 'plain') AS n_plain, count(*) FILTER (s = 'us') AS n_us,
                 count(*) FILTER (s = 'vn') AS n_vn FROM m GROUP BY tbl)
    SELECT tbl, n, n_plain, n_us, n_vn, CASE WHEN n_plain > n * 0.5 THEN 'plain' WHEN n_us > n * 0.5 THEN 'us'
           WHEN n_vn > n * 0.5 THEN 'vn' ELSE 'mixed' END AS style FROM c""")
def number_styles(spark, sf):
    return T.profile(styled(spark, sf), ["price"], ["tbl"]).select("tbl", "n", "n_plain", "n_us", "n_vn", "style")


def messy_orders(spark, sf):
    """Orders as text: every column another type, with cells that do not fit."""
    key = F.col("o_orderkey")
    return wide(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
        F.when(key % 10 == 9, "abc").otherwise((key + 2).cast("string")).alias("code"),
        F.when(key % 10 >= 6, "abc").otherwise((key + 2).cast("string")).alias("half"),
        F.when(key % 11 == 10, None).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day"),
        F.when(key % 9 == 8, "?").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 10:30"))).alias("moment"),
        F.concat(F.lit("$"), us_text(F.col("o_totalprice"))).alias("amount"),
        F.concat((F.col("o_custkey") % 100).cast("string"), F.lit(" %")).alias("share"),
        F.when(F.col("o_custkey") % 2 == 0, "Có").otherwise("không").alias("flag"),
        F.when(key % 8 == 7, "-").otherwise(vn_text(F.col("o_totalprice"))).alias("price"),
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("phone"),
        F.lit(None).cast("string").alias("nothing"))


MESSY = ["code", "half", "day", "moment", "amount", "share", "flag", "price", "phone", "nothing"]

VOTES_SQL = """
    WITH o AS (SELECT o_orderkey AS k FROM orders), t AS (SELECT count(*) AS n FROM o)
    SELECT 'code' AS "column", n, (SELECT count(*) FROM o WHERE k % 10 <> 9) AS n_number,
           (SELECT count(*) FROM o WHERE k % 10 = 9) AS n_text, 0::BIGINT AS n_date, 'int' AS type FROM t
    UNION ALL SELECT 'half', n, (SELECT count(*) FROM o WHERE k % 10 < 6), (SELECT count(*) FROM o WHERE k % 10 >= 6), 0, 'text' FROM t
    UNION ALL SELECT 'day', (SELECT count(*) FROM o WHERE k % 11 <> 10), 0, 0, (SELECT count(*) FROM o WHERE k % 11 <> 10), 'date' FROM t
    UNION ALL SELECT 'moment', n, 0, (SELECT count(*) FROM o WHERE k % 9 = 8), (SELECT count(*) FROM o WHERE k % 9 <> 8), 'date' FROM t
    UNION ALL SELECT 'amount', n, 0, 0, 0, 'currency' FROM t
    UNION ALL SELECT 'share', n, 0, 0, 0, 'percentage' FROM t
    UNION ALL SELECT 'flag', n, 0, 0, 0, 'bool' FROM t
    UNION ALL SELECT 'price', (SELECT count(*) FROM o WHERE k % 8 <> 7), (SELECT count(*) FROM o WHERE k % 8 <> 7), 0, 0, 'float' FROM t
    UNION ALL SELECT 'phone', n, (SELECT count(*) FROM o), 0, 0, 'text' FROM t
    UNION ALL SELECT 'nothing', 0, 0, 0, 0, 'text' FROM t"""


@query("type_votes", VOTES_SQL)
def type_votes(spark, sf):
    clean = clean_cells(messy_orders(spark, sf).select(*MESSY), MESSY)
    return T.profile(clean, MESSY).select("column", "n", "n_number", "n_text", "n_date", "type")


@query("whole_numbers", """
    SELECT CAST(l_suppkey % 3 AS INTEGER) AS tbl, CASE CAST(l_suppkey % 3 AS INTEGER) WHEN 1 THEN 'float' ELSE 'int' END AS type
    FROM lineitem GROUP BY 1""")
def whole_numbers(spark, sf):
    """Quantities without and with decimals, and with decimals that are all zero."""
    whole = F.col("l_quantity").cast("bigint") + 2
    cell = case(F.col("l_suppkey") % 3, whole.cast("string"), F.concat(whole.cast("string"), F.lit(".5")),
                F.concat(whole.cast("string"), F.lit(".0")))
    df = wide(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).cast("int").alias("tbl"), cell.alias("quantity"))
    return T.profile(df, ["quantity"], ["tbl"]).select("tbl", "type")


@query("time_parts", """
    SELECT user_id % 4 AS tbl, bool_or(CASE WHEN user_id % 4 = 1 THEN false ELSE
             date_trunc('second', ts) <> date_trunc('day', ts) END) AS has_time
    FROM (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts FROM events) GROUP BY 1""")
def time_parts(spark, sf):
    cell = F.when(F.col("user_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = wide(spark, sf, "events").select((F.col("user_id") % 4).alias("tbl"), cell.alias("moment"))
    return T.profile(df, ["moment"], ["tbl"]).select("tbl", "has_time")


@query("leading_zero_columns", """
    SELECT c_nationkey, bool_or(c_nationkey % 2 = 0 AND c_custkey < 100000) AS leading_zero,
           CASE WHEN bool_or(c_nationkey % 2 = 0 AND c_custkey < 100000) THEN 'text' ELSE 'int' END AS type
    FROM customer GROUP BY c_nationkey""")
def leading_zero_columns(spark, sf):
    """One padded code is enough to keep a whole column as text."""
    key = F.col("c_custkey")
    padded = F.when(F.col("c_nationkey") % 2 == 0, F.lpad(key.cast("string"), 6, "0")).otherwise((key + 100).cast("string"))
    df = wide(spark, sf, "customer").select("c_nationkey", padded.alias("code"))
    return T.profile(df, ["code"], ["c_nationkey"]).select("c_nationkey", "leading_zero", "type")


@query("typed_columns", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 9 THEN o_orderkey + 2 END AS code,
           CASE WHEN o_orderkey % 10 >= 6 THEN 'abc' ELSE CAST(o_orderkey + 2 AS VARCHAR) END AS half,
           CASE WHEN o_orderkey % 11 <> 10 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
           CASE WHEN o_orderkey % 9 = 8 THEN '?' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 10:30:00' END AS moment,
           o_totalprice AS amount, round((o_custkey % 100) / 100.0, 6)::DOUBLE AS share,
           CAST(1 - o_custkey % 2 AS INTEGER) AS flag,
           CASE WHEN o_orderkey % 8 <> 7 THEN o_totalprice END AS price,
           lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS phone, CAST(NULL AS VARCHAR) AS nothing
    FROM orders""")
def typed_columns(spark, sf):
    """Clean, vote, convert: the order table back from its text form."""
    clean = staged(clean_cells(messy_orders(spark, sf).select("o_orderkey", *MESSY), MESSY), "clean")
    return T.apply_types(clean, T.profile(clean, MESSY).collect())


@query("styled_columns", """
    SELECT CAST(l_suppkey % 5 AS INTEGER) AS tbl, count(*) AS n, round(sum(l_extendedprice), 2) AS total
    FROM lineitem GROUP BY 1""")
def styled_columns(spark, sf):
    """Five tables, each converted in the style its own cells voted for."""
    df = styled(spark, sf)
    votes = T.profile(df, ["price"], ["tbl"]).collect()
    out = None
    for v in votes:
        part = T.apply_types(df.where(F.col("tbl") == v["tbl"]), [v])
        part = part.select("tbl", F.col("price").cast("double").alias("price"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("tbl").agg(F.count("price").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("dedup_rows", """
    SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY user_id, event_type""")
def dedup_rows(spark, sf):
    """Events cut to two columns repeat often; the first copy's place is kept."""
    df = wide(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("first_id"))
    return T.drop_duplicates(df, ["user_id", "event_type"], ["first_id"])


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_quantity FROM lineitem")
def distinct_rows(spark, sf):
    return T.drop_duplicates(
        wide(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"])


def messy_prices(spark, sf):
    """Line items with prices as Vietnamese text, NA tokens for some, every third row twice."""
    price = F.when(F.col("l_partkey") % 17 == 0, "n/a").otherwise(vn_text(F.col("l_extendedprice")))
    rows = wide(spark, sf, "lineitem").select(
        *[F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        "l_returnflag", price.alias("price"))
    copies = F.when(F.col("l_partkey") % 3 == 0, 2).otherwise(1)
    return rows.select("*", F.explode(F.sequence(F.lit(1), copies)).alias("_copy")).drop("_copy")


REVENUE_SQL = """
    SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (l_partkey % 17 <> 0) AS n_priced,
           round(sum(CASE WHEN l_partkey % 17 <> 0 THEN l_extendedprice END), 2) AS revenue
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
                 CASE WHEN l_partkey % 17 <> 0 THEN l_extendedprice END AS l_extendedprice FROM lineitem)
    GROUP BY l_returnflag"""


@query("cleaned_revenue", REVENUE_SQL)
def cleaned_revenue(spark, sf):
    """Messy price list to revenue: clean, vote, convert, deduplicate, aggregate."""
    messy = messy_prices(spark, sf)
    cells = messy.columns
    # Read twice, by the profile and by the conversion, so it is written once.
    clean = staged(clean_cells(messy, cells, nfc_cells=[]), "clean")
    typed = T.apply_types(clean, T.profile(clean, cells).collect())
    distinct = T.drop_duplicates(typed, cells)
    return distinct.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("price").alias("n_priced"),
        F.round(F.sum("price"), 2).alias("revenue"))
