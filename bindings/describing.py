"""Names, type labels, example values, sample rows, schema texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import case, query, table
from gridsmith.functions import text
from gridsmith.operators import describe as D
from gridsmith.session import fresh_path
from gridsmith.sources.tables import publish


@query("table_names", """
    SELECT c_custkey, CASE c_custkey % 4
             WHEN 0 THEN 'customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '_2024'
             WHEN 1 THEN 'don_hang_' || lower(c_mktsegment)
             WHEN 2 THEN 'bao cao ' || c_custkey ELSE 'table' END AS table_name
    FROM customer""")
def table_names(spark, sf):
    """File names made of customer names and segments, with diacritics, dots and dashes."""
    key = F.col("c_custkey")
    file = case(
        key % 4, F.concat(F.lit("/in/"), "c_name", F.lit(".2024.csv")), F.concat(F.lit("Đơn-hàng.-"), "c_mktsegment", F.lit(".csv")),
        F.concat(F.lit("s3://b/Báo cáo "), key.cast("string"), F.lit(".CSV")), "--–-.csv")
    return table(spark, sf, "customer").select("c_custkey", text.table_name(file).alias("table_name"))


@query("example_values", """
    WITH v AS (
      SELECT 'p_partkey' AS c, CAST(p_partkey AS VARCHAR) AS value, p_partkey AS o FROM part
      UNION ALL SELECT 'p_name', p_name, p_partkey FROM part UNION ALL SELECT 'p_brand', p_brand, p_partkey FROM part
      UNION ALL SELECT 'p_type', p_type, p_partkey FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), p_partkey FROM part
      UNION ALL SELECT 'p_retailprice', CAST(p_retailprice AS VARCHAR), p_partkey FROM part),
    f AS (SELECT c, value, min(o) AS o FROM v GROUP BY c, value),
    r AS (SELECT c, value, row_number() OVER (PARTITION BY c ORDER BY o) AS rank FROM f)
    SELECT c AS "column", CASE c WHEN 'p_partkey' THEN 'INTEGER' WHEN 'p_size' THEN 'INTEGER' WHEN 'p_retailprice' THEN 'REAL' ELSE 'TEXT' END AS label,
           CAST(rank AS INTEGER) AS rank, value FROM r WHERE rank <= 3""")
def example_values(spark, sf):
    part = table(spark, sf, "part").withColumn("place", F.col("p_partkey"))
    labels = D.column_types(part.drop("place")).select("column", "label")
    return D.example_values(part, ["place"]).join(labels, "column").select("column", "label", "rank", "value")


@query("sparse_examples", """
    WITH v AS (SELECT 'status' AS c, o_orderstatus AS value, o_orderkey AS o FROM orders
      UNION ALL SELECT 'rare', CASE WHEN o_totalprice > 499000 THEN o_orderpriority END, o_orderkey FROM orders),
    f AS (SELECT c, value, min(o) AS o FROM v WHERE value IS NOT NULL GROUP BY c, value),
    r AS (SELECT c, value, row_number() OVER (PARTITION BY c ORDER BY o) AS rank FROM f)
    SELECT c AS "column", CAST(rank AS INTEGER) AS rank, value FROM r WHERE rank <= 3""")
def sparse_examples(spark, sf):
    """A column with few values and one that is nearly always empty need the whole table."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_totalprice") > 499000, F.col("o_orderpriority")).alias("rare"))
    return D.example_values(orders, ["place"]).select("column", "rank", "value")


@query("sample_rows", """
    SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS INTEGER) AS rank, s_suppkey || ', ' || s_name || ', ' || s_nationkey || ', ' ||
           CASE WHEN s_suppkey % 2 = 1 THEN 'NULL' ELSE CAST(s_acctbal AS VARCHAR) END AS line
    FROM supplier ORDER BY s_suppkey LIMIT 3""")
def sample_rows(spark, sf):
    supplier = table(spark, sf, "supplier").withColumn("place", F.col("s_suppkey")).withColumn(
        "s_acctbal", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")))
    return D.sample_rows(supplier, ["place"])


SCHEMA_SQL = """
    WITH s AS (SELECT s_suppkey AS k, s_name AS n, s_acctbal AS a, 'it''s ' || s_suppkey AS q FROM supplier),
    ex AS (
      SELECT (SELECT string_agg(CAST(k AS VARCHAR), ', ' ORDER BY k) FROM (SELECT k FROM s ORDER BY k LIMIT 3)) AS ek,
             (SELECT string_agg('''' || n || '''', ', ' ORDER BY k) FROM (SELECT k, n FROM s ORDER BY k LIMIT 3)) AS en,
             (SELECT string_agg('"' || q || '"', ', ' ORDER BY k) FROM (SELECT k, q FROM s ORDER BY k LIMIT 3)) AS eq,
             (SELECT string_agg(CAST(a AS VARCHAR), ', ' ORDER BY o) FROM (SELECT a, min(k) AS o FROM s GROUP BY a ORDER BY o LIMIT 3)) AS ea,
             (SELECT string_agg(k || ', ' || n || ', ' || a || ', ' || q, chr(10) ORDER BY k) FROM (SELECT * FROM s ORDER BY k LIMIT 3)) AS rows)
    SELECT 'supplier' AS table_name, '【DB_ID】 supplier' || chr(10) || '【Schema】' || chr(10) || '# Table: supplier' || chr(10) || '[' || chr(10) ||
           '(s_suppkey:INTEGER, Primary Key, Examples: [' || ek || ']),' || chr(10) || '(s_name:TEXT, Examples: [' || en || ']),' || chr(10) ||
           '(s_acctbal:REAL, Examples: [' || ea || ']),' || chr(10) || '(motto:TEXT, Examples: [' || eq || ']),' || chr(10) || ']' || chr(10) ||
           'Sample rows from `supplier`:' || chr(10) || rows AS text
    FROM ex"""


@query("schema_text", SCHEMA_SQL)
def schema_text(spark, sf):
    supplier = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("place"), "s_suppkey", "s_name", "s_acctbal",
        F.concat(F.lit("it's "), F.col("s_suppkey").cast("string")).alias("motto"))
    return D.m_schema(supplier, "supplier", ["place"], keys=["s_suppkey"])


DESCRIBED = {
    "orders": ("o_orderkey", [("o_orderkey", "INTEGER"), ("o_orderpriority", "TEXT"), ("o_orderstatus", "TEXT")]),
    "customer": ("c_custkey", [("c_custkey", "INTEGER"), ("c_name", "TEXT"), ("c_mktsegment", "TEXT")]),
    "part": ("p_partkey", [("p_partkey", "INTEGER"), ("p_name", "TEXT")]),
}


def _described_sql(name: str, key: str, columns: list[tuple[str, str]]) -> str:
    """The description of one table from the places at which its values stand first."""
    def examples(column: str, kind: str) -> str:
        shown = f"chr(39) || {column} || chr(39)" if kind == "TEXT" else f"{column}::VARCHAR"
        return (f"'({column}:{kind}, Examples: [' || (SELECT string_agg({shown}, ', ' ORDER BY place) FROM (SELECT {column}, min({key}) AS place FROM {name} "
                f"GROUP BY {column} ORDER BY place LIMIT 3)) || ']),' || chr(10)")
    lines = " || ".join(examples(*c) for c in columns)
    row = " || ', ' || ".join(f"{c}::VARCHAR" for c, _ in columns)
    return f"""
    SELECT '{name}' AS db_id, '【DB_ID】 {name}' || chr(10) || '【Schema】' || chr(10) || '# Table: {name}' || chr(10) || '[' || chr(10) || {lines}
      || ']' || chr(10) || 'Sample rows from `{name}`:' || chr(10)
      || (SELECT string_agg(line, chr(10) ORDER BY {key}) FROM (SELECT {key}, {row} AS line FROM {name} ORDER BY {key} LIMIT 3)) AS text,
      1::BIGINT AS unavailable"""


@query("described_folder", " UNION ALL ".join(_described_sql(n, *of) for n, of in DESCRIBED.items()))
def described_folder(spark, sf):
    """Published tables described in stored order; a table that is not there is described as unavailable."""
    paths = {name: fresh_path(spark, "published") for name in DESCRIBED}
    for name, (key, columns) in DESCRIBED.items():
        rows = table(spark, sf, name).select(*[c for c, _ in columns], F.col(key).alias("at"))
        publish(rows, name, path=paths[name], order=["at"])
    found = D.describe_tables(spark, paths | {"gone": fresh_path(spark, "gone")})
    gone = found.where(F.col("text").startswith("(schema unavailable: ")).agg(F.count(F.lit(1)).alias("unavailable"))
    return found.where("db_id <> 'gone'").withColumn("_one", F.lit(1)).join(gone.withColumn("_one", F.lit(1)), "_one").drop("_one")
