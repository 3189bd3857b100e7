"""Questions made of conversation turns; prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import query, table
from gridsmith.operators import questions as Q
from gridsmith.operators.ordering import numbered


def questions(spark, sf):
    """Turns as questions of seven databases, some with explicit ids, files or evidence."""
    turns = table(spark, sf, "conversations")
    pos = numbered(turns.withColumn("_at", F.col("conv_id") * 1000 + F.col("turn")), "_at", "pos")
    pick = F.col("pos") % 5
    return pos.select(
        "pos", F.concat(F.lit("db_"), (F.col("conv_id") % 7).cast("string")).alias("db_id"),
        F.col("text").alias("question"),
        F.when(pick == 0, F.concat(F.lit("SELECT "), F.col("pos").cast("string"))).when(pick == 1, "").alias("sql"),
        F.when(pick == 1, F.lit("SELECT 1")).alias("sql_gold"),
        F.when(pick == 2, F.lit("SELECT 2")).alias("query"),
        F.when(pick <= 3, F.lit("SELECT 3")).alias("gold_sql"),
        F.when(pick >= 2, F.concat(F.lit(" hint "), F.col("turn").cast("string"))).alias("external_knowledge"),
        F.when(pick == 4, F.lit("given.csv")).alias("csv_file"),
        F.when(pick == 3, F.lit("")).alias("evidence"),
        F.when(pick == 1, F.concat(F.lit("id-"), F.col("pos").cast("string"))).alias("instance_id"),
        F.when(pick != 2, F.col("pos") * 10).alias("index"))


BASE = """WITH q AS (
      SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS pos, conv_id, turn, 'db_' || (conv_id % 7) AS db_id, text AS question
      FROM conversations),
    n AS (SELECT *, CASE WHEN pos % 5 = 4 THEN 'given.csv' ELSE db_id || '.csv' END AS csv_file,
             CASE WHEN pos % 5 = 3 THEN '' WHEN pos % 5 >= 2 THEN ' hint ' || turn ELSE '' END AS evidence,
             CASE WHEN pos % 5 = 1 THEN 'id-' || pos ELSE db_id || '_' || pos END AS instance_id FROM q) """


@query("normalized_questions", BASE + "SELECT pos, csv_file, evidence, instance_id FROM n")
def normalized_questions(spark, sf):
    return Q.normalize(questions(spark, sf)).select("pos", "csv_file", "evidence", "instance_id")


@query("first_questions", BASE + "SELECT pos, instance_id FROM n ORDER BY pos LIMIT 100")
def first_questions(spark, sf):
    """The limit is the feature: the first hundred by position."""
    return Q.first_questions(Q.normalize(questions(spark, sf)), 100).select("pos", "instance_id")


@query("input_files", BASE + "SELECT DISTINCT csv_file FROM n")
def input_files(spark, sf):
    return Q.input_files(questions(spark, sf))


def schemas(spark, sf):
    """A text per database, made of its longest question; the seventh database has none."""
    q = questions(spark, sf).where("db_id <> 'db_6'")
    return q.groupBy("db_id").agg(F.concat(F.lit("schema of "), F.first("db_id"), F.lit(" with "),
                                           F.max(F.length("question")).cast("string")).alias("text"))


PROMPT_SQL = BASE + """, s AS (SELECT db_id, 'schema of ' || db_id || ' with ' || max(length(question)) AS text FROM q WHERE db_id <> 'db_6' GROUP BY db_id)
    SELECT pos, instance_id, CASE WHEN s.text IS NOT NULL THEN 'S: ' || s.text || chr(10) ||
             CASE WHEN trim(evidence) <> '' THEN 'Evidence: ' || trim(evidence) || chr(10) ELSE '' END || 'Q: ' || question END AS prompt,
           CASE WHEN s.text IS NULL THEN 'SQLite conversion failed' END AS error
    FROM n LEFT JOIN s USING (db_id)"""

TEMPLATE = "S: {DATABASE SCHEMA}\n{EVIDENCE}Q: {QUESTION}"


@query("prompts", PROMPT_SQL)
def prompts(spark, sf):
    asked = Q.normalize(questions(spark, sf))
    return Q.build_prompts(asked, schemas(spark, sf), TEMPLATE).select("pos", "instance_id", "prompt", "error")


@query("gold_statements", BASE + """SELECT pos, CASE pos % 5 WHEN 0 THEN 'SELECT ' || pos WHEN 1 THEN 'SELECT 1' WHEN 2 THEN 'SELECT 2'
             WHEN 3 THEN 'SELECT 3' END AS gold FROM n""")
def gold_statements(spark, sf):
    return Q.gold_sql(questions(spark, sf)).select("pos", "gold")
