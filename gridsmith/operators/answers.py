"""Stored answers: JSON texts to answer cells, reparsed predictions to the standard layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVALID = "invalid exec_answer format"
UNPARSEABLE = "unparseable result"


def question_ids(questions: DataFrame) -> DataFrame:
    """``index, instance_id``: the id of every question that carries an index; the last one wins."""
    iid = F.coalesce(
        F.nullif(F.col("instance_id"), F.lit("")),
        F.concat_ws("_", F.coalesce("db_id", F.lit("")), F.col("pos").cast("string")))
    named = questions.where(F.col("index").isNotNull()).select("index", "pos", iid.alias("instance_id"))
    return named.groupBy("index").agg(F.max_by("instance_id", "pos").alias("instance_id"))


def reparsed(predictions: DataFrame, questions: DataFrame) -> DataFrame:
    """Reparsed rows (``index, db_id, sql, result``) in the standard layout; a missing result is ``[]``."""
    ids = question_ids(questions).withColumnRenamed("instance_id", "_iid")
    fallback = F.concat_ws(
        "_", F.coalesce("db_id", F.lit("unknown")), F.coalesce(F.col("index").cast("string"), F.lit("None")))
    kept = [c for c in predictions.columns if c not in ("index", "sql", "result")]
    return predictions.join(ids, "index", "left").select(
        *kept, F.coalesce("_iid", fallback).alias("instance_id"),
        F.coalesce("sql", F.lit("")).alias("sql_answer"), F.coalesce("result", F.lit("[]")).alias("exec_answer"))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def parsed_answers(predictions: DataFrame, text: str = "exec_answer", unreadable: str = INVALID) -> DataFrame:
    """Add ``answer_rows`` (array of rows of variants), ``n_rows``, ``n_cols`` and ``error``.

    A list of plain values becomes rows of one cell. An object's ``error`` is carried over; any
    other shape is an error of its own.
    """
    # A list is taken apart row by row: there is a largest variant, and a long answer is beyond it.
    is_list = F.coalesce(F.ltrim(text).startswith("["), F.lit(False))
    listed = predictions.withColumn("_v", F.when(~is_list, F.try_parse_json(F.col(text)))).withColumn(
        "_items", F.when(is_list, F.from_json(F.col(text), "array<variant>")))
    kind = _kind(F.col("_v"))
    first = _kind(F.get(F.col("_items"), F.lit(0)))
    nested = F.transform("_items", lambda r: F.coalesce(r.try_cast("array<variant>"), F.array(r)))
    flat = F.transform("_items", lambda r: F.array(r))
    rows = (
        F.when(F.size("_items") == 0, F.array().cast("array<array<variant>>"))
        .when(first.startswith("ARRAY"), nested)
        .when(first.startswith("OBJECT"), None)
        .otherwise(flat)
    )
    shaped = listed.withColumn("answer_rows", F.when(F.col("_items").isNotNull(), rows))
    message = F.when(kind.startswith("OBJECT"), F.try_variant_get(F.col("_v"), "$.error", "string"))
    error = (
        F.when(F.col("answer_rows").isNotNull(), None)
        .when(F.col("_v").isNull() & F.col(text).isNotNull(), unreadable)
        .otherwise(F.coalesce(message, F.lit(INVALID)))
    )
    widest = F.coalesce(F.array_max(F.transform("answer_rows", lambda r: F.size(r))), F.lit(0))
    return shaped.select(
        *predictions.columns, "answer_rows",
        F.when(F.col("answer_rows").isNotNull(), F.size("answer_rows").cast("bigint")).alias("n_rows"),
        F.when(F.col("answer_rows").isNotNull(), widest).alias("n_cols"), error.alias("error"))


def answer_cells(parsed: DataFrame, key: str) -> DataFrame:
    """``<key>, row_idx, col_idx, num, str``; short rows are padded with NULL up to ``n_cols``."""
    # Not a filter on the counts: Spark would push it below the parser and parse every answer for it once more.
    rows = parsed.select(key, "n_cols", F.posexplode_outer("answer_rows").alias("row_idx", "row"))
    padded = F.when(F.size("row") == F.col("n_cols"), F.col("row")).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda i: F.get(F.col("row"), i)))
    cells = rows.select(
        key, F.col("row_idx").cast("bigint").alias("row_idx"), F.posexplode_outer(F.when(F.col("n_cols") > 0, padded)).alias("col_idx", "v")).where(
        "col_idx IS NOT NULL").select("*", _kind(F.col("v")).alias("_kind"))
    kind = F.col("_kind")
    is_text = kind == "STRING"
    is_none = F.col("v").isNull() | (kind == "VOID")
    is_number = kind.rlike("^(BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return cells.select(
        key, "row_idx", "col_idx",
        F.when(~is_none & is_number, F.try_variant_get(F.col("v"), "$", "double")).alias("num"),
        F.when(~is_none & ~is_number, F.when(is_text, F.try_variant_get(F.col("v"), "$", "string")).otherwise(
            F.to_json("v"))).alias("str"))
