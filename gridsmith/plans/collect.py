"""Around the outside step: prompts and request files before it, results and answers after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.operators import batches, questions as Q
from gridsmith.plans.execute import run_queries
from gridsmith.sources.tables import identifier

NO_SQL = "no SQL generated"
BUCKETS = 200


def prepare(questions: DataFrame, schemas: DataFrame, done: DataFrame | None, layout: str, model: str = "",
            template: str = Q.DEFAULT_TEMPLATE, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(requests, failed)`` for the questions that have no result yet.

    ``failed`` are result rows of questions without a table; they count as done.
    """
    prompts = Q.build_prompts(batches.remaining(questions, done), schemas, template)
    requests = batches.to_batch_requests(prompts, layout, model, size=size or 50)
    failed = prompts.where(F.col("error").isNotNull()).select(
        "instance_id", F.lit("").alias("sql"), F.lit("").alias("raw_response"), "error")
    return requests, failed


def merge_results(spark: SparkSession, results: DataFrame, questions: DataFrame,
                  databases: dict[str, dict[str, str]], workers: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(predictions, cells)``: results joined to their questions, statements run.

    Results of unknown ids are dropped. A statement runs if there is one and the request had no
    error; else the error, or a note that nothing was generated, is the answer.
    """
    ours = questions.join(
        results.select("instance_id", F.coalesce("sql", F.lit("")).alias("sql_answer"), F.col("error").alias("llm_error")),
        "instance_id")
    runnable = ours.where((F.col("sql_answer") != "") & F.col("llm_error").isNull())
    answers, cells = run_queries(
        spark, runnable.select("instance_id", "db_id", F.col("sql_answer").alias("sql")), databases, workers)
    ran = answers.select("instance_id", "n_rows", "n_cols", F.col("error").alias("_run_error"))
    failure = F.when(
        (F.col("sql_answer") == "") | F.col("llm_error").isNotNull(), F.coalesce("llm_error", F.lit(NO_SQL))
    ).otherwise(F.col("_run_error"))
    predictions = ours.join(ran, "instance_id", "left").select(
        *questions.columns, "sql_answer", "llm_error", "n_rows", "n_cols", failure.alias("error"))
    return predictions, cells


def append_results(results: DataFrame, path: str) -> None:
    """Append to the results table: the append is what a later run resumes from."""
    results.write.mode("append").parquet(path)


def append_bucketed(results: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """Append to a catalog table that is bucketed by id, one file per bucket and run.

    A resume reads it with ``remaining(questions, done(spark, table))``: only the questions are
    shuffled, to the buckets; however many results there are, none of them moves. An existing table
    keeps the number of buckets it was made with.
    """
    spark, name = results.sparkSession, identifier(table)
    if spark.catalog.tableExists(name):
        described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Num Buckets'").first()
        if described is None:
            raise ValueError(f"{table} is not bucketed by id")
        buckets = int(described.data_type)
    rows = results.repartition(buckets, "instance_id")
    rows.write.format("parquet").bucketBy(buckets, "instance_id").mode("append").saveAsTable(name)


def done(spark: SparkSession, table: str) -> DataFrame | None:
    """The ids of a results table; None before the first run has written it."""
    name = identifier(table)
    return spark.table(name).select("instance_id") if spark.catalog.tableExists(name) else None
