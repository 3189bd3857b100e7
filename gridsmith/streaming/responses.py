"""Collect response files as they arrive, resuming where the last run stopped."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridsmith.functions.statements import extract_sql
from gridsmith.operators.batches import parse_responses
from gridsmith.sources.tables import replace_folder

LAYOUTS = ("chat_completions", "messages")


def response_stream(spark: SparkSession, folder: str, layout: str) -> DataFrame:
    """Keyed response lines of a folder as a stream of ``instance_id, sql, raw_response, error, at``.

    ``at`` is the place of the answer's file: time, name and split. A layout without ids has none to
    collect by as files arrive; it is refused, ``read_responses`` reads it.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"only {' and '.join(LAYOUTS)} can be followed, not {layout}")
    place = F.struct(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))
    lines = spark.readStream.schema("value string").text(folder).select("value", place.alias("pos"))
    parsed = parse_responses(lines, layout)
    sql = F.when(F.col("error").isNull(), extract_sql(F.col("raw_response"))).otherwise("")
    return parsed.select("instance_id", sql.alias("sql"), "raw_response", "error", F.col("pos").alias("at"))


def collected(results: DataFrame) -> DataFrame:
    """One result per id of what ``follow_responses`` has written: the last answer counts."""
    last = results.groupBy("instance_id").agg(F.max_by(
        F.struct("sql", "raw_response", "error"), F.struct("at", "line")).alias("r"))
    return last.select("instance_id", "r.*")


def follow_responses(spark: SparkSession, folder: str, layout: str, results: str, checkpoint: str) -> StreamingQuery:
    """Append the results of all files not collected before, then stop.

    The stream's checkpoint remembers the collected files. Each delivery is a folder of its own,
    replaced if it is written again: an interrupted run is simply started again. ``line`` rises
    within a split; ``collected`` reads the last answer of each id.
    """
    def keep(delivery: DataFrame, number: int) -> None:
        delivery.withColumn("line", F.monotonically_increasing_id()).write.mode("overwrite").parquet(
            f"{results}/delivery={number}")

    return (
        response_stream(spark, folder, layout).writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def with_line(answers: DataFrame) -> DataFrame:
    """Add ``line``, rising over the rows of a task. A stream has no row numbers of its own."""
    # Local, so that it travels to the executors by value.
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            lines = pa.array(range(seen, seen + batch.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, lines], names=[*batch.schema.names, "line"])
            seen += batch.num_rows

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in answers.dtypes)
    return answers.mapInArrow(count, f"{kinds}, line bigint")


def last_answers(answers: DataFrame) -> DataFrame:
    """One row per id of a stream of ``response_stream``: its last answer, kept as keyed state.

    The state holds one answer per id, partial results meet map-side, and a hot id is no hot task.
    """
    last = with_line(answers).groupBy("instance_id").agg(F.max_by(
        F.struct("sql", "raw_response", "error"), F.struct("at", "line")).alias("r"))
    return last.select("instance_id", "r.*")


def follow_last_answers(spark: SparkSession, folder: str, layout: str, results: str, checkpoint: str) -> StreamingQuery:
    """Keep the table ``results`` at one row per id, its last answer in all files so far, then stop.

    Earlier deliveries are never read again: what counts of them is in the stream's state, which the
    checkpoint keeps. The table is written anew and takes the old one's place, so a run that
    dies in between repeats its last step. Before the first answer the table is empty.
    """
    def keep(state: DataFrame, number: int) -> None:
        replace_folder(state, results, results, empty=True)

    return (
        last_answers(response_stream(spark, folder, layout)).writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
