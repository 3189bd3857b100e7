"""Response files: lines in file order, read by layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.operators.batches import parse_responses
from gridsmith.operators.ordering import positions


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``pos, value``: the lines of all files that are not blank, numbered in file and line order."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value") != "").select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"))
    return positions(lines, [], [["_file", "_block"]], ["_seq"], "pos").select("pos", "value")


def read_responses(spark: SparkSession, path: str | list[str], layout: str, requests: DataFrame | None = None) -> DataFrame:
    """``pos, instance_id, raw_response, error`` of all response lines under a path.

    The place of a line decides which of two answers to one id is the last. ``inline`` has no ids:
    its i-th line answers the request with ``pos`` i, so it needs ``requests`` (``instance_id, pos``).
    """
    if layout == "inline" and requests is None:
        raise ValueError("inline responses have no ids: give the requests")
    return parse_responses(read_lines(spark, path), layout, requests)
