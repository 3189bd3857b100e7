"""Question and prediction files; result files."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.operators.ordering import positions
from gridsmith.session import staged
from gridsmith.sources.spans import array_elements, read_pieces
from gridsmith.sources.tables import is_published

QUESTION_FIELDS = [
    "db_id", "question", "sql", "external_knowledge", "csv_file", "evidence", "instance_id",
    "sql_gold", "query", "gold_sql"]
QUESTION_SCHEMA = ", ".join(f"{f} string" for f in QUESTION_FIELDS) + ", index bigint"
PREDICTION_SCHEMA = "instance_id string, db_id string, sql_answer string, sql string, exec_answer string, llm_error string"
REPARSED_SCHEMA = "index bigint, db_id string, sql string, result string"


def layouts(spark: SparkSession, path: str | list[str]) -> dict[str, bool | None]:
    """Per file whether it is one JSON array, told by its first character that is no blank; None if all are blank. Empty files are absent."""
    first = F.substring(F.ltrim("value", F.lit("\ufeff \t\r")), 1, 1)
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), first.alias("first"))
    heads = lines.groupBy("file").agg(F.min(F.when(F.col("first") != "", F.struct("block", "seq", "first"))).getField("first").alias("first"))
    return {unquote(r["file"]): None if r["first"] is None else r["first"] == "[" for r in heads.collect()}


def read_records(spark: SparkSession, path: str | list[str], schema: str, broken: str = "fail") -> DataFrame:
    """Records with their 0-based ``pos``, from JSON lines, from files that are one JSON array, or both.

    Lines and elements of arrays are split over tasks and numbered by split. An array that is not
    sound throughout is read as one document and refused as a whole.
    Positions continue over the files of a folder, in name order. Fields declared as text keep
    nested JSON as text. Text that is no JSON fails the job that reads it, with the file's name;
    with ``broken="report"`` it is a row of NULLs with the text in ``corrupt`` and the name in ``file``.
    """
    if broken not in ("fail", "report"):
        raise ValueError(f"unknown way to treat broken records: {broken}")
    found = layouts(spark, path)
    parts = []
    lines, arrays = (sorted(f for f, is_array in found.items() if is_array is kind) for kind in (False, True))
    # Files of one layout are read by their folder: thousands of names take the driver long to look up.
    alike = len(set(found.values())) == 1
    place = [F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_seq")]
    whole = f"{schema}, corrupt string"
    options = {"columnNameOfCorruptRecord": "corrupt"}
    if lines:
        texts = spark.read.option("recursiveFileLookup", alike).text(path if alike else lines).where(F.trim("value", F.lit("\ufeff \t\r")) != "")
        record = F.from_json(F.ltrim("value", F.lit("\ufeff")), whole, options)
        parts.append(texts.select(record.alias("r"), *place, F.col("_metadata.file_block_start").alias("_block")).select(
            "r.*", "file", "_seq", "_block"))
    if arrays:
        elements = staged(array_elements(read_pieces(spark, path if alike else arrays, "}", alike)), "elements")
        unsound = ~F.col("sound") | (F.col("element").isNotNull() & F.try_parse_json("element").isNull())
        checked = elements.groupBy("table_id").agg(F.bool_or(unsound).alias("unsound"), F.count_if(F.col("element").isNull()).alias("ends"))
        broken_files = [r["table_id"] for r in checked.where("unsound OR ends <> 1").collect()]
        fine = elements.where(F.col("element").isNotNull() & ~F.col("table_id").isin(broken_files))
        parts.append(fine.select(F.from_json("element", whole, options).alias("r"), F.col("table_id").alias("file"), F.col("seq").alias("_seq"),
                                 F.col("block").alias("_block")).select("r.*", "file", "_seq", "_block"))
        if broken_files:
            texts = spark.read.option("wholetext", True).text([unquote(f) for f in broken_files])
            none = F.from_json(F.lit(None).cast("string"), whole)
            parts.append(texts.select(none.alias("r"), "value", *place).select(
                "r.*", "file", "_seq", F.lit(0).cast("bigint").alias("_block"), F.col("value").alias("refused")))
    if not parts:
        extra = "" if broken == "fail" else ", corrupt string, file string"
        return spark.createDataFrame([], f"{schema}, pos bigint{extra}")
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # A record whose values do not fit the schema is JSON all the same: its fields are NULL.
    no_json = F.col("corrupt").isNotNull() & F.try_parse_json(F.col("corrupt")).isNull() & (F.trim("corrupt") != "")
    corrupt = F.when(no_json, F.col("corrupt"))
    if "refused" in both.columns:
        corrupt = F.coalesce("refused", corrupt)
    placed = positions(both.withColumn("corrupt", corrupt).drop("refused"), [], [["file", "_block"]], ["_seq"], "pos")
    placed = placed.drop("_block", "_seq")
    if broken == "report":
        return placed
    message = F.concat(F.lit("no valid JSON in "), F.col("file"))
    sound = F.when(F.col("corrupt").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return placed.where(sound).drop("corrupt", "file")


def read_questions(spark: SparkSession, path: str | list[str], broken: str = "fail") -> DataFrame:
    """Questions with their position; missing keys are NULL."""
    return read_records(spark, path, QUESTION_SCHEMA, broken)


def read_predictions(spark: SparkSession, folder: str, models: list[str]) -> dict[str, DataFrame]:
    """Per model ``<model>.json``, else ``<model>.reparsed.json``; a model with neither is left out.

    Returns ``{"standard": rows, "reparsed": rows}``, both tagged with ``model``; a layout that
    no model uses is absent.
    """
    out: dict[str, DataFrame] = {}
    for model in models:
        for layout, suffix, schema in (("standard", "json", PREDICTION_SCHEMA),
                                       ("reparsed", "reparsed.json", REPARSED_SCHEMA)):
            path = f"{folder}/{model}.{suffix}"
            try:
                rows = read_records(spark, path, schema)
            except Exception as error:  # noqa: BLE001 - only a missing file is passed over
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                continue
            rows = rows.withColumn("model", F.lit(model))
            out[layout] = out[layout].unionByName(rows) if layout in out else rows
            break
    return out


def save_predictions(predictions: DataFrame, cells: DataFrame, folder: str, model: str) -> None:
    """The prediction record of a model as two tables: ``pos, instance_id, db_id, sql_answer, llm_error,
    n_rows, n_cols, error``, and the cells of the answers. No answer is ever one value."""
    for name, rows in (("rows", predictions), ("cells", cells)):
        rows.write.mode("overwrite").parquet(f"{folder}/{model}.answers/{name}")


def load_predictions(spark: SparkSession, folder: str, models: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """``(rows, cells)`` of the models saved so, tagged with ``model``; None if there are none."""
    found = [m for m in models if all(is_published(spark, f"{folder}/{m}.answers/{name}") for name in ("rows", "cells"))]
    if not found:
        return None
    return tuple(
        reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/{m}.answers/{name}").withColumn("model", F.lit(m)) for m in found])
        for name in ("rows", "cells"))


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One UTF-8 JSON object per line, non-ASCII characters as they are."""
    df.write.mode(mode).json(path)
