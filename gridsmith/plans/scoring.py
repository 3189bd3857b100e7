"""Predictions against gold answers: verdicts, scoreboard, breakdown."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsmith.functions import vocabulary as V
from gridsmith.functions.statements import is_ordered
from gridsmith.operators.answers import INVALID, UNPARSEABLE, answer_cells, parsed_answers, reparsed
from gridsmith.operators.questions import gold_sql
from gridsmith.operators.score import compare_results
from gridsmith.plans.execute import gold_answers
from gridsmith.session import staged
from gridsmith.sources.records import load_predictions, read_predictions

NO_GOLD = "no gold found"


def last_gold(gold: DataFrame) -> DataFrame:
    """One gold answer per id, the last by ``gold_id`` (the question's position)."""
    last = gold.groupBy("instance_id").agg(F.max_by(F.struct("gold_id", "n_rows", "n_cols", "error"), "gold_id").alias("g"))
    return last.select(
        "instance_id", F.col("g.gold_id").alias("gold_id"), F.col("g.n_rows").alias("gold_rows"),
        F.col("g.n_cols").alias("gold_cols"), F.col("g.error").alias("gold_error"))


def verdicts(pred: DataFrame, pred_cells: DataFrame, gold: DataFrame, gold_cells: DataFrame,
             abs_tol: float = V.ABS_TOLERANCE, rel_tol: float = V.REL_TOLERANCE) -> DataFrame:
    """One row per prediction: its columns plus ``correct`` and ``error``.

    ``pred`` is ``pred_id, instance_id, sql_answer, n_rows, n_cols, error`` (and more), ``gold`` is
    ``gold_id, instance_id, n_rows, n_cols, error``; the cells carry ``pred_id`` and ``gold_id``.
    """
    matched = pred.withColumnRenamed("error", "pred_error").withColumnRenamed("n_rows", "pred_rows").join(
        last_gold(gold), "instance_id", "left")
    error = (
        F.when(F.col("gold_id").isNull(), NO_GOLD)
        .when(F.col("pred_error").isNotNull(), F.col("pred_error"))
        .when(F.col("pred_rows").isNull() | F.col("gold_rows").isNull(), INVALID)
    )
    matched = matched.withColumn("error", error)
    pairs = matched.where("error IS NULL").select(
        "pred_id", "gold_id", is_ordered(F.col("sql_answer")).alias("ordered"), "pred_rows", "gold_rows", "gold_cols")
    compared = compare_results(pairs, pred_cells, gold_cells, abs_tol, rel_tol)
    kept = [c for c in pred.columns if c not in ("error", "n_rows")]
    return matched.join(compared.select("pred_id", "correct"), "pred_id", "left").select(
        *kept, "gold_id", F.coalesce("correct", F.lit(False)).alias("correct"), "error")


def scoreboard(details: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``score, correct, total`` per model; the total counts predictions, none gives 0.0."""
    grouped = details.groupBy(*by) if by else details.groupBy()
    counted = grouped.agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"))
    score = F.when(F.col("total") > 0, F.round(F.col("correct") / F.col("total"), 4)).otherwise(0.0)
    return counted.select(*(by or []), score.alias("score"), "correct", "total")


def outcome(details: DataFrame) -> DataFrame:
    """Add ``outcome``: correct, no_gold, error or wrong."""
    return details.withColumn(
        "outcome",
        F.when(F.col("correct"), "correct").when(F.col("error") == NO_GOLD, "no_gold")
        .when(F.col("error").isNotNull(), "error").otherwise("wrong"))


def breakdown(details: DataFrame, by: str = "model") -> DataFrame:
    """Per model: correct, failed predictions (those without gold included), wrong ones, without gold."""
    return outcome(details).groupBy(by).agg(
        F.count_if(F.col("outcome") == "correct").alias("correct"),
        F.count_if(F.col("outcome").isin("error", "no_gold")).alias("pred_errors"),
        F.count_if(F.col("outcome") == "wrong").alias("wrong_results"),
        F.count_if(F.col("outcome") == "no_gold").alias("no_gold"))


def first_failures(details: DataFrame, n: int = 5, by: str = "model", order: str = "pred_id") -> DataFrame:
    """The first ``n`` failed and the first ``n`` wrong predictions per model.

    Each task keeps its own first ones before the shuffle.
    """
    group = F.when(F.col("error").isNotNull(), "error").otherwise("wrong")
    w = Window.partitionBy(by, "group").orderBy(order)
    return details.where(~F.col("correct")).withColumn("group", group).withColumn(
        "place", F.row_number().over(w)).where(F.col("place") <= n)


def id_overlap(pred: DataFrame, gold: DataFrame, by: str = "model") -> DataFrame:
    """Per model: distinct gold ids it has a prediction for, and whether it can be scored at all."""
    ids = gold.select("instance_id").distinct()
    # A scalar subquery: counted in the same job.
    n_gold = ids.agg(F.count(F.lit(1))).scalar()
    seen = pred.select(by, "instance_id").distinct().join(ids.withColumn("_gold", F.lit(True)), "instance_id", "left")
    return seen.groupBy(by).agg(F.count("_gold").alias("matched")).select(
        by, "matched", n_gold.alias("gold"), (F.col("matched") > 0).alias("scored"))


PRED = ["pred_id", "model", "pos", "instance_id", "sql_answer", "n_rows", "n_cols", "error"]


def stored_answers(files: dict[str, DataFrame], questions: DataFrame,
                   saved: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(pred, cells)`` of all models, from JSON records and from saved tables; keyed by model and position."""
    parts = []
    if "standard" in files:
        parts.append(parsed_answers(files["standard"].select(
            "model", "pos", "instance_id", F.coalesce("sql_answer", F.lit("")).alias("sql_answer"), "exec_answer")))
    if "reparsed" in files:
        rows = reparsed(files["reparsed"], questions).select("model", "pos", "instance_id", "sql_answer", "exec_answer")
        parts.append(parsed_answers(rows, unreadable=UNPARSEABLE))
    pred = cells = None
    if parts:
        both = reduce(DataFrame.unionByName, parts).withColumn("pred_id", F.struct("model", "pos"))
        # The JSON texts are taken apart once; the cells are read several times from here on.
        cells = staged(answer_cells(both, "pred_id"), "cells")
        pred = staged(both.select(*PRED), "answers")
    if saved:
        rows = saved[0].withColumn("pred_id", F.struct("model", "pos"))
        keyed = saved[1].join(rows.select("model", "instance_id", "pred_id"), ["model", "instance_id"]).drop("model", "instance_id")
        rows = rows.select(*[F.col(c).cast("int") if c == "n_cols" else F.col(c) for c in PRED])
        pred = rows if pred is None else pred.unionByName(rows)
        cells = keyed if cells is None else cells.unionByName(keyed)
    if pred is None:
        raise ValueError("no predictions of any model")
    return pred, cells


def score_files(files: dict[str, DataFrame], questions: DataFrame, gold: DataFrame, gold_cells: DataFrame,
                saved: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Verdicts of all models from their stored predictions; models without a known id are left out."""
    pred, cells = stored_answers(files, questions, saved)
    known = id_overlap(pred, gold).where("scored").select("model")
    return verdicts(pred.join(known, "model", "left_semi"), cells, gold, gold_cells)


def first_rows(cells: DataFrame, key: str, n: int = 3) -> DataFrame:
    """``key, rows``: the first rows of an answer as texts, cells joined by a comma."""
    value = F.coalesce("str", F.col("num").cast("string"), F.lit("NULL"))
    lines = cells.where(F.col("row_idx") < n).groupBy(key, "row_idx").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("col_idx", value.alias("v")))), lambda c: c["v"]), ", ").alias("line"))
    return lines.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda r: r["line"]).alias("rows"))


def failure_report(details: DataFrame, questions: DataFrame, pred_cells: DataFrame, gold_cells: DataFrame, n: int = 5) -> DataFrame:
    """The first failed and wrong predictions of each model with both statements and the first rows of both answers."""
    failures = staged(first_failures(details, n), "failures")
    gold = gold_sql(questions).select(F.col("pos").alias("gold_id"), F.col("gold").alias("gold_sql"))
    mine = first_rows(pred_cells.join(failures.select("pred_id"), "pred_id", "left_semi"), "pred_id")
    theirs = first_rows(gold_cells.join(failures.select("gold_id"), "gold_id", "left_semi"), "gold_id")
    return (failures.join(gold, "gold_id", "left").join(mine.withColumnRenamed("rows", "pred_rows"), "pred_id", "left")
            .join(theirs.withColumnRenamed("rows", "gold_rows"), "gold_id", "left")
            .select("model", "group", "place", "instance_id", "error", "sql_answer", "gold_sql", "pred_rows", "gold_rows"))


@dataclass
class ScoreRun:
    """What a scoring job gives: verdicts, and the reports made of them."""

    details: DataFrame
    overlap: DataFrame
    breakdown: DataFrame
    failures: DataFrame
    scoreboard: DataFrame
    gold: DataFrame


def score_run(spark: SparkSession, questions: DataFrame, folder: str, models: list[str],
              databases: dict[str, dict[str, str]], workers: int = 4) -> ScoreRun:
    """Questions to scores: run the gold statements, read every model's predictions, compare and report.

    A model's predictions are its saved tables, else its JSON record. Verdicts are staged: all
    reports read them.
    """
    answers, answer_rows, summary = gold_answers(spark, questions, databases, workers)
    gold = staged(answers.withColumnRenamed("pos", "gold_id"), "gold")
    gold_cells = staged(answer_rows.withColumnRenamed("pos", "gold_id"), "gold-cells")
    saved = load_predictions(spark, folder, models)
    names = {r["model"] for r in saved[0].select("model").distinct().collect()} if saved else set()
    files = read_predictions(spark, folder, [m for m in models if m not in names])
    pred, cells = stored_answers(files, questions, saved)
    overlap = id_overlap(pred, gold)
    details = staged(verdicts(
        pred.join(overlap.where("scored").select("model"), "model", "left_semi"), cells, gold, gold_cells), "verdicts")
    return ScoreRun(details, overlap, breakdown(details), failure_report(details, questions, cells, gold_cells),
                    scoreboard(details, ["model"]), summary)
