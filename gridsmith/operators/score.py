"""Comparing answers: which predicted result sets hold every gold column.

Answers are cells ``<id>, row_idx, col_idx, num, str``. No result set is ever gathered in one task:
column summaries are aggregated map-side, and only column pairs that the summaries leave possible
are compared: short columns as lists, one value each, long ones row by row in a join spread over
row positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions import vocabulary as V
from gridsmith.functions.equality import values_equal
from gridsmith.operators.ordering import positions
from gridsmith.session import staged

ROWS_PER_CHUNK = 1_000_000
# Columns of so many cells and bytes of text at most are compared as lists.
SHORT_CELLS, SHORT_TEXT = 10_000, 1 << 20


def row_block(place: str) -> Column:
    """Blocks of rows as part of a join key: a long column is spread over as many tasks as it has
    blocks, a short one has a single block."""
    return F.floor(F.col(place) / ROWS_PER_CHUNK)


def with_blocks(columns: DataFrame) -> DataFrame:
    """One row per column of ``n`` cells and block of rows."""
    last = F.floor((F.col("n") - 1) / ROWS_PER_CHUNK)
    return columns.withColumn("_rows", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))


def rank_cells(cells: DataFrame, key: str) -> DataFrame:
    """Add ``rank``: place of each cell when its column is sorted on its own, NULL last.

    Numbers are ordered by value. The order key has two levels, a coarse bucket that rises with
    the value and the value itself with a block of rows, so neither a long column nor a value
    that fills a third of it is sorted in one task.
    """
    kind = F.when(F.col("num").isNotNull(), 0).when(F.col("str").isNotNull(), 1).otherwise(2)
    magnitude = F.signum("num") * F.floor(F.log1p(F.abs("num")) * 4096)
    bucket = F.coalesce(magnitude, F.pmod(F.xxhash64("str"), F.lit(4096)).cast("double"), F.lit(0.0))
    keyed = cells.select(
        "*", kind.alias("_kind"), bucket.alias("_bucket"), F.coalesce("num", F.lit(0.0)).alias("_num"),
        F.coalesce("str", F.lit("")).alias("_str"), row_block("row_idx").alias("_rows"))
    ranked = positions(
        keyed, [key, "col_idx"], [["_kind", "_bucket"], ["_num", "_str", "_rows"]], ["row_idx"], "rank")
    return ranked.select(*cells.columns, "rank")


def column_summary(cells: DataFrame, key: str) -> DataFrame:
    """Per column what every matching column must share, exactly or within tolerance."""
    num = F.col("num")
    text = F.when(num.isNull(), F.col("str"))
    return cells.groupBy(key, "col_idx").agg(
        F.count("num").alias("n_num"), F.count(text).alias("n_str"), F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or(F.isnan(num)), F.lit(False)).alias("has_nan"),
        F.min(num).alias("lo"), F.max(num).alias("hi"), F.sum(num).alias("total"), F.sum(F.abs(num)).alias("weight"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("text_bytes"),
        F.coalesce(F.bit_xor(F.xxhash64(text)), F.lit(0)).alias("text_xor"),
        # Twenty bits a cell: no column is long enough for the sum to overflow.
        F.sum(F.pmod(F.xxhash64(text, F.lit(1)), F.lit(1 << 20))).alias("text_sum"))


def _near(a: Column, b: Column, abs_tol: float, rel_tol: float) -> Column:
    slack = F.greatest(F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol)) * (1 + 1e-12)
    return (a == b) | (F.abs(a - b) <= slack)


def candidate_pairs(pairs: DataFrame, pred: DataFrame, gold: DataFrame, abs_tol: float, rel_tol: float) -> DataFrame:
    """``pred_id, gold_id, ordered, gcol, pcol, n, short``: column pairs that can still match, and whether both are short.

    All conditions are necessary ones, so nothing that matches is lost; the join is an equi-join on the
    answer and on the exact part of the summaries.
    """
    g = column_summary(gold, "gold_id").where("NOT has_nan")
    p = column_summary(pred, "pred_id").where("NOT has_nan")
    exact = ["n", "n_num", "n_str", "text_xor"]
    g = g.select("gold_id", F.col("col_idx").alias("gcol"), *exact,
                 F.struct("lo", "hi", "total", "weight", "text_sum", "text_bytes").alias("g"))
    p = p.select("pred_id", F.col("col_idx").alias("pcol"), *exact,
                 F.struct("lo", "hi", "total", "weight", "text_sum", "text_bytes").alias("p"))
    finite = ~F.col("g.total").isin(float("inf"), float("-inf")) & ~F.isnan("g.total") \
        & ~F.col("p.total").isin(float("inf"), float("-inf")) & ~F.isnan("p.total")
    # Largest sum of allowed differences, and what adding up in another order may change.
    room = F.col("n_num") * abs_tol + (rel_tol + 1e-9) * (F.col("g.weight") + F.col("p.weight"))
    sums = F.when(finite, F.abs(F.col("g.total") - F.col("p.total")) <= room).otherwise(True)
    numbers = (
        _near(F.col("g.lo"), F.col("p.lo"), abs_tol, rel_tol)
        & _near(F.col("g.hi"), F.col("p.hi"), abs_tol, rel_tol) & sums)
    return (
        pairs.select("pred_id", "gold_id", "ordered").join(g, "gold_id").join(p, ["pred_id", *exact])
        .where(F.col("g.text_sum").eqNullSafe(F.col("p.text_sum")))
        .where((F.col("n_num") == 0) | numbers)
        .select("pred_id", "gold_id", "ordered", "gcol", "pcol", "n", (
            (F.col("n") <= SHORT_CELLS) & (F.greatest("g.text_bytes", "p.text_bytes") <= SHORT_TEXT)).alias("short")))


def _placed(cells: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The wanted columns with ``rank``: row order as it is, or each column sorted on its own."""
    columns = [key, "col_idx", "ordered", "rank", "num", "str"]

    def pick(ordered: bool) -> DataFrame:
        keys = with_blocks(wanted.where(F.col("ordered") == F.lit(ordered)).select(key, "col_idx", "n").distinct())
        chosen = cells.select(key, "row_idx", "col_idx", "num", "str", row_block("row_idx").alias("_rows")).join(
            keys, [key, "col_idx", "_rows"], "left_semi")
        return chosen.drop("_rows").withColumn("ordered", F.lit(ordered))

    in_order = pick(True).withColumn("rank", F.col("row_idx"))
    return in_order.select(*columns).unionByName(rank_cells(pick(False), key).select(*columns))


def _lists(cells: DataFrame, key: str, col: str, candidates: DataFrame) -> DataFrame:
    """``key, col, cells``: the columns among the candidates as one value each. The aggregate keeps the join's
    partitioning, so cells are shuffled once."""
    keys = candidates.select(key, col).distinct()
    return cells.select(key, F.col("col_idx").alias(col), "row_idx", "num", "str").join(keys, [key, col], "left_semi").groupBy(
        key, col).agg(F.collect_list(F.struct("row_idx", "num", "str")).alias("cells"))


def _in_place(cells: Column) -> Column:
    """The cells of a list as ``struct(at, num, str)``: by row, or sorted on their own, NULL last."""
    kind = lambda x: F.when(x["num"].isNotNull(), 0).when(x["str"].isNotNull(), 1).otherwise(2)
    ranked = F.array_sort(F.transform(cells, lambda x: F.struct(kind(x).alias("kind"), x["num"].alias("num"), x["str"].alias("str"))))
    return F.when(F.col("ordered"), F.transform(F.array_sort(cells), lambda x: F.struct(
        x["row_idx"].cast("bigint").alias("at"), x["num"].alias("num"), x["str"].alias("str")))).otherwise(F.transform(
            ranked, lambda x: F.struct(F.lit(None).cast("bigint").alias("at"), x["num"].alias("num"), x["str"].alias("str"))))


def _short_verdicts(candidates: DataFrame, pred: DataFrame, gold: DataFrame, abs_tol: float, rel_tol: float) -> DataFrame:
    """``pred_id, gold_id, gcol, pcol, n, same, seen`` of short columns: two lists are compared, cell by cell."""
    theirs = candidates.join(_lists(gold, "gold_id", "gcol", candidates), ["gold_id", "gcol"]).select(
        "pred_id", "gold_id", "ordered", "gcol", "pcol", "n", _in_place(F.col("cells")).alias("theirs"))
    both = theirs.join(_lists(pred, "pred_id", "pcol", candidates), ["pred_id", "pcol"]).withColumn("mine", _in_place(F.col("cells")))
    same = F.forall(F.zip_with("mine", "theirs", lambda p, g: p["at"].eqNullSafe(g["at"]) & values_equal(
        p["num"], p["str"], g["num"], g["str"], abs_tol, rel_tol)), lambda x: x)
    return both.groupBy("pred_id", "gold_id", "gcol", "pcol", "n").agg(F.bool_and(same).alias("same"), F.sum(F.size("mine")).alias("seen"))


def _long_verdicts(candidates: DataFrame, pred: DataFrame, gold: DataFrame, abs_tol: float, rel_tol: float) -> DataFrame:
    """The same of columns of any length: cells are joined on their rank."""
    p = _placed(pred, "pred_id", candidates.withColumnRenamed("pcol", "col_idx"))
    g = _placed(gold, "gold_id", candidates.withColumnRenamed("gcol", "col_idx"))
    left = g.select("gold_id", F.col("col_idx").alias("gcol"), "ordered", "rank",
                    F.col("num").alias("gnum"), F.col("str").alias("gstr"))
    right = p.select("pred_id", F.col("col_idx").alias("pcol"), "ordered", "rank",
                     F.col("num").alias("pnum"), F.col("str").alias("pstr"))
    paired = left.withColumn("_rows", row_block("rank")).join(
        with_blocks(candidates), ["gold_id", "gcol", "ordered", "_rows"])
    aligned = paired.join(right, ["pred_id", "pcol", "ordered", "rank"])
    same = values_equal(F.col("pnum"), F.col("pstr"), F.col("gnum"), F.col("gstr"), abs_tol, rel_tol)
    return aligned.groupBy("pred_id", "gold_id", "gcol", "pcol", "n").agg(F.bool_and(same).alias("same"), F.count(F.lit(1)).alias("seen"))


def matching_columns(pairs: DataFrame, pred: DataFrame, gold: DataFrame, abs_tol: float = V.ABS_TOLERANCE,
                     rel_tol: float = V.REL_TOLERANCE) -> DataFrame:
    """``pred_id, gold_id, gcol, pcol``: the column pairs whose cells agree at every rank.

    The candidate pairs, a few short rows per answer, are written to the shared folder: they are
    needed on both sides. Only the ways that some pair needs are gone.
    """
    candidates = staged(candidate_pairs(pairs, pred, gold, abs_tol, rel_tol), "candidates")
    ways = {r["short"] for r in candidates.select("short").distinct().collect()}
    verdicts = [way(candidates.where(F.col("short") == F.lit(short)).drop("short"), pred, gold, abs_tol, rel_tol)
                for short, way in ((True, _short_verdicts), (False, _long_verdicts)) if short in ways or short and not ways]
    return reduce(DataFrame.unionByName, verdicts).where(F.col("same") & (F.col("seen") == F.col("n"))).select(
        "pred_id", "gold_id", "gcol", "pcol")


def compare_results(pairs: DataFrame, pred: DataFrame, gold: DataFrame, abs_tol: float = V.ABS_TOLERANCE,
                    rel_tol: float = V.REL_TOLERANCE) -> DataFrame:
    """``pred_id, gold_id, correct`` for ``pairs`` of answers.

    ``pairs`` holds ``pred_id, gold_id, ordered, pred_rows, gold_rows, gold_cols``. Two empty answers
    agree; otherwise the row counts must be equal and every gold column must equal some predicted
    one. Extra predicted columns do not matter.
    """
    comparable = pairs.where((F.col("pred_rows") == F.col("gold_rows")) & (F.col("gold_rows") > 0))
    found = matching_columns(comparable, pred, gold, abs_tol, rel_tol).groupBy("pred_id", "gold_id").agg(
        F.count_distinct("gcol").alias("_found"))
    both_empty = (F.col("pred_rows") == 0) & (F.col("gold_rows") == 0)
    return pairs.join(found, ["pred_id", "gold_id"], "left").select(
        "pred_id", "gold_id",
        (both_empty | (F.coalesce("_found", F.lit(0)) == F.col("gold_cols")) & (F.col("gold_rows") > 0)
         & (F.col("pred_rows") == F.col("gold_rows"))).alias("correct"))
