"""Scoring: a gold answer per customer (its orders) and predictions that differ in a known way."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import case, query, table
from gridsmith.functions.equality import values_equal
from gridsmith.functions.statements import is_ordered
from gridsmith.operators import score as S
from gridsmith.operators.answers import UNPARSEABLE, answer_cells, parsed_answers, reparsed
from gridsmith.operators.ordering import positions
from gridsmith.plans import scoring as P
from gridsmith.session import fresh_path, staged
from gridsmith.sources import records


def _number(c):
    return F.struct(c.cast("double").alias("num"), F.lit(None).cast("string").alias("str"))


def _text(c):
    return F.struct(F.lit(None).cast("double").alias("num"), c.cast("string").alias("str"))


def order_rows(spark, sf):
    """Orders with their place among, and the number of, their customer's orders. They are read several times, so they are written once."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice", "o_orderstatus",
        F.floor(F.col("o_orderkey") / 1_000_000).alias("_chunk"))
    placed = positions(orders, ["k"], [["_chunk"]], ["o_orderkey"], "row_idx").drop("_chunk")
    return staged(placed.join(orders.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k"))


def gold_side(spark, sf, orders=None):
    """Stored answers and cells of customers, but for every fiftieth, which has no gold; every 41st failed."""
    rows = (orders or order_rows(spark, sf)).where("k % 50 <> 49")
    answers = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.col("k").alias("gold_id"), F.concat(F.lit("q"), F.col("k").cast("string")).alias("instance_id"),
        F.when(F.col("k") % 41 != 40, F.col("n_rows")).alias("n_rows"), F.lit(3).alias("n_cols"),
        F.when(F.col("k") % 41 == 40, "gold failed").alias("error"))
    cells = rows.where("k % 41 <> 40").select(F.col("k").alias("gold_id"), "row_idx", F.posexplode(F.array(
        _number(F.col("o_orderkey")), _number(F.col("o_totalprice")), _text(F.col("o_orderstatus")))).alias("col_idx", "c"))
    cells = cells.select("gold_id", "row_idx", "col_idx", "c.num", "c.str")
    return staged(answers), staged(cells)


MODELS = [("alpha", 0), ("beta", 4)]


def pred_side(spark, sf):
    """Per model, by shifted key modulo 9: as it is, reversed, reversed under ORDER BY, off by 0.005, off
    by 0.02, one column more, one row less, one column less, failed."""
    rows = order_rows(spark, sf)
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(o).alias("shift")) for m, o in MODELS]))
    rows = rows.select("*", models.alias("m")).select(
        "*", "m.model", ((F.col("k") + F.col("m.shift")) % 9).alias("way")).drop("m")
    rows = rows.withColumn("pred_id", F.concat_ws("/", "model", F.col("k").cast("string")))
    kept = rows.where("NOT (way = 6 AND row_idx = 0) AND way <> 8")
    at = F.when(F.col("way").isin(1, 2), F.col("n") - 1 - F.col("row_idx")).when(
        F.col("way") == 6, F.col("row_idx") - 1).otherwise(F.col("row_idx"))
    price = F.col("o_totalprice") + F.when(F.col("way") == 3, 0.005).when(F.col("way") == 4, 0.02).otherwise(0.0)
    base = [_number(F.col("o_orderkey")), _number(price)]
    status = _text(F.col("o_orderstatus"))
    extra = _text(F.lit("x"))
    wide = F.when(F.col("way") == 7, F.array(*base)).when(F.col("way") == 5, F.array(extra, *base, status)).otherwise(
        F.array(*base, status))
    cells = kept.select("pred_id", at.alias("row_idx"), F.posexplode(wide).alias("col_idx", "c")).select(
        "pred_id", "row_idx", "col_idx", "c.num", "c.str")
    sql = F.when(F.col("way") == 2, "SELECT * FROM t order  by x").otherwise("SELECT * FROM t")
    n_rows = F.when(F.col("way") == 6, F.col("n") - 1).otherwise(F.col("n"))
    answers = rows.where("row_idx = 0").select(
        "pred_id", "model", F.concat(F.lit("q"), F.col("k").cast("string")).alias("instance_id"), sql.alias("sql_answer"),
        F.when(F.col("way") != 8, n_rows).alias("n_rows"),
        F.when(F.col("way") == 5, 4).when(F.col("way") == 7, 2).otherwise(3).alias("n_cols"),
        F.when(F.col("way") == 8, "no such column").alias("error"))
    return staged(answers), staged(cells)


WAYS = """WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
    m AS (SELECT model, k, n, (k + shift) % 9 AS way FROM c, (VALUES ('alpha', 0), ('beta', 4)) v(model, shift)),
    v AS (SELECT *, CASE WHEN k % 50 = 49 THEN 'no gold found' WHEN way = 8 THEN 'no such column'
                         WHEN k % 41 = 40 THEN 'invalid exec_answer format' END AS error FROM m),
    d AS (SELECT model, k, way, n, error, error IS NULL AND (way IN (0, 1, 3, 5) OR way = 2 AND n = 1) AS correct FROM v) """


@query("value_equality", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 8 IN (0, 1, 4, 6) AS equal FROM lineitem""")
def value_equality(spark, sf):
    """Equal, within and beyond tolerance, NULL on one side and both, relative tolerance, number against text, NaN."""
    way = F.col("l_partkey") % 8
    price = F.col("l_extendedprice")
    none = F.lit(None).cast("double")
    a = case(way, price, price, price, price, none, price, price * 1e9, F.lit(float("nan")))
    b = case(way, price, price + 0.005, price + 0.02, none, none, none, price * 1e9 * (1 + 5e-10), F.lit(float("nan")))
    text = F.when(way == 5, price.cast("string"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", values_equal(a, F.lit(None).cast("string"), b, text).alias("equal"))


@query("column_ranks", """
    SELECT user_id AS id, (row_number() OVER (PARTITION BY user_id ORDER BY v NULLS LAST) - 1)::BIGINT AS rank, v AS num
    FROM (SELECT user_id, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 = 4 THEN 0 ELSE value - 100 END AS v FROM events)""")
def column_ranks(spark, sf):
    """One column per user, sorted on its own; a sixth NULL, a sixth the same value."""
    key = F.col("event_id")
    cells = table(spark, sf, "events").select(
        F.col("user_id").alias("id"), key.alias("row_idx"), F.lit(0).alias("col_idx"),
        F.when(key % 6 == 5, None).when(key % 6 == 4, 0.0).otherwise(F.col("value") - 100).alias("num"),
        F.lit(None).cast("string").alias("str"))
    return S.rank_cells(cells, "id").select("id", "rank", "num")


def scored_pairs(spark, sf):
    pred, pred_cells = pred_side(spark, sf)
    gold, gold_cells = gold_side(spark, sf)
    pairs = pred.where("n_rows IS NOT NULL").join(
        P.last_gold(gold).where("gold_rows IS NOT NULL"), "instance_id").select(
        "pred_id", "gold_id", is_ordered(F.col("sql_answer")).alias("ordered"),
        F.col("n_rows").alias("pred_rows"), "gold_rows", "gold_cols")
    return pairs, pred_cells, gold_cells


@query("matching_columns", WAYS + """
    SELECT model || '/' || k AS pred_id, k AS gold_id, g::INTEGER AS gcol, CASE WHEN way = 5 THEN g + 1 ELSE g END::INTEGER AS pcol
    FROM v, range(3) r(g) WHERE error IS NULL AND way <> 6 AND NOT (way = 7 AND g = 2) AND NOT (way = 4 AND g = 1)
      AND (way <> 2 OR n = 1 OR g = 2 AND k IN (
        SELECT o_custkey FROM (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS l,
                                      list(o_orderstatus ORDER BY o_orderkey DESC) AS r FROM orders GROUP BY 1) WHERE l = r))""")
def matched_columns(spark, sf):
    pairs, pred_cells, gold_cells = scored_pairs(spark, sf)
    comparable = pairs.where("pred_rows = gold_rows AND gold_rows > 0")
    return S.matching_columns(comparable, pred_cells, gold_cells)


@query("compared_results", WAYS + "SELECT model || '/' || k AS pred_id, k AS gold_id, correct FROM d WHERE error IS NULL")
def compared_results(spark, sf):
    pairs, pred_cells, gold_cells = scored_pairs(spark, sf)
    return S.compare_results(pairs, pred_cells, gold_cells)


@query("order_sensitivity", """
    SELECT conv_id, turn, turn % 4 IN (0, 2) AS ordered FROM conversations""")
def order_sensitivity(spark, sf):
    """Whole turns as statements: a sort at the end, a similar word, a sort in a window, nothing."""
    way = F.col("turn") % 4
    tail = case(way, "\nORDER\t BY 1", "\nborder by 2", " OVER (order by x) ", "")
    text = F.regexp_replace("text", "(?i)order", "sort")
    return table(spark, sf, "conversations").select("conv_id", "turn", is_ordered(F.concat(text, tail)).alias("ordered"))


def all_verdicts(spark, sf):
    pred, pred_cells = pred_side(spark, sf)
    gold, gold_cells = gold_side(spark, sf)
    return P.verdicts(pred, pred_cells, gold, gold_cells)


@query("execution_accuracy", WAYS + "SELECT model, 'q' || k AS instance_id, correct, error FROM d")
def verdicts(spark, sf):
    return all_verdicts(spark, sf).select("model", "instance_id", "correct", "error")


@query("scoreboard", WAYS + """
    SELECT model, round(count(*) FILTER (correct) / count(*), 4) AS score, count(*) FILTER (correct) AS correct, count(*) AS total
    FROM d GROUP BY model""")
def scoreboard(spark, sf):
    return P.scoreboard(all_verdicts(spark, sf), ["model"])


@query("outcome_breakdown", WAYS + """
    SELECT model, count(*) FILTER (correct) AS correct, count(*) FILTER (error IS NOT NULL) AS pred_errors,
           count(*) FILTER (error IS NULL AND NOT correct) AS wrong_results, count(*) FILTER (error = 'no gold found') AS no_gold
    FROM d GROUP BY model""")
def outcome_breakdown(spark, sf):
    return P.breakdown(all_verdicts(spark, sf))


@query("first_failures", WAYS + """
    SELECT model, grp AS "group", CAST(place AS INTEGER) AS place, 'q' || k AS instance_id FROM (
      SELECT model, k, CASE WHEN error IS NOT NULL THEN 'error' ELSE 'wrong' END AS grp,
             row_number() OVER (PARTITION BY model, error IS NOT NULL ORDER BY model || '/' || k) AS place FROM d WHERE NOT correct)
    WHERE place <= 5""")
def first_failures(spark, sf):
    return P.first_failures(all_verdicts(spark, sf)).select("model", "group", "place", "instance_id")


@query("id_overlap", WAYS + """
    SELECT model, count(*) FILTER (k % 50 <> 49) AS matched, (SELECT count(*) FROM c WHERE k % 50 <> 49) AS gold, true AS scored
    FROM d GROUP BY model""")
def id_overlap(spark, sf):
    return P.id_overlap(pred_side(spark, sf)[0], gold_side(spark, sf)[0])


def reparsed_rows(spark, sf):
    """A stored answer per customer: flat list, ragged rows, broken text, an object, an empty list, nothing."""
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("index")).agg(
        F.array_sort(F.collect_list("o_orderkey")).alias("keys"), F.min("o_orderstatus").alias("s"))
    ragged = F.concat(F.lit("[["), F.array_join(F.transform("keys", lambda k: k.cast("string")), "],["),
                      F.lit("],[true,\""), F.col("s"), F.lit("\",null]]"))
    return rows.select(
        F.when(F.col("index") % 7 != 6, F.col("index")).alias("index"), F.lit("db").alias("db_id"),
        F.lit("SELECT 1").alias("sql"),
        case(F.col("index") % 6, F.to_json("keys"), ragged, "{bad", '{"error": "timeout"}', "[]", None).alias("result"),
        F.col("index").alias("k"))


def indexed_questions(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("pos"), F.lit("db").alias("db_id"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("id"), F.col("c_custkey").cast("string"))).alias("instance_id"),
        F.when(F.col("c_custkey") % 10 != 9, F.col("c_custkey")).alias("index"))


REPARSED = """WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
    p AS (SELECT k, n, CASE WHEN k % 7 = 6 THEN 'db_None' WHEN k % 10 = 9 THEN 'db_' || k WHEN k % 3 = 0 THEN 'id' || k ELSE 'db_' || k END AS instance_id FROM o) """


@query("reparsed_predictions", REPARSED + """
    SELECT k, instance_id, CASE k % 6 WHEN 0 THEN n WHEN 1 THEN n + 1 WHEN 4 THEN 0 WHEN 5 THEN 0 END AS n_rows,
           CAST(CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 4 THEN 0 WHEN 5 THEN 0 END AS INTEGER) AS n_cols,
           CASE k % 6 WHEN 2 THEN 'unparseable result' WHEN 3 THEN 'timeout' END AS error FROM p""")
def reparsed_predictions(spark, sf):
    rows = reparsed(reparsed_rows(spark, sf), indexed_questions(spark, sf))
    return parsed_answers(rows, unreadable=UNPARSEABLE).select("k", "instance_id", "n_rows", "n_cols", "error")


@query("reparsed_cells", """
    WITH r AS (SELECT o_custkey AS k, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i,
                      count(*) OVER (PARTITION BY o_custkey) AS n, min(o_orderstatus) OVER (PARTITION BY o_custkey) AS s FROM orders)
    SELECT k, i AS row_idx, c::INTEGER AS col_idx, CASE WHEN c = 0 THEN o_orderkey::DOUBLE END AS num, NULL::VARCHAR AS str
    FROM r, range(3) t(c) WHERE k % 6 = 1 OR k % 6 = 0 AND c = 0
    UNION ALL SELECT DISTINCT k, n, c::INTEGER, CASE WHEN c = 0 THEN 1::DOUBLE END, CASE WHEN c = 1 THEN s END FROM r, range(3) t(c) WHERE k % 6 = 1""")
def reparsed_cells(spark, sf):
    parsed = parsed_answers(reparsed(reparsed_rows(spark, sf), indexed_questions(spark, sf)))
    return answer_cells(parsed, "k")


@query("scored_files", WAYS + """
    SELECT 'alpha' AS model, round(count(*) FILTER (k % 3 <> 2) / count(*), 4) AS score, count(*) FILTER (k % 3 <> 2) AS correct, count(*) AS total
    FROM c WHERE k % 50 <> 49
    UNION ALL SELECT 'beta', round(count(*) FILTER (k % 4 = 0) / count(*), 4), count(*) FILTER (k % 4 = 0), count(*) FROM c WHERE k % 50 <> 49""")
def scored_files(spark, sf):
    """Stored predictions of two models, one per layout, scored against gold; a third has only unknown ids."""
    orders = order_rows(spark, sf)
    gold, gold_cells = gold_side(spark, sf, orders)
    gold = gold.withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("bigint")))
    rows = orders.where("k % 50 <> 49")
    answers = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("row_idx", F.array(
        F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))).alias("r")))).alias("l"))
    body = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: F.concat(
        F.lit("["), F.array_join(x["r"], ","), F.lit("]"))), ","), F.lit("]"))
    # Three files and the questions are made of these.
    answers = staged(answers.select("k", F.when(F.col("k") % 41 == 40, "[]").otherwise(body).alias("body")))
    body = F.col("body")
    path = fresh_path(spark, "predictions")
    iid = F.concat(F.lit("q"), F.col("k").cast("string"))
    # Written as text lines, so that the answer stays a JSON list inside the record.
    record = F.concat(F.lit('{"instance_id":"'), iid, F.lit('","sql_answer":"SELECT 1","exec_answer":'),
                      F.when(F.col("k") % 3 != 2, body).otherwise('[["wrong"]]'), F.lit("}"))
    answers.select(record.alias("value")).write.text(f"{path}/alpha.json")
    answers.select(F.col("k").alias("index"), F.lit("db").alias("db_id"), F.lit("SELECT 1").alias("sql"),
                   F.when(F.col("k") % 4 == 0, body).otherwise("{bad").alias("result")).write.json(f"{path}/beta.reparsed.json")
    answers.select(F.lit("stray").alias("instance_id"), F.lit("").alias("sql_answer")).write.json(f"{path}/gamma.json")
    asked = answers.select(F.col("k").alias("pos"), F.lit("db").alias("db_id"), iid.alias("instance_id"), F.col("k").alias("index"))
    details = P.score_files(records.read_predictions(spark, path, ["alpha", "beta", "gamma", "delta"]), asked, gold, gold_cells)
    return P.scoreboard(details, ["model"])
