import json
import random

import pytest
from pyspark.sql import functions as F

from gridsmith.functions import vocabulary as V
from gridsmith.operators import score as S
from gridsmith.operators.answers import answer_cells, parsed_answers, reparsed
from gridsmith.plans import scoring as P

E = {"error": "e"}
CASES = [
    # gold, predicted, statement, correct, error
    ([[1], [2]], [[2], [1]], "SELECT", True, None),
    ([[1], [2]], [[2], [1]], "SELECT x ORDER BY 1", False, None),
    ([[1], [2]], [[1], [2]], "SELECT x ORDER BY 1", True, None),
    ([[1]], [[1, "x"]], "SELECT", True, None),
    ([[1, "x"]], [[1]], "SELECT", False, None),
    ([[1, 1]], [[1]], "SELECT", True, None),
    ([[1, "a"], [2, "b"]], [[1, "b"], [2, "a"]], "SELECT", True, None),
    ([[1.0]], [[1.005]], "SELECT", True, None),
    ([[1.0]], [[1.02]], "SELECT", False, None),
    ([[10.0], [5]], [[9.999], [5]], "SELECT", True, None),
    ([[None]], [[None]], "SELECT", True, None),
    ([[None]], [[0]], "SELECT", False, None),
    ([[1]], [["1"]], "SELECT", False, None),
    ([[1], ["1"], [None]], [[None], ["1"], [1]], "SELECT", True, None),
    ([], [], "SELECT", True, None),
    ([], [[1]], "SELECT", False, None),
    ([[1]], [], "SELECT", False, None),
    (None, [[1]], "SELECT", False, "no gold found"),
    ([[1]], E, "SELECT", False, "e"),
    (E, [[1]], "SELECT", False, "invalid exec_answer format"),
    ([[True], [False]], [[0], [1]], "SELECT", True, None),
    ([["a"], ["a"], ["b"]], [["a"], ["b"], ["b"]], "SELECT", False, None),
    ([[1e12], [5]], [[1e12 + 500], [5]], "SELECT", True, None),
    ([[1, 2], [1, 2]], [[2, 1], [2, 1]], "SELECT", True, None),
]


def relations(spark, cases):
    preds = [(i, f"q{i}", c[2], json.dumps(c[1])) for i, c in enumerate(cases)]
    golds = [(i, f"q{i}", json.dumps(c[0])) for i, c in enumerate(cases) if c[0] is not None]
    pred = parsed_answers(spark.createDataFrame(preds, "pred_id int, instance_id string, sql_answer string, exec_answer string"))
    gold = parsed_answers(spark.createDataFrame(golds, "gold_id int, instance_id string, exec_answer string"))
    gold = gold.withColumn("n_rows", F.when(F.col("error").isNull(), F.col("n_rows")))
    return (pred.drop("answer_rows"), answer_cells(pred, "pred_id"), gold.drop("answer_rows"), answer_cells(gold, "gold_id"))


@pytest.mark.parametrize("chunk", [1_000_000, 0])
def test_verdicts(spark, monkeypatch, chunk):
    """The table of cases, once with columns sorted in one task, once with every column taken as long."""
    monkeypatch.setattr(S, "ROWS_PER_CHUNK", chunk or 1)
    got = {r.pred_id: (r.correct, r.error) for r in P.verdicts(*relations(spark, CASES)).collect()}
    for i, case in enumerate(CASES):
        assert got[i] == case[3:], case
    board = P.scoreboard(P.verdicts(*relations(spark, CASES))).first()
    assert (board.correct, board.total) == (sum(c[3] for c in CASES), len(CASES))


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= max(V.REL_TOLERANCE * max(abs(a), abs(b)), V.ABS_TOLERANCE)
    return a == b


def matches(gold, pred, ordered):
    if not gold or not pred:
        return not gold and not pred
    if len(gold) != len(pred):
        return False

    def key(x):
        return (x is None, isinstance(x, str), x if x is not None else 0)

    def same(a, b):
        if not ordered:
            a, b = sorted(a, key=key), sorted(b, key=key)
        return all(close(x, y) for x, y in zip(a, b))

    return all(any(same(list(g), list(p)) for p in zip(*pred)) for g in zip(*gold))


def test_random_answers_against_brute_force(spark, monkeypatch):
    """Small values with ties and near ties, NULLs, texts; rows shuffled, columns moved; a hot value."""
    monkeypatch.setattr(S, "ROWS_PER_CHUNK", 4)
    rng = random.Random(2)
    cases = []
    for _ in range(300):
        n, w = rng.randint(0, 9), rng.randint(1, 3)

        def cell():
            return rng.choice([0, 0, 0, None, "a", "b", rng.choice([1, 1.004, 1.008, 1.02, -3, 250.5])])

        gold = [[cell() for _ in range(w)] for _ in range(n)]
        pred = [[(v + rng.choice([0, 0.004, -0.004]) if isinstance(v, (int, float)) else v) for v in row] for row in gold]
        if rng.random() < 0.3 and pred:
            pred[0][0] = cell()
        if rng.random() < 0.5:
            rng.shuffle(pred)
        columns = list(range(w))
        rng.shuffle(columns)
        pred = [[row[c] for c in columns] + (["x"] if rng.random() < 0 else []) for row in pred]
        sql = rng.choice(["SELECT", "SELECT ORDER BY 1"])
        cases.append((gold, pred, sql, matches(gold, pred, "ORDER" in sql), None))
    got = {r.pred_id: r.correct for r in P.verdicts(*relations(spark, cases)).collect()}
    for i, case in enumerate(cases):
        assert got[i] == case[3], case
    assert 30 < sum(c[3] for c in cases) < 270


def test_short_columns_are_compared_as_lists(spark, monkeypatch):
    """Short columns are never ranked over tasks; long ones are, also beside short ones, with the same verdicts."""
    rank, ranked = S.rank_cells, []
    monkeypatch.setattr(S, "rank_cells", lambda cells, key: ranked.append(key) or rank(cells, key))
    cases = CASES + [([["x" * 300], [None], ["a"]], [["a"], ["x" * 300], [None]], "SELECT", True, None)]
    for cells, chars, n in ((10_000, 1 << 20, 0), (2, 1 << 20, 2), (10_000, 100, 2), (0, 0, 2)):
        monkeypatch.setattr(S, "SHORT_CELLS", cells)
        monkeypatch.setattr(S, "SHORT_TEXT", chars)
        ranked.clear()
        got = {r.pred_id: (r.correct, r.error) for r in P.verdicts(*relations(spark, cases)).collect()}
        assert [got[i] for i in range(len(cases))] == [c[3:] for c in cases] and len(ranked) == n


def test_reflexive_and_blind_to_added_columns(spark):
    rng = random.Random(4)
    cases = []
    for _ in range(60):
        gold = [[rng.choice([1, 2.5, "a", None]) for _ in range(3)] for _ in range(rng.randint(1, 6))]
        moved = [row + ["more"] for row in gold]
        rng.shuffle(moved)
        cases += [(gold, gold, "SELECT ORDER BY", True, None), (gold, moved, "SELECT", True, None)]
    assert P.verdicts(*relations(spark, cases)).where("NOT correct").count() == 0


def test_last_gold_and_repeated_predictions(spark):
    pred, pred_cells, gold, gold_cells = relations(spark, [([[1]], [[2]], "SELECT", None, None), ([[2]], [[2]], "SELECT", None, None)])
    one = pred.withColumn("instance_id", F.lit("q"))
    details = P.verdicts(one, pred_cells, gold.withColumn("instance_id", F.lit("q")), gold_cells)
    assert details.where("correct").count() == 2


def test_reparsed(spark):
    questions = spark.createDataFrame(
        [(0, "d", "a", 5), (1, "d", "", 6), (2, "d", None, 6), (3, "d", "z", None)],
        "pos int, db_id string, instance_id string, index int")
    rows = [(5, "d", "s", "[1, 2]"), (6, "d", None, "[[1],[2,3]]"), (9, "e", "s", "{bad"), (None, None, "s", "[]"),
            (5, "d", "s", '{"error":"x"}'), (5, "d", "s", '["a",true,null]')]
    df = reparsed(spark.createDataFrame(rows, "index int, db_id string, sql string, result string").withColumn(
        "n", F.monotonically_increasing_id()), questions)
    parsed = parsed_answers(df, unreadable="unparseable result")
    got = {r.n: r for r in parsed.collect()}
    byid = [got[k] for k in sorted(got)]
    assert [r.instance_id for r in byid] == ["a", "d_2", "e_9", "unknown_None", "a", "a"]
    assert [r.error for r in byid] == [None, None, "unparseable result", None, "x", None]
    assert [(r.n_rows, r.n_cols) for r in byid] == [(2, 1), (2, 2), (None, None), (0, 0), (None, None), (3, 1)]
    cells = {(r.row_idx, r.col_idx): (r.num, r.str) for r in answer_cells(parsed.where(F.col("instance_id") == "d_2"), "n").collect()}
    assert cells == {(0, 0): (1, None), (0, 1): (None, None), (1, 0): (2, None), (1, 1): (3, None)}


def test_breakdown(spark):
    rows = [("m", 1, True, None), ("m", 2, False, "no gold found"), ("m", 3, False, "e"), ("m", 4, False, None)]
    df = spark.createDataFrame(rows, "model string, pred_id int, correct boolean, error string")
    assert P.breakdown(df).first().asDict() == {"model": "m", "correct": 1, "pred_errors": 2, "wrong_results": 1, "no_gold": 1}
    first = {(r.group, r.pred_id) for r in P.first_failures(df, 1).collect()}
    assert first == {("error", 2), ("wrong", 4)}


def test_answers_are_parsed_once(spark):
    """No filter on what the parser gives is pushed below it, where it would parse every answer again."""
    stored = spark.range(9).select("id", F.concat(F.lit("[[1,"), F.col("id").cast("string"), F.lit("]]")).alias("exec_answer"))
    plan = answer_cells(parsed_answers(stored), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_cells_of_odd_answers(spark):
    """Short, empty and missing rows: padded with NULL; no cell of an answer without rows or columns."""
    texts = ["[]", "[[]]", "[[1],[2,\"a\",true]]", "[[],[3]]", "[null,4]", None, "{bad", '{"error":"e"}', "[[5],null]"]
    stored = spark.createDataFrame(list(enumerate(texts)), "k int, exec_answer string")
    got = {(r.k, r.row_idx, r.col_idx): (r.num, r.str) for r in answer_cells(parsed_answers(stored), "k").collect()}
    none = (None, None)
    assert got == {
        (2, 0, 0): (1.0, None), (2, 0, 1): none, (2, 0, 2): none, (2, 1, 0): (2.0, None), (2, 1, 1): (None, "a"), (2, 1, 2): (1.0, None),
        (3, 0, 0): none, (3, 1, 0): (3.0, None), (4, 0, 0): none, (4, 1, 0): (4.0, None), (8, 0, 0): (5.0, None), (8, 1, 0): none}
