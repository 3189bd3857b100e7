import random

import pytest

from gridsmith.operators import describe as D


def brute(rows, n):
    """Per column the first distinct values of rows in the order of their key."""
    ordered = [r[1:] for r in sorted(rows, key=lambda r: tuple((v is not None, v) for v in r[0]))]
    out = set()
    for c in range(len(rows[0]) - 1):
        values = dict.fromkeys(r[c] for r in ordered if r[c] is not None)
        out |= {(c, rank + 1, v) for rank, v in enumerate(list(values)[:n])}
    return out, [", ".join("NULL" if v is None else v for v in r) for r in ordered[:n]]


@pytest.mark.parametrize("n", [1, 3, 5])
def test_earliest_over_many_tasks(spark, n):
    """Rows in no order over tasks and batches, a struct and NULLs in the key, values that repeat, rare ones."""
    rng = random.Random(n)
    places = [(rng.choice([None, "a", "b"]), i) for i in range(4000)]
    rng.shuffle(places)
    rows = [(p, rng.choice(["x", "y", "it's", None]), str(rng.randrange(50)), None if rng.random() < 0.999 else f"rare {p[1]}", None) for p in places]
    table = spark.createDataFrame(rows, "place struct<file string, line int>, `a.b` string, b string, c string, d string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = D.earliest(table, ["place"], n, n).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    values, lines = brute(rows, n)
    assert {tuple(r) for r in got if r.idx != D.ROWS} == values
    assert [r.value for r in sorted(got, key=lambda r: r.rank) if r.idx == D.ROWS] == lines


def test_description_is_one_scan(spark, tmp_path):
    """Nothing runs before the row is asked for, and the plan reads the table once."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, f"it's {i % 2}", 0.5 * i) for i in range(9)], "k int, name string, v double").write.parquet(path)
    text = D.m_schema(spark.read.parquet(path), "t", ["k"], foreign_keys=["t.k=u.k"])
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("FileScan parquet") == 1
    assert text.first().text == (
        "【DB_ID】 t\n【Schema】\n# Table: t\n[\n(name:TEXT, Examples: [\"it's 0\", \"it's 1\"]),\n(v:REAL, Examples: [0.0, 0.5, 1.0]),\n]\n"
        "Sample rows from `t`:\nit's 0, 0.0\nit's 1, 0.5\nit's 0, 1.0\n【Foreign keys】\nt.k=u.k")


def test_description_of_no_rows(spark):
    """An empty table, and one whose rows repeat."""
    none = spark.createDataFrame([], "k int, name string")
    assert D.m_schema(none, "t", ["k"]).first().text == "【DB_ID】 t\n【Schema】\n# Table: t\n[\n(name:TEXT),\n]"
    same = spark.createDataFrame([(i, None, "s") for i in range(5)], "k int, n string, s string")
    assert D.m_schema(same, "t", ["k"], keys=["n"]).first().text == (
        "【DB_ID】 t\n【Schema】\n# Table: t\n[\n(n:TEXT, Primary Key),\n(s:TEXT, Examples: ['s']),\n]\nSample rows from `t`:\nNULL, s\nNULL, s\nNULL, s")
