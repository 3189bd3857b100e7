from gridsmith.operators.typing import drop_duplicates


def test_two_order_columns(spark):
    big = (1 << 62) + 12345
    rows = [("a", 7, 5), ("a", 3, big), ("a", 3, big + 1), ("b", (1 << 50) + 1, 0), ("c", 0, 0), ("c", 0, 1), ("d", 2, (1 << 63) - 1)]
    df = spark.createDataFrame(rows, "v string, block bigint, seq bigint")
    got = drop_duplicates(df, ["v"], ["block", "seq"])
    assert {tuple(r) for r in got.collect()} == {("a", 3, big), ("b", (1 << 50) + 1, 0), ("c", 0, 0), ("d", 2, (1 << 63) - 1)}
    plan = got._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan
