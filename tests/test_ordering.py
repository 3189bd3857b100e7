import random

from pyspark.sql import functions as F

from gridsmith.operators.batches import minibatches
from gridsmith.operators.ordering import numbered, positions


def test_positions_with_a_hot_group_and_a_hot_key(spark):
    """One group holds most rows and one key a third of them; positions are those of a full sort."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 5)}", 7 if rng.random() < 0.4 else rng.randint(0, 50), i)
            for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, k int, i int").withColumn("c", F.floor(F.col("k") / 10)).withColumn(
        "b", F.floor(F.col("i") / 100))
    got = positions(df, ["g"], [["c"], ["k", "b"]], ["i"], "at").collect()
    expected = {}
    for g in {r[0] for r in rows}:
        for at, (_, k, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))):
            expected[i] = at
    assert {r.i: r["at"] for r in got} == expected


def test_numbering_and_minibatches(spark):
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "pos")
    assert {r.pos: r["at"] for r in numbered(df, "pos", "at", 100).collect()} == {i * 3: i for i in range(1000)}
    sizes = minibatches(df, 64).groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in sizes) == [(b, min(64, 1000 - b * 64)) for b in range(16)]
