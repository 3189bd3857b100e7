import pytest
from pyspark.sql import functions as F

from gridsmith.operators import typing as T


def typed(spark, values, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    votes = T.profile(df, ["c"], **options).collect()
    out = T.apply_types(df, votes).orderBy("i").collect()
    return votes[0]["type"], votes[0]["style"], [r["c"] for r in out]


CASES = [
    (["12"] * 7 + ["abc"] * 3, "int", "plain", [12] * 7 + [None] * 3),
    (["12"] * 6 + ["abc"] * 3, "text", None, ["12"] * 6 + ["abc"] * 3),
    (list("0101234567"), "text", None, list("0101234567")),
    (list("0101"), "bool", None, [0, 1, 0, 1]),
    (["1,234", "2,500", "10,5"], "float", "us", [1234.0, 2500.0, 10.5]),
    (["1,234", "10,5"], "float", "mixed", [1.234, 10.5]),
    (["1.234", "5.678"], "float", "plain", [1.234, 5.678]),
    (["1.234,5", "2.000", "3.000,25"], "float", "vn", [1234.5, 2000.0, 3000.25]),
    (["1.234,0", "2.000", "3.000,00"], "int", "vn", [1234, 2000, 3000]),
    (["007", "12", "15"], "text", None, ["007", "12", "15"]),
    (["05/01/2024", "06/01/2024 10:00"], "date", None, ["2024-01-05 00:00:00", "2024-01-06 10:00:00"]),
    (["05/01/2024", "6.1.2024", "2024-01-07", "?"], "date", None, ["2024-01-05", "2024-01-06", "2024-01-07", "?"]),
    ([None, None], "text", "plain", [None, None]),
    (["50%", "7 %", "10%", "12"], "percentage", None, [0.5, 0.07, 0.1, 12.0]),
    (["$5", "€1,000", "7 USD", "x"], "currency", None, [5.0, 1000.0, 7.0, None]),
    (["2", "3", "4", "5", "6", "7", "8", "1", "+9", "1e2"], "int", "plain", [2, 3, 4, 5, 6, 7, 8, 1, 9, 100]),
    (["Có", "không", "có", "maybe"], "bool", None, [1, 0, 1, None]),
    (["1.5"] * 8 + ["0", "1"], "float", "plain", [1.5] * 8 + [0.0, 1.0]),
]


@pytest.mark.parametrize("values, kind, style, expected", CASES)
def test_votes(spark, values, kind, style, expected):
    got = typed(spark, values)
    assert got[0] == kind and got[2] == expected
    assert style is None or got[1] == style


def test_bool_digits_option(spark):
    assert typed(spark, list("0101234567"), bool_digits=False)[0] == "int"


def test_big_whole_numbers_stay_float(spark):
    assert typed(spark, ["9007199254740993", "9007199254740995"])[0] == "float"


def test_typed_dates(spark):
    df = spark.createDataFrame([("05/01/2024",), ("6/1/2024",)], "c string")
    votes = T.profile(df, ["c"]).collect()
    assert dict(T.apply_types(df, votes, typed_dates=True).dtypes) == {"c": "date"}


def test_currency_is_noted_in_the_metadata(spark):
    df = spark.createDataFrame([("$5",)], "c string")
    field = T.apply_types(df, T.profile(df, ["c"]).collect()).schema["c"]
    assert field.metadata == {"semantic": "currency"}


def test_clean_table_changes_only_types(spark):
    """Profiling and converting what was already converted changes nothing."""
    df = spark.range(200).select(
        (F.col("id") + 2).cast("string").alias("a"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("b"))
    votes = T.profile(df, ["a", "b"]).collect()
    out = T.apply_types(df, votes)
    assert dict(out.dtypes) == {"a": "bigint", "b": "string"}
    assert {(str(r.a), r.b) for r in out.collect()} == {(r.a, r.b) for r in df.collect()}


def test_dedup_keeps_the_first_place(spark):
    rows = [("x", 1, 5), ("y", 2, 4), ("x", 1, 3), (None, None, 9), (None, None, 8)]
    df = spark.createDataFrame(rows, "a string, b int, seq int")
    got = {tuple(r) for r in T.drop_duplicates(df, ["a", "b"], ["seq"]).collect()}
    assert got == {("x", 1, 3), ("y", 2, 4), (None, None, 8)}


def test_the_profile_is_compiled(spark, capsys):
    """Every stage of the profile compiles as one piece of code; a stage that does not is interpreted at twice the time."""
    names = list("abcdef")
    df = spark.range(9).select(*[F.col("id").cast("string").alias(n) for n in names])
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # The final plan shows at once.
    try:
        T.profile(df, names).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    text = capsys.readouterr().out
    stages = int(text.split("Found ")[1].split()[0])
    assert stages == len([s for s in text.split("maxMethodCodeSize:")[1:] if s[0].isdigit()]) > 0


def test_votes_count_every_cell_once(spark):
    """Cells are counted by what decides about them: copies, empty cells and NULLs count as single ones do."""
    rows = [(t, c) for t in (1, None) for c in ["1.234,5"] * 3 + ["1,234.5", "12", "007", "", None, None, "2024-01-05 10:00", "5 %", "$5", "có", "abc"]]
    got = {r["t"]: r for r in T.profile(spark.createDataFrame(rows, "t int, c string"), ["c"], ["t"]).collect()}
    assert set(got) == {1, None}
    for r in got.values():
        assert (r.n, r.n_styled, r.n_number, r.n_text, r.n_date, r.n_bool, r.n_percentage, r.n_currency) == (12, 11, 6, 1, 1, 1, 1, 1)
        assert (r.n_plain, r.n_us, r.n_vn, r.leading_zero, r.has_time, r.whole_auto) == (2, 1, 3, True, True, False)
