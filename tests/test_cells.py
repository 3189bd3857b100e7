from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridsmith.functions import dates, numbers, statements, text

NUMBERS = {
    # text: (vn, us, plain, comma decimal, auto)
    "1.234.567,89": (1234567.89, None, None, None, 1234567.89),
    "1.234": (1234, None, 1.234, None, 1.234),
    "1,234": (None, 1234, None, 1.234, 1.234),
    "1,234,567.50": (None, 1234567.5, None, None, 1234567.5),
    "10,5": (None, None, None, 10.5, 10.5),
    "-1.000": (-1000, None, -1.0, None, -1.0),
    "12": (None, None, 12, None, 12),
    "1e5": (None,) * 5, "+5": (None,) * 5, ".5": (None,) * 5, "1,23,456": (None,) * 5, "": (None,) * 5,
}


@pytest.mark.parametrize("i, fn", list(enumerate([
    numbers.vn_number, numbers.us_number, numbers.plain_number, numbers.comma_decimal, numbers.number_auto])))
def test_numbers(read_cell, i, fn):
    assert read_cell(fn, list(NUMBERS)) == [v[i] for v in NUMBERS.values()]


def test_styles(read_cell):
    assert read_cell(lambda c: numbers.number_in_style(c, "us"), ["1,234", "1.234", "10,5"]) == [1234, 1.234, 10.5]
    assert read_cell(lambda c: numbers.number_in_style(c, "vn"), ["1,234", "1.234", "1,234.5"]) == [1.234, 1234, 1234.5]


def test_percentages(read_cell):
    given = {"50%": 0.5, "0%": 0.0, "1.234%": 12.34, "12.5 %": 0.125, "12,5%": None, "5": None, "%": None}
    assert read_cell(numbers.percentage, list(given)) == list(given.values())


def test_currencies(read_cell):
    given = {
        "$1,234.50": (1234.5, "$"), "1.500.000 đồng": (1500000, "đồng"), "1,000 USD": (1000, "USD"), "$ -5": (-5, "$"),
        "₫100": (100, "₫"), "5 VNĐ": (5, "VNĐ"), "5 vnd": (5, "vnd"), "100đ": None, "100 ₫": None, "-$5": None,
        "12,5 €": None, "100": None, "$5 USD": (5, "$"), "$5đ": None}
    got = [tuple(r) if r else None for r in read_cell(numbers.currency, list(given))]
    assert got == list(given.values())


def test_dates(read_cell):
    day = datetime(2024, 1, 5)
    given = {
        "05/01/2024": day, "5.1.2024": day, "2024-01-05": day, "05-01-2024": day, "12-05-2023": datetime(2023, 5, 12),
        "2024-01-05T03:04:05.123+07:00": datetime(2024, 1, 5, 3, 4, 5), "2024-1-5 03:04 utc": datetime(2024, 1, 5, 3, 4),
        "05/01/2024 03:04": datetime(2024, 1, 5, 3, 4), "05/01/2024   03:04:59": datetime(2024, 1, 5, 3, 4, 59),
        "05/01/2024Z": day, "30/02/2024": None, "2024-13-01": None, "2024/01/05": None, "5.1.2024 10:00": None,
        "05/01.2024": None, "2024-01-05 25:00": None, "0000-01-01": None, "2024-01-05 10": None, "abc": None, "1.234": None}
    assert read_cell(dates.parse_datetime, list(given)) == list(given.values())


def test_booleans(read_cell):
    assert read_cell(dates.parse_bool, ["Có", "X", "✓", "TRUE", "1", "đúng"]) == [1] * 6
    assert read_cell(dates.parse_bool, ["Không", "✗", "no", "0", "sai", "FALSE"]) == [0] * 6
    assert read_cell(dates.parse_bool, ["y", "", None]) == [None] * 3


def test_cleanup(read_cell):
    assert read_cell(text.blank_to_null, ["\xa0x\t", "   ", "a  b", " ", None]) == ["x", None, "a  b", None, None]
    tokens = ["#N/A", " #ref! ", "#SPILL!", "#REF", "N/A", "--"]
    assert read_cell(text.excel_error_to_null, tokens) == [None, None, None, "#REF", "N/A", "--"]
    assert read_cell(text.na_to_null, ["N/A", "none", "-", "", "NaN", "--", "#REF!"]) == [None] * 5 + ["--", "#REF!"]
    assert read_cell(text.tokens_to_null, ["#CALC!", "Null", "x"]) == [None, None, "x"]


def test_nfc(read_cell):
    import unicodedata

    samples = ["é", "ế", "한", "Å", "é", "abc", None, "ﬀ", "ấ x ệ"]
    assert read_cell(text.nfc, samples) == [unicodedata.normalize("NFC", s) if s else None for s in samples]


def test_no_character_is_missed_by_the_nfc_filter(spark):
    """Every character that NFC can change, alone or after another one, is sent to the function."""
    import unicodedata

    composed_seconds = {int(d.split()[1], 16) for d in (unicodedata.decomposition(chr(i)) for i in range(0x110000))
                        if d and "<" not in d and len(d.split()) == 2}
    risky = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (
        unicodedata.combining(chr(i)) or unicodedata.normalize("NFC", chr(i)) != chr(i) or i in composed_seconds)]
    df = spark.createDataFrame([(chr(i),) for i in risky], "c string")
    assert df.where(~text.may_change_under_nfc(F.col("c"))).count() == 0


def test_names(read_cell):
    def named(values):
        return read_cell(lambda c: text.column_name(c, F.col("i")), values)

    assert named(["Họ  tên (VNĐ)", "a__b", None, "%", " Ngày-tạo_"]) == [
        "họ_tên_vnđ", "a_b", "col_2", "col_3", "ngày_tạo"]
    assert read_cell(lambda c: text.column_name(c, F.col("i"), ascii_names=True), ["Đơn giá"]) == ["don_gia"]
    assert read_cell(text.table_name, ["Đơn-hàng.2024.csv", "/x/---.csv", "a b.CSV", "x"]) == [
        "don_hang_2024", "table", "a b", "x"]


def test_leading_zero(read_cell):
    assert read_cell(numbers.has_leading_zero, ["007", "0", "0.5", "70"]) == [True, False, False, False]


def test_extract_sql(read_cell):
    given = {
        "text\n```sql\nSELECT 1\n```\nmore ```x```": "SELECT 1",
        "```\n-- Your SQL query\nSELECT 1\n```": "SELECT 1",
        "```\n-- SELECT old\nSELECT 1\n```": "-- SELECT old\nSELECT 1",
        "```sql\n-- a note\nSELECT 1```": "-- a note\nSELECT 1",
        "```SQLite\nSELECT 1\n```": "SELECT 1",
        "  SELECT 1 \n": "SELECT 1", "": "", "```\n```": "",
        "```sql\r\n--write your query\r\nSELECT 1\r\nFROM t\r\n```": "SELECT 1\nFROM t"}
    assert read_cell(statements.extract_sql, [*given, None]) == [*given.values(), ""]


def test_order_by(read_cell):
    assert read_cell(statements.is_ordered, ["a order\n by b", "reorder by", "ORDERBY", None]) == [True, False, False, False]


def test_round_trip_of_every_style(spark):
    """Numbers written in a style and read in it come back."""
    df = spark.range(20000).select((F.rand(7) * F.pow(F.lit(10.0), F.rand(8) * 8)).alias("x")).select(F.round("x", 2).alias("x"))
    us = F.format_number("x", 2)
    vn = F.translate(us, ",.", ".,")
    wrong = df.where((numbers.number_in_style(us, "us") != F.col("x")) | (numbers.number_in_style(vn, "vn") != F.col("x")))
    assert wrong.count() == 0


def test_round6(spark):
    import random

    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 12) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, r in zip(values, [x[0] for x in df.select(numbers.round6(F.col("v"))).collect()]):
        assert r == pytest.approx(round(v, 6), rel=1e-12, abs=1e-12)


def test_a_cell_is_stripped_as_any_text(read_cell):
    """Cells with bare ends pass by a test; the strip decides about all others."""
    cells = ["a", "a b", "a\nb", "a\n", " a", "a　", " ", "", None, "é", "é ", "\x7fa", "-", "x" * 5000 + "\t", "a\x85"]
    assert read_cell(lambda c: text.strip_cell("c"), cells) == read_cell(text.strip, cells)


def test_tokens_in_any_case(read_cell):
    tokens = ["#N/A", "#getting_DATA", "NULL", "nAn", "None", "-", "", "no", "n", "-1", "#", None, "x"]
    assert read_cell(text.tokens_to_null, tokens) == [None] * 7 + ["no", "n", "-1", "#", None, "x"]
