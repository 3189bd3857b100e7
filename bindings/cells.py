"""Cell functions: numbers, amounts, dates, booleans, text, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import case, comma_text, plain_text, query, wide, us_text, vn_text
from gridsmith.functions import dates, numbers, text, vocabulary as V

LINE = ["l_orderkey", "l_linenumber", "l_partkey"]


def _priced(spark, sf, mess):
    df = wide(spark, sf, "lineitem").select(*LINE, "l_extendedprice")
    return df.select(*LINE, mess(F.col("l_extendedprice")).alias("cell"))


@query("vn_numbers", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice >= 1000 THEN l_extendedprice END AS value
    FROM lineitem""")
def vn_numbers(spark, sf):
    return _priced(spark, sf, vn_text).select(*LINE, numbers.vn_number(F.col("cell")).alias("value"))


@query("us_numbers", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice >= 1000 THEN l_extendedprice END AS value
    FROM lineitem""")
def us_numbers(spark, sf):
    return _priced(spark, sf, us_text).select(*LINE, numbers.us_number(F.col("cell")).alias("value"))


@query("plain_numbers", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_partkey % 5 < 4 THEN CASE WHEN l_partkey % 2 = 0 THEN -1 ELSE 1 END * l_extendedprice END AS value
    FROM lineitem""")
def plain_numbers(spark, sf):
    """Every fifth part is written with an exponent, a plus or a bare dot, which are not plain."""
    sign = F.when(F.col("l_partkey") % 2 == 0, -1).otherwise(1)
    df = wide(spark, sf, "lineitem").select(*LINE, plain_text(F.col("l_extendedprice") * sign).alias("cell"))
    odd = case(F.col("l_partkey") % 3, F.concat("cell", F.lit("e0")), F.concat(F.lit("+"), "cell"), ".5")
    cell = F.when(F.col("l_partkey") % 5 < 4, F.col("cell")).otherwise(odd)
    return df.select(*LINE, numbers.plain_number(cell).alias("value"))


@query("comma_decimals", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END AS value
    FROM lineitem""")
def comma_decimals(spark, sf):
    df = wide(spark, sf, "lineitem")
    cell = F.when(F.col("l_linenumber") % 2 == 1, comma_text(F.col("l_extendedprice"))).otherwise(
        plain_text(F.col("l_extendedprice")))
    return df.select(*LINE, numbers.comma_decimal(cell).alias("value"))


@query("auto_numbers", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS value,
           CASE l_partkey % 4 WHEN 0 THEN 'vn' WHEN 1 THEN CASE WHEN l_extendedprice >= 1000 THEN 'us' ELSE 'plain' END
                WHEN 2 THEN 'plain' ELSE 'vn' END AS style
    FROM lineitem""")
def auto_numbers(spark, sf):
    price = F.col("l_extendedprice")
    cell = case(F.col("l_partkey") % 4, vn_text(price), us_text(price), plain_text(price), comma_text(price))
    df = wide(spark, sf, "lineitem").select(*LINE, cell.alias("cell"))
    return df.select(*LINE, numbers.number_auto(F.col("cell")).alias("value"),
                     numbers.number_style(F.col("cell")).alias("style"))


@query("percentages", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_partkey % 4 < 3 THEN round(l_discount, 6) END AS fraction
    FROM lineitem""")
def percentages(spark, sf):
    """A decimal comma without grouping is not read, by rule."""
    pct = F.col("l_discount") * 100
    cell = case(
        F.col("l_partkey") % 4, F.concat(F.round(pct).cast("int").cast("string"), F.lit("%")),
        F.concat(us_text(pct), F.lit(" %")), F.concat(plain_text(pct), F.lit("  %")),
        F.concat(comma_text(pct), F.lit("%")))
    return wide(spark, sf, "lineitem").select(*LINE, numbers.percentage(cell).alias("fraction"))


@query("currencies", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN o_totalprice END AS value,
           CASE o_orderkey % 7 WHEN 0 THEN '$' WHEN 1 THEN '€' WHEN 2 THEN 'USD' WHEN 3 THEN 'đồng' WHEN 4 THEN '₫' END AS symbol
    FROM orders""")
def currencies(spark, sf):
    price = F.col("o_totalprice")
    cell = case(
        F.col("o_orderkey") % 7,
        F.concat(F.lit("$"), us_text(price)), F.concat(vn_text(price), F.lit(" €")),
        F.concat(us_text(price), F.lit(" USD")), F.concat(vn_text(price), F.lit(" đồng")),
        F.concat(F.lit("₫ "), plain_text(price)), F.concat(plain_text(price), F.lit("đ")), plain_text(price))
    found = numbers.currency(F.col("cell"))
    return (
        wide(spark, sf, "orders").select("o_orderkey", cell.alias("cell"))
        .select("o_orderkey", found.alias("x")).select("o_orderkey", "x.value", "x.symbol"))


DATE_SQL = """
    SELECT event_id, CASE event_id % 9
             WHEN 8 THEN NULL
             WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('day', ts)
             WHEN 3 THEN date_trunc('day', ts) WHEN 5 THEN date_trunc('minute', ts) WHEN 7 THEN date_trunc('minute', ts)
             ELSE date_trunc('second', ts) END AS moment
    FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events)"""


@query("dates", DATE_SQL)
def parsed_dates(spark, sf):
    """All eight layouts, zone suffixes that are cut off, and one day that does not exist."""
    ts = F.col("ts")
    cell = case(
        F.col("event_id") % 9,
        F.date_format(ts, "dd/MM/yyyy"), F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "d-M-yyyy"),
        F.date_format(ts, "d.M.yyyy"), F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+07:00")),
        F.concat(F.date_format(ts, "yyyy-M-d HH:mm"), F.lit("Z")), F.concat(F.date_format(ts, "dd/MM/yyyy  HH:mm:ss"), F.lit(" UTC")),
        F.date_format(ts, "d/M/yyyy HH:mm"), F.concat(F.lit("30/02/"), F.date_format(ts, "yyyy")))
    df = wide(spark, sf, "events").select("event_id", cell.alias("cell"))
    return df.select("event_id", dates.parse_datetime(F.col("cell")).alias("moment"))


@query("booleans", """
    SELECT doc_id, CAST(quality AS INTEGER) AS quality, CAST(CASE WHEN doc_id % 8 = 7 THEN NULL ELSE toxic END AS INTEGER) AS toxic
    FROM labels""")
def booleans(spark, sf):
    pick = F.col("doc_id") % len(V.TRUE_WORDS)
    no = F.upper(case(F.col("doc_id") % len(V.FALSE_WORDS), *V.FALSE_WORDS))
    quality = F.when(F.col("quality") == 1, case(pick, *V.TRUE_WORDS)).otherwise(no)
    toxic = F.when(F.col("doc_id") % 8 == 7, "y").when(F.col("toxic") == 1, " Có ").otherwise("KHÔNG")
    df = wide(spark, sf, "labels").select("doc_id", quality.alias("q"), toxic.alias("t"))
    return df.select("doc_id", dates.parse_bool(F.col("q")).alias("quality"), dates.parse_bool(F.col("t")).alias("toxic"))


# Letters of the test documents with their decomposed form.
DECOMPOSED = {
    "é": "é", "è": "è", "ê": "ê", "ç": "ç",
    "É": "É", "È": "È", "Ê": "Ê", "Ç": "Ç",
    "ä": "ä", "ö": "ö", "ü": "ü", "ñ": "ñ",
    "ó": "ó", "í": "í",
}


@query("unicode_nfc", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def unicode_nfc(spark, sf):
    """Whole texts, two thirds of them decomposed first."""
    apart = F.col("text")
    for whole, parts in DECOMPOSED.items():
        apart = F.replace(apart, F.lit(whole), F.lit(parts))
    df = wide(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 < 2, apart).otherwise(F.col("text")).alias("cell"))
    return df.select("doc_id", text.nfc(F.col("cell")).alias("text"))


@query("whitespace", """
    SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 4 THEN NULL
           ELSE trim(text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)||chr(160)||chr(8195)||chr(12288)) END AS text
    FROM conversations""")
def whitespace(spark, sf):
    pick = (F.col("conv_id") + F.col("turn")) % 5
    cell = case(
        pick, F.concat(F.lit(" "), "text", F.lit("\t")), F.concat(F.lit("  \n"), "text"),
        F.concat("text", F.lit("　\r\n")), F.col("text"), " \t   ")
    return wide(spark, sf, "conversations").select("conv_id", "turn", text.blank_to_null(cell).alias("text"))


@query("excel_errors", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 20 < 12 THEN NULL WHEN o_orderkey % 20 = 12 THEN '#REF' ELSE o_orderpriority END AS priority
    FROM orders""")
def excel_errors(spark, sf):
    pick = F.col("o_orderkey") % 20
    token = case(pick, *V.EXCEL_ERRORS)
    cell = F.when(pick < 6, F.concat(F.lit(" "), F.upper(token))).when(pick < 12, token).when(
        pick == 12, "#REF").otherwise(F.col("o_orderpriority"))
    return wide(spark, sf, "orders").select("o_orderkey", text.excel_error_to_null(cell).alias("priority"))


@query("na_tokens", """
    SELECT c_custkey, CASE WHEN c_custkey % 16 < 8 THEN NULL WHEN c_custkey % 16 = 8 THEN '--' ELSE c_mktsegment END AS segment
    FROM customer""")
def na_tokens(spark, sf):
    pick = F.col("c_custkey") % 16
    cell = F.when(pick < 8, F.upper(case(pick, *V.NA_TOKENS))).when(pick == 8, "--").otherwise(F.col("c_mktsegment"))
    return wide(spark, sf, "customer").select("c_custkey", text.na_to_null(cell).alias("segment"))


@query("leading_zeros", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN false ELSE o_custkey < 100000 AND o_orderkey % 3 = 0 END AS leading_zero
    FROM orders""")
def leading_zeros(spark, sf):
    key = F.col("o_custkey").cast("string")
    cell = case(F.col("o_orderkey") % 3, F.lpad(key, 6, "0"), F.concat(F.lit("1"), key), F.concat(F.lit("0."), key))
    return wide(spark, sf, "orders").select("o_orderkey", numbers.has_leading_zero(cell).alias("leading_zero"))
