"""Numbers in Vietnamese, US, plain and comma-decimal style; percentages and amounts.

Cells are expected without whitespace at their ends. Every reader is NULL where the text is not in
its style. Each is one chain of pattern tests around a single cast, which keeps the generated code
of wide projections small enough for the JIT compiler.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsmith.functions import vocabulary as V
from gridsmith.functions.text import strip


def _point_text(c: Column) -> Column:
    """Commas group digits, a point starts the decimals."""
    return F.replace(c, F.lit(","), F.lit(""))


def _comma_text(c: Column) -> Column:
    """Points group digits, a comma starts the decimals."""
    return F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def is_vn(c: Column) -> Column:
    return c.contains(".") & c.rlike(V.VN_NUMBER)


def is_us(c: Column) -> Column:
    return c.contains(",") & c.rlike(V.US_NUMBER)


def is_plain(c: Column) -> Column:
    return c.rlike(V.PLAIN_NUMBER)


def is_comma_decimal(c: Column) -> Column:
    return c.contains(",") & c.rlike(V.COMMA_DECIMAL)


def vn_number(c: Column) -> Column:
    """``1.234.567,89``: dots group, a comma starts the decimals."""
    return F.when(is_vn(c), _comma_text(c)).try_cast("double")


def us_number(c: Column) -> Column:
    """``1,234,567.89``."""
    return F.when(is_us(c), _point_text(c)).try_cast("double")


def plain_number(c: Column) -> Column:
    """``-12`` or ``12.5``; no exponent, no leading plus or dot."""
    return F.when(is_plain(c), c).try_cast("double")


def comma_decimal(c: Column) -> Column:
    """``10,5``."""
    return F.when(is_comma_decimal(c), _comma_text(c)).try_cast("double")


def point_reading(c: Column) -> Column:
    return _point_text(c).try_cast("double")


def comma_reading(c: Column) -> Column:
    return _comma_text(c).try_cast("double")


def round6(v: Column) -> Column:
    """Six decimal places by arithmetic, much cheaper than decimal rounding. From 9e9 on a double has no
    seventh decimal to round."""
    return F.when(F.abs(v) < 9e9, F.rint(v * 1e6) / 1e6).otherwise(v)


def is_whole(v: Column) -> Column:
    """Whole after rounding to six places, and exact as a double."""
    return (F.abs(v - F.rint(v)) < 5e-7) & (F.abs(v) < float(2**53))


def number_in_style(c: Column, style: str) -> Column:
    """Read with the column's voted style first; in any other style a single comma is a decimal
    comma before it is a thousands mark."""
    plain, comma, us, vn = (
        lambda w: w(is_plain(c), c), lambda w: w(is_comma_decimal(c), _comma_text(c)),
        lambda w: w(is_us(c), _point_text(c)), lambda w: w(is_vn(c), _comma_text(c)))
    order = {"vn": (vn, comma, plain, us), "us": (us, plain, comma, vn)}.get(style, (plain, comma, us, vn))
    chain = None
    for reading in order:
        chain = reading(F.when if chain is None else chain.when)
    return chain.try_cast("double")


def number_auto(c: Column) -> Column:
    """Style unknown."""
    return number_in_style(c, "mixed")


def grouped_or_plain(c: Column) -> Column:
    """The reading used under a percent or currency mark: grouped styles first."""
    return F.when(is_vn(c), _comma_text(c)).when(is_us(c) | is_plain(c), _point_text(c)).try_cast("double")


def number_style(c: Column) -> Column:
    """The one style a cell counts for in the style vote; NULL when it is no number."""
    return F.when(is_plain(c), "plain").when(is_us(c), "us").when(is_vn(c) | is_comma_decimal(c), "vn")


def is_percentage(c: Column) -> Column:
    return c.endswith("%") & c.rlike(V.PERCENT)


def percentage(c: Column) -> Column:
    """``12.5 %`` as the fraction 0.125; a decimal comma without grouping is not read."""
    body = F.when(is_percentage(c), strip(F.translate(c, "%", "")))
    return round6(grouped_or_plain(body) / 100)


def is_currency(c: Column) -> Column:
    return c.rlike(V.AMOUNT)


def currency_value(c: Column) -> Column:
    """The amount without its mark; NULL without a mark."""
    body = F.when(is_currency(c), strip(F.regexp_replace(c, V.CURRENCY_MARK, "")))
    return grouped_or_plain(body)


def currency(c: Column) -> Column:
    """``struct(value, symbol)``; NULL without a currency mark or a readable amount."""
    value = currency_value(c)
    symbol = F.regexp_extract(c, V.CURRENCY_MARK, 0)
    return F.when(is_currency(c), F.struct(value.alias("value"), symbol.alias("symbol")))


def has_leading_zero(c: Column) -> Column:
    return c.rlike(V.LEADING_ZERO)


def loose_number(c: Column) -> Column:
    """Last reading for a leftover cell of a numeric column: sign, bare dot and exponent allowed."""
    return F.when(
        c.rlike(r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?)$"), c).try_cast("double")
