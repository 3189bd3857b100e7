"""String cleanup: whitespace, Unicode forms, names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsmith.functions import vocabulary as V

# Characters that may change under NFC: combining marks, characters newer than the JVM, conjoining jamo, and the blocks holding
# singletons (Greek extended, spaces and letterlike signs, compatibility ideographs). A string
# free of them is already in NFC, so it never leaves the JVM.
MAY_CHANGE_UNDER_NFC = (
    r"[\p{M}\p{Cn}\u0374\u037E\u0387\u0958-\u095F\u09DC-\u09DF\u0A33-\u0A5E\u0B5C\u0B5D\u0F43-\u0F69"
    r"\u1160-\u11FF\u1F71-\u1FFD\u2000\u2001\u2126\u212A\u212B\u2329\u232A\u2ADC\uF900-\uFAFF"
    r"\uFB1D-\uFB4E\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]"
)

# Every character that counts as whitespace at the ends of a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A cell that begins and ends with a printable ASCII character has nothing to strip.
BARE_ENDS = r"^[!-~](?s:.*[!-~])?\z"
# How a cell begins that may be an error or NA token, in any case.
_TOKENS = sorted(set(V.EXCEL_ERRORS) | set(V.NA_TOKENS))
TOKEN_START = "^(?:[" + "".join(re.escape(x) for x in sorted({f(t[0]) for t in _TOKENS if t for f in (str.lower, str.upper)})) + r"]|\z)"


def strip(c: Column) -> Column:
    """Strip Unicode whitespace; ordinary ``trim`` would leave NBSP and TAB."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_cell(name: str) -> Column:
    """The same of a stored column, whose test comes cheaper than the strip."""
    c = F.col(name)
    return F.when(c.rlike(BARE_ENDS), c).otherwise(strip(c))


def blank_to_null(c: Column) -> Column:
    """Strip a cell; a blank one becomes NULL. Inner whitespace stays."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    """NULL or whitespace only."""
    return c.isNull() | (strip(c) == "")


def may_change_under_nfc(c: Column) -> Column:
    return c.rlike(MAY_CHANGE_UNDER_NFC)


def nfc(c: Column) -> Column:
    """NFC. Only the cells that may change are sent to the Arrow function."""
    # A local function travels to the executors by value, so they need not have this package.
    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return F.coalesce(udf(F.when(may_change_under_nfc(c), c)), c)


def ascii_fold(c: Column) -> Column:
    """Drop diacritics and every other non-ASCII character; d with stroke becomes d."""
    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(
            lambda x: unicodedata.normalize("NFD", x).encode("ascii", "ignore").decode("ascii"), na_action="ignore")

    plain = F.translate(c, "đĐ", "dD")
    non_ascii = plain.rlike(r"[^\x00-\x7F]")
    return F.when(non_ascii, udf(F.when(non_ascii, plain))).otherwise(plain)


def excel_error_to_null(c: Column) -> Column:
    return F.when(~F.lower(strip(c)).isin(V.EXCEL_ERRORS), c)


def na_to_null(c: Column) -> Column:
    return F.when(~F.lower(strip(c)).isin(V.NA_TOKENS), c)


def tokens_to_null(c: Column) -> Column:
    """Excel errors and NA tokens in one membership test, for cells already stripped."""
    return F.when(c.rlike(TOKEN_START) & F.lower(c).isin(_TOKENS), None).otherwise(c)


def is_ditto(c: Column) -> Column:
    return F.coalesce(strip(c).isin(V.DITTO_MARKS), F.lit(False))


def column_name(c: Column, idx: Column, ascii_names: bool = False) -> Column:
    """Header text to column name; letters with diacritics stay unless ``ascii_names``."""
    s = F.lower(strip(c))
    s = ascii_fold(s) if ascii_names else nfc(s)
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.concat(F.lit("col_"), idx.cast("string")))


def table_name(file_name: Column) -> Column:
    """File name to table name: ASCII, lower case, ``.`` and ``-`` as ``_``; spaces stay."""
    stem = F.regexp_replace(F.regexp_replace(file_name, "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    s = F.translate(F.lower(ascii_fold(stem)), ".-", "__")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("table"))
