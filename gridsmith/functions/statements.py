"""SQL statements inside model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsmith.functions import vocabulary as V
from gridsmith.functions.text import strip

LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"


def extract_sql(text: Column) -> Column:
    """First fenced block without placeholder comments, else the stripped text."""
    def is_placeholder(line: Column) -> Column:
        stripped = strip(line)
        return stripped.rlike(V.PLACEHOLDER_COMMENT) & ~F.upper(stripped).rlike(V.SQL_KEYWORDS)

    lines = F.split(strip(F.regexp_extract(text, V.SQL_FENCE, 1)), LINE_BREAK)
    fenced = strip(F.concat_ws("\n", F.filter(lines, lambda line: ~is_placeholder(line))))
    return (
        F.when(text.isNull(), F.lit(""))
        .when(text.rlike(V.SQL_FENCE), fenced)
        .otherwise(strip(text))
    )


def is_ordered(sql: Column) -> Column:
    """ORDER BY anywhere in the statement, also in a subquery or a window."""
    return F.coalesce(sql.rlike(V.ORDER_BY), F.lit(False))
