"""Dates, date-times and booleans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsmith.functions import vocabulary as V
from gridsmith.functions.text import strip

# Accepted layouts, day first or ISO, with the zone suffix that is cut off. A clock may
# follow an ISO date or a date with slashes.
YEAR = r"((?!0000)[0-9]{4})"
CLOCK = r"([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.[0-9]+)?)?"
ZONE = r"(?:\s*(?:Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2}))?$"
DAY_FIRST = (
    r"(?Ui)^([0-9]{1,2})(?:/([0-9]{1,2})/" + YEAR + r"(?:\s+" + CLOCK + r")?"
    r"|([.-])([0-9]{1,2})\7" + YEAR + r")" + ZONE
)
ISO = r"(?Ui)^" + YEAR + r"-([0-9]{1,2})-([0-9]{1,2})(?:[T ]" + CLOCK + r")?" + ZONE
LOOKS_DATED = r"^[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]"


def parse_datetime(c: Column) -> Column:
    """Wall-clock timestamp, NULL when the text is no valid date.

    Two replacements rewrite any layout to ``~Y-M-D h:m:s`` with empty places for what is missing;
    those are cut and the rest is cast once. A cheap test of the first characters keeps prose away
    from the long patterns.
    """
    dated = F.when(c.rlike(LOOKS_DATED), c)
    rewritten = F.regexp_replace(dated, DAY_FIRST, "~$3$9-$2$8-$1 $4:$5:$6")
    rewritten = F.regexp_replace(rewritten, ISO, "~$1-$2-$3 $4:$5:$6")
    return F.regexp_extract(rewritten, "^~(.*?)[ :]*$", 1).try_cast("timestamp_ntz")


def has_time(ts: Column) -> Column:
    return (F.hour(ts) + F.minute(ts) + F.second(ts)) > 0


def parse_bool(c: Column) -> Column:
    """1, 0 or NULL for a known word, in any case."""
    word = F.lower(strip(c))
    return F.when(word.isin(V.TRUE_WORDS), 1).when(word.isin(V.FALSE_WORDS), 0)


def is_bool(c: Column) -> Column:
    return F.lower(strip(c)).isin(V.TRUE_WORDS + V.FALSE_WORDS)
