"""Column profiles, type votes, conversion and row deduplication."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gridsmith.functions import dates, numbers, text
from gridsmith.functions import vocabulary as V


def classified(df: DataFrame, keep: list[str], cell: str = "cell", bool_digits: bool = True) -> DataFrame:
    """Add what later steps combine: ``ts``, the number patterns that fit, and ``class``: the first of
    date, bool, percentage, currency, number, text. ``cell`` has no whitespace at its ends."""
    c = F.col(cell)
    # Most numbers are all digits, which one short pattern finds. Other cells that do not start like
    # a number skip the number patterns.
    whole = F.when(c.rlike(r"^[0-9]+\z"), c).try_cast("bigint")
    digit_first = F.ascii(c).between(48, 57) | (F.ascii(c) == 45)
    cast = df.select(*keep, cell, whole.alias("whole"))
    is_int = F.col("whole").isNotNull()
    maybe = ~is_int & digit_first
    tested = cast.select(
        "*", F.when(maybe, dates.parse_datetime(c)).alias("ts"),
        (is_int | maybe & ~c.contains(",") & numbers.is_plain(c)).alias("plain"),
        *[(maybe & fits(c)).alias(k) for k, fits in (
            ("comma", numbers.is_comma_decimal), ("us", numbers.is_us), ("vn", numbers.is_vn))])
    longest = max(len(w) for w in V.TRUE_WORDS + V.FALSE_WORDS)
    boolean = (F.length(c) <= longest) & dates.is_bool(c)
    if not bool_digits:
        boolean = boolean & ~c.isin("0", "1")
    return tested.withColumn(
        "class",
        F.when(c.isNull() | (c == ""), None)
        .when(F.col("ts").isNotNull(), "date")
        .when(boolean, "bool")
        .when(F.col("plain") | F.col("comma") | F.col("us") | F.col("vn"), "number")
        .when(numbers.is_percentage(c), "percentage")
        .when(numbers.is_currency(c), "currency")
        .otherwise("text"))


def profile(df: DataFrame, cells: list[str], table: list[str] | None = None,
            bool_digits: bool = True) -> DataFrame:
    """One row per table and column: class counts, number style and voted type.

    The columns are turned into rows inside the scan stage. What decides about a cell takes few
    values (class, style, whether each reading is whole), so cells are first counted by these, in
    one hash table per task; the shuffle carries those counts, a few short rows per column and task,
    whatever the size of the table.
    """
    table = table or []
    stripped = df.select(*table, *[text.strip_cell(c).alias(c) for c in cells])
    # Not an unpivot: over its rows Spark cannot compile the many tests of a cell, and interprets them.
    long = stripped.select(*table, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("cell")) for c in cells])))
    keys = [*table, "column"]
    plain, comma, us, vn = (F.col(k) for k in ("plain", "comma", "us", "vn"))
    # A number has at most two readings, by what its commas mean, and each is made only where a
    # pattern allows it: a cast that fails is far dearer than one that does not take place.
    is_int, is_number = F.col("whole").isNotNull(), F.col("class") == "number"
    point = F.when(is_number & is_int, F.col("whole").cast("double")).when(
        is_number & (plain | us), numbers.point_reading(F.col("cell")))
    decimal_comma = F.when(is_number & (vn | comma), numbers.comma_reading(F.col("cell")))
    read = classified(long, keys, "cell", bool_digits).select(
        "*", point.alias("point"), decimal_comma.alias("decimal_comma"))
    alike = ["filled", "class", "plain", "comma", "us", "vn", "w_point", "w_comma", "zero", "clock"]
    marked = read.select(
        *keys, F.col("cell").isNotNull().alias("filled"), "class", "plain", "comma", "us", "vn",
        numbers.is_whole(F.col("point")).alias("w_point"), numbers.is_whole(F.col("decimal_comma")).alias("w_comma"),
        (F.col("cell").startswith("0") & numbers.has_leading_zero(F.col("cell"))).alias("zero"),
        dates.has_time(F.col("ts")).alias("clock"))
    w_point, w_comma = F.col("w_point"), F.col("w_comma")

    def cells_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_cells"))), F.lit(0))

    counted = marked.groupBy(*keys, *alike).agg(F.count(F.lit(1)).alias("_cells")).groupBy(*keys).agg(
        cells_where(F.col("filled")).alias("n"),
        cells_where(F.col("class").isNotNull()).alias("n_styled"),
        *[cells_where(F.col("class") == k).alias(f"n_{k}")
          for k in ("date", "bool", "percentage", "currency", "number", "text")],
        cells_where(plain).alias("n_plain"),
        cells_where(~plain & us).alias("n_us"),
        cells_where(~plain & ~us & (vn | comma)).alias("n_vn"),
        F.bool_and(F.when(vn | comma, w_comma).otherwise(w_point)).alias("whole_vn"),
        F.bool_and(F.when(us | plain, w_point).otherwise(w_comma)).alias("whole_us"),
        F.bool_and(F.when(plain, w_point).when(comma | ~us, w_comma).otherwise(w_point)).alias("whole_auto"),
        F.coalesce(F.bool_or("zero"), F.lit(False)).alias("leading_zero"),
        F.coalesce(F.bool_or("clock"), F.lit(False)).alias("has_time"),
    )
    return vote(counted)


def vote(counted: DataFrame) -> DataFrame:
    """Add ``style`` and ``type`` to the class counts of :func:`profile`."""
    half = F.col("n_styled") * 0.5
    chosen_style = (
        F.when(F.col("n_styled") == 0, "plain")
        .when(F.col("n_plain") > half, "plain").when(F.col("n_us") > half, "us")
        .when(F.col("n_vn") > half, "vn").otherwise("mixed")
    )
    order = ["date", "bool", "percentage", "currency", "number", "text"]
    top = F.greatest(*[F.col(f"n_{k}") for k in order])
    winner = F.coalesce(*[F.when(F.col(f"n_{k}") == top, F.lit(k)) for k in order])
    whole = (
        F.when(F.col("style") == "vn", F.col("whole_vn"))
        .when(F.col("style") == "us", F.col("whole_us")).otherwise(F.col("whole_auto"))
    )
    chosen = (
        F.when(F.col("leading_zero") | (F.col("n") == 0) | (top / F.col("n") < V.VOTE_THRESHOLD), "text")
        .when(winner == "number", F.when(whole, "int").otherwise("float"))
        .otherwise(winner)
    )
    return counted.withColumn("style", chosen_style).withColumn("type", chosen)


def converted(c: Column, kind: str, style: str, has_time: bool, typed_dates: bool = False,
              typed_bools: bool = False) -> Column:
    """One column in its voted type; cells that do not fit become NULL (text in date columns stays)."""
    if kind in ("int", "float"):
        return F.coalesce(numbers.number_in_style(c, style), numbers.loose_number(c))
    if kind == "percentage":
        return F.coalesce(numbers.percentage(c), numbers.loose_number(c))
    if kind == "currency":
        return F.coalesce(numbers.currency_value(c), numbers.loose_number(c))
    if kind == "bool":
        value = dates.parse_bool(c)
        return value.cast("boolean") if typed_bools else value
    if kind == "date":
        ts = dates.parse_datetime(c)
        if typed_dates:
            return ts if has_time else ts.cast("date")
        # Both casts print ISO; no formatter is needed.
        return F.coalesce((ts if has_time else ts.cast("date")).cast("string"), c)
    return c


def apply_types(df: DataFrame, votes: Iterable[Row], typed_dates: bool = False,
                typed_bools: bool = False) -> DataFrame:
    """Convert the profiled columns of one table in one projection.

    ``votes`` are the profile rows of that table, one per column. Amounts keep a note of their
    meaning in the column metadata, as the symbol itself is dropped.
    """
    by_column = {v["column"]: v for v in votes}
    # Stripped in a projection of its own: each reader names its cell several times.
    df = df.select(*[text.strip_cell(n).alias(n) if n in by_column else F.col(n) for n in df.columns])
    out = []
    for name in df.columns:
        v = by_column.get(name)
        if v is None:
            out.append(F.col(name))
            continue
        col = converted(F.col(name), v["type"], v["style"], v["has_time"], typed_dates, typed_bools)
        meta = {"semantic": v["type"]} if v["type"] in ("currency", "percentage") else {}
        out.append(col.alias(name, metadata=meta) if meta else col.alias(name))
    kinds = {n: by_column[n]["type"] for n in df.columns if n in by_column}

    def finished(name: str) -> Column:
        c = F.col(name)
        if kinds.get(name) == "int":
            return F.when(numbers.is_whole(c), F.rint(c).cast("bigint")).alias(name)
        return numbers.round6(c).alias(name) if kinds.get(name) == "float" else c

    # Numbers are rounded or cast in a second projection, so that each cell is read only once.
    return df.select(*out).select(*[finished(n) for n in df.columns])


# Two order columns are packed into one decimal: a struct in the aggregate would force Spark to sort
# every row before combining copies, a decimal is combined in a hash table.
_PACK = Decimal(1 << 63)


def drop_duplicates(df: DataFrame, cells: list[str], order: list[str] | None = None,
                    keep: list[str] | None = None) -> DataFrame:
    """Equal rows once, with the order key of the first one if ``order`` (one or two non-negative whole
    numbers) is given.

    The copies meet in the map-side half of the aggregate, so a row repeated in a third of the
    table crosses the network once per task.
    """
    keys = (keep or []) + cells
    if not order:
        return df.select(*keys).distinct()
    if len(order) == 1:
        return df.groupBy(*keys).agg(F.min(order[0]).alias(order[0]))
    major, minor = order
    packed = F.col(major).cast("decimal(19,0)") * F.lit(_PACK) + F.col(minor)
    first = df.groupBy(*keys).agg(F.min(packed.cast("decimal(38,0)")).alias("_first"))
    rest = F.pmod(F.col("_first"), F.lit(_PACK))
    return first.select(
        *keys, ((F.col("_first") - rest) / F.lit(_PACK)).cast("bigint").alias(major), rest.cast("bigint").alias(minor))
