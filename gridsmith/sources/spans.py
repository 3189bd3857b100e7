"""Records that span lines or splits: quoted cells with line breaks, elements of one JSON array.

A file is read in pieces by many tasks. What a piece does to the reader's state (inside a quoted
cell or not, how deep) is a small function, told from the piece alone for every state it may begin
in. Functions are composed within each split by windows, and over the splits, one short row each;
so every piece learns the state it begins in and the record it belongs to, and no task needs more
than a split.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsmith.session import staged

SPLIT = ["table_id", "block"]


def xor(a: Column, b: Column) -> Column:
    return a != b


def opens_cell(text: Column, sep: str) -> Column:
    """Whether a text that begins outside quoted cells ends inside one. Doubled quote marks are out already."""
    edge = re.escape(sep)
    closed = rf'(?:^|(?<={edge}))"[^"]*"[^{edge}]*'
    return F.regexp_replace(text, closed, "").rlike(rf'(?:^|{edge})"')


def line_states(value: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell: if it begins outside one, and if it begins inside one.

    A quote mark opens a cell only where the cell begins; what follows its closing mark, up to the
    delimiter, is text.
    """
    bare = F.replace(value, F.lit('""'), F.lit(""))
    marked = F.contains(bare, F.lit('"'))
    rest = F.regexp_replace(bare, rf'^[^"]*"[^{re.escape(sep)}]*', "")
    return marked & opens_cell(bare, sep), ~marked | opens_cell(rest, sep)


def begun(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` with ``base, odd``: a row begins inside if ``coalesce(base, state at the start of its keys) <> odd``.

    ``outside, inside`` tell how each row ends. A row that ends alike either way sets the state; one
    that ends the other way flips it.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sets, flips = F.col("outside") == F.col("inside"), F.col("outside") & ~F.col("inside")
    counted = df.withColumn("odd", F.coalesce(F.sum(flips.cast("int")).over(before), F.lit(0)) % 2 == 1)
    return counted.withColumn("base", F.last(F.when(sets, xor(F.col("outside"), F.col("odd"))), ignorenulls=True).over(before))


def quoted_records(lines: DataFrame, sep: str) -> DataFrame:
    """``table_id, block, seq, record`` of ``table_id, block, seq, value``: whole records, with their line breaks.

    ``block, seq`` is the place of a record's first line.
    """
    outside, inside = line_states(F.col("value"), sep)
    state = begun(lines.withColumns({"outside": outside, "inside": inside}), SPLIT, "seq")
    so_far = Window.partitionBy(*SPLIT).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    for name, entry in (("record0", False), ("record1", True)):
        starts = ~xor(F.coalesce("base", F.lit(entry)), F.col("odd"))
        state = state.withColumn(name, F.last(F.when(starts, F.col("seq")), ignorenulls=True).over(so_far))
    rows = staged(state, "lines")
    ends = rows.groupBy(*SPLIT).agg(
        F.max_by(F.struct("base", "odd", "outside", "inside"), "seq").alias("last"), F.max("record0").alias("record0"),
        F.max("record1").alias("record1"))

    def after(entry: bool) -> Column:
        return F.when(xor(F.coalesce("last.base", F.lit(entry)), F.col("last.odd")), F.col("last.inside")).otherwise(F.col("last.outside"))

    splits = begun(ends.select(*SPLIT, "record0", "record1", after(False).alias("outside"), after(True).alias("inside")), ["table_id"], "block")
    splits = splits.withColumn("entry", xor(F.coalesce("base", F.lit(False)), F.col("odd")))
    started = F.when(F.col("entry"), F.col("record1")).otherwise(F.col("record0"))
    earlier = Window.partitionBy("table_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(started.isNotNull(), F.struct("block", started.alias("seq"))), ignorenulls=True).over(earlier)
    entries = staged(splits.select(*SPLIT, "entry", carried.alias("carried")), "splits")
    own = F.when(F.col("entry"), F.col("record1")).otherwise(F.col("record0"))
    placed = rows.join(entries, SPLIT).select("table_id", "block", "seq", "value", F.when(
        own.isNotNull(), F.struct("block", own.alias("seq"))).otherwise(F.col("carried")).alias("at"))
    return placed.groupBy("table_id", "at").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "seq", "value"))), lambda x: x["value"]), "\n").alias("record")).select(
        "table_id", "at.block", "at.seq", "record")


def read_pieces(spark: SparkSession, paths: str | list[str], end: str, recursive: bool = False) -> DataFrame:
    """``table_id, block, seq, value``: pieces of files up to each ``end``, in file order by ``block, seq``."""
    return spark.read.option("lineSep", end).option("recursiveFileLookup", recursive).text(paths).select(
        F.col("_metadata.file_path").alias("table_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value")


def depth_change(text: Column) -> Column:
    """Brackets opened less closed by a text up to an end brace, which counts. Escapes are out; the text begins outside strings."""
    bare = F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), '(?s)".*$', "")
    count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    ends_inside = F.regexp_count(text, F.lit('"')) % 2 == 1
    return count("{") + count("[") - count("]") - F.when(ends_inside, 0).otherwise(1)


def array_elements(pieces: DataFrame) -> DataFrame:
    """``table_id, block, seq, element, sound`` of files that are one JSON array of objects, read in pieces up to ``}``.

    A last row per file, with a NULL element, stands for what follows the last one. ``sound`` is
    false where the comma, the opening or the closing bracket around an element is not as it must be.
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    marks = F.regexp_count(bare, F.lit('"'))
    # What the piece does if it begins inside a string: all up to the first quote mark is text.
    rest = F.regexp_replace(bare, '(?s)^[^"]*"', "")
    facts = pieces.withColumns({
        "odd": marks % 2 == 1, "change0": depth_change(bare),
        "change1": F.when(marks == 0, 0).otherwise(depth_change(rest))})
    before = Window.partitionBy(*SPLIT).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*SPLIT).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    facts = facts.withColumn("flipped", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    for entry, name, other in ((0, "change0", "change1"), (1, "change1", "change0")):
        facts = facts.withColumn(f"depth{entry}", F.sum(F.when(F.col("flipped"), F.col(other)).otherwise(F.col(name))).over(so_far))
    rows = staged(facts.drop("change0", "change1"), "pieces")
    ends = rows.groupBy(*SPLIT).agg(F.max_by(F.struct("odd", "flipped", "depth0", "depth1"), "seq").alias("last"))
    earlier = Window.partitionBy("table_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    flips = xor(F.col("last.odd"), F.col("last.flipped"))
    splits = ends.withColumn("entry", F.coalesce(F.sum(flips.cast("int")).over(earlier), F.lit(0)) % 2 == 1)
    gained = F.when(F.col("entry"), F.col("last.depth1")).otherwise(F.col("last.depth0"))
    splits = staged(splits.withColumn("depth", F.coalesce(F.sum(gained).over(earlier), F.lit(0))).select(*SPLIT, "entry", "depth"), "splits")
    # A piece that ends an element leaves the array's own bracket open, and ends outside strings.
    inside = xor(xor(F.col("entry"), F.col("flipped")), F.col("odd"))
    depth = F.col("depth") + F.when(F.col("entry"), F.col("depth1")).otherwise(F.col("depth0"))
    known = rows.join(splits, SPLIT).select(*SPLIT, "seq", "value", (~inside & (depth == 1)).alias("ends"))
    # An element goes by the place of the piece that ends it: the next end at or after each piece.
    # Backwards, as a frame with an open end would be gone through again for each piece.
    after = Window.partitionBy(*SPLIT).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    found = staged(known.withColumn("at", F.last(F.when(F.col("ends"), F.col("seq")), ignorenulls=True).over(after)), "elements")
    later = Window.partitionBy("table_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    first = found.groupBy(*SPLIT).agg(F.min(F.when(F.col("ends"), F.col("seq"))).alias("end"))
    following = staged(first.select(*SPLIT, F.last(F.when(F.col("end").isNotNull(), F.struct("block", F.col("end").alias("seq"))),
                                                   ignorenulls=True).over(later).alias("next")), "next")
    own = F.when(F.col("at").isNotNull(), F.struct("block", F.col("at").alias("seq"))).otherwise(F.col("next"))
    whole = found.join(following, SPLIT).select("table_id", "block", "seq", "value", own.alias("key")).groupBy("table_id", "key").agg(
        F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["value"]), "}")
    ordered = whole.select("table_id", F.get("parts", F.lit(0)).alias("first"), F.col("key").isNull().alias("tail"), text.alias("text"))
    ordered = ordered.join(found.groupBy("table_id").agg(F.min(F.struct("block", "seq")).alias("start")), "table_id")
    opening = (F.col("first.block") == F.col("start.block")) & (F.col("first.seq") == F.col("start.seq"))
    lead = F.when(opening, r"^\x{FEFF}?[ \t\r\n]*\[[ \t\r\n]*").otherwise(r"^[ \t\r\n]*,[ \t\r\n]*")
    element = F.concat(F.regexp_replace("text", lead, F.lit("")), F.lit("}"))
    sound = F.when(F.col("tail"), F.when(opening, F.col("text").rlike(r"^\x{FEFF}?[ \t\r\n]*\[[ \t\r\n]*\][ \t\r\n]*$")).otherwise(
        F.col("text").rlike(r"^[ \t\r\n]*\][ \t\r\n]*$"))).otherwise(F.regexp_count("text", lead) == 1)
    return ordered.select("table_id", "first.block", "first.seq", F.when(~F.col("tail"), element).alias("element"), sound.alias("sound"))
