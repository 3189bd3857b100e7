"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm.base import query, ranked, table
from gridsmith.session import staged

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # 150 %
MAX_EPOCHS = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A seeded place in the order in which a source's documents are taken."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_level(sources: DataFrame, budget_num: int, budget_den: int) -> float | None:
    """The level at which ``sum(min(cap, level * weight))`` meets the budget; None if all caps are reached.

    Sources whose share passes their cap are clamped and their excess goes to the others by weight,
    until none is above. Two sums a round come to the driver, in whole numbers, so reruns agree.
    """
    level, clamped = 0.0, None
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        n, held, free = sources.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == clamped:
            return level
        if not free:
            return None
        clamped = n
        level = (budget_num - budget_den * int(held)) / (budget_den * int(free))


def same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def allocate(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE,
             max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per source: ``source, source_size, target, whole, cutoff``.

    A document is taken ``whole`` times, and once more if its seeded draw is at most ``cutoff``.
    Draws are hex digits: sums per source and leading digits find the piece in which the rest of
    the target ends, and only that piece is ordered. So the extra words end within half a document
    of the target, and no source, however large, is sorted in one task.
    """
    sized = staged(docs.select(
        "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("draw")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ranked(totals, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = staged(placed.select(
        "source", "source_size", weight.cast("long").alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap")), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = water_level(sources, int(total) * share[0], share[1])
    target = F.col("cap").cast("double")
    if level is not None:
        target = F.least(target, F.lit(level) * F.col("weight"))
    targets = sources.select("source", "source_size", target.alias("target")).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = staged(targets, "targets")

    # The piece of the draw order in which the rest ends.
    pieces = sized.groupBy("source", F.substring("draw", 1, 3).alias("piece")).agg(F.sum("size").alias("n"))
    up_to = Window.partitionBy("source").orderBy("piece")
    pieces = pieces.withColumn("end", F.sum("n").over(up_to))
    t = targets.alias("t")
    ends = (pieces.alias("p").join(t, same("p", "t"))
            .where("p.end > t.rest").groupBy("t.source")
            .agg(F.min(F.struct("p.piece", (F.col("p.end") - F.col("p.n")).alias("start"), "t.rest")).alias("at"))
            .select("source", "at.piece", "at.start", "at.rest"))
    ends = staged(ends, "ends")
    # Inside it, the last draw whose middle is not beyond the rest.
    inner = (sized.withColumn("piece", F.substring("draw", 1, 3)).alias("s")
             .join(ends.alias("e"), same("s", "e") & (F.col("s.piece") == F.col("e.piece")))
             .groupBy("e.source", "e.start", "e.rest", "s.draw").agg(F.sum("s.size").alias("n")))
    by_draw = Window.partitionBy("source").orderBy("draw")
    last = (inner.withColumn("end", F.col("start") + F.sum("n").over(by_draw))
            .where(F.col("end") - F.col("n") / 2 <= F.col("rest"))
            .groupBy("source").agg(F.max("draw").alias("last")))
    cut = (ends.alias("e").join(last.alias("l"), same("e", "l"), "left")
           .select("e.source", F.coalesce("l.last", "e.piece").alias("cutoff")))
    return staged(t.join(cut.alias("c"), same("t", "c"), "left").select(
        "t.source", "t.source_size", "t.target", F.col("t.whole").cast("long").alias("whole"),
        # With no end inside the order, the rest is the whole source: it cannot be, whole would be one more.
        F.coalesce("c.cutoff", F.lit("")).alias("cutoff")), "mix")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs`` as a struct ``doc``, with ``size, source_size, target, repeats``.

    A NULL text has size 0. A NULL source is a source, the last in order. Rows with equal doc_id
    have equal draws and are taken together; a source without words gets target 0 and no repeats.
    An empty table gives an empty result. Extra columns pass through inside ``doc``.
    """
    seed = options.get("seed", SEED)
    shares = allocate(docs.select("doc_id", "text", "source"), **options)
    rows = docs.select(F.struct("*").alias("doc"), F.col("source").alias("_source"),
                       word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("_draw"))
    both = rows.join(shares, F.col("_source").eqNullSafe(F.col("source")))
    extra = (F.col("_draw") <= F.col("cutoff")).cast("long")
    repeats = F.when(F.col("source_size") > 0, F.col("whole") + extra).otherwise(0)
    return both.select("doc", "size", "source_size", "target", repeats.cast("long").alias("repeats"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as it is taken, numbered from 1 by ``copy``, or, where ``docs`` has
    that column, by the first of ``mix_copy``, ``mix_mix_copy`` and so on that it does not have."""
    rows = mixed(docs, **options).where("repeats > 0")
    copy, taken = "copy", {c.lower() for c in docs.columns}
    while copy in taken:
        copy = f"mix_{copy}"
    return rows.select("doc.*", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias(copy))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents),
s AS (
  SELECT source, source_size, cap, w, cap / w AS ratio FROM (
    SELECT source, sum(size)::BIGINT AS source_size, (sum(size) * 2)::BIGINT AS cap,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
    FROM d GROUP BY source)),
-- With the k sources of least cap per weight clamped, the level of the others.
f AS (
  SELECT source, ratio, coalesce(sum(cap) OVER before, 0) AS held, (SELECT sum(w) FROM s) - coalesce(sum(w) OVER before, 0) AS free
  FROM s WINDOW before AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT ((SELECT sum(source_size) FROM s) * 3 - 2 * held)::BIGINT / (2 * free)::BIGINT AS level FROM f
  WHERE ((SELECT sum(source_size) FROM s) * 3 - 2 * held) <= 2 * free * ratio ORDER BY ratio, source LIMIT 1),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, level * w) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap::DOUBLE, level * w) / source_size) ELSE 0 END AS whole FROM s, l),
o AS (
  SELECT d.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY draw) - sum(size) OVER (PARTITION BY d.source, draw) / 2 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, max(draw) AS cutoff FROM o WHERE middle <= rest GROUP BY source)
SELECT o.doc_id, o.size, o.source_size, o.target,
       CASE WHEN o.source_size = 0 THEN 0
            ELSE o.size * (o.whole + CASE WHEN o.draw <= c.cutoff THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM o LEFT JOIN c ON o.source IS NOT DISTINCT FROM c.source
"""


@query("op5_mixing", SQL)
def op5_mixing(spark, sf_dir):
    """Size, the source's size and target, and the words that the mix takes of every document."""
    return mixed(table(spark, sf_dir, "documents")).select(
        "doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))
