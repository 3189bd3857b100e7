"""Boilerplate lines: spread over distinct sites by HyperLogLog, exact where it is close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.base import query, table
from gridsmith.session import staged

MIN_SITES = 10
LG_K = 12
BAND = 0.2  # over ten times the relative error of a sketch of 2^12 registers
BLANKS = " \t\r\x0b\x0c"


def line_array(text: Column) -> Column:
    return F.split(text, "\n")


def line_keys(line: Column) -> list[Column]:
    """128 bits of the line without blanks at its ends."""
    bare = F.btrim(line, F.lit(BLANKS))
    return [F.xxhash64(bare).alias("k1"), F.xxhash64(F.lit(1), bare).alias("k2")]


def site_counts(lines: DataFrame, lg_k: int) -> DataFrame:
    """``k1, k2, sites``: the estimated number of distinct sites of each line."""
    return lines.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """``k1, k2`` of the lines (``k1, k2, site``) found on at least ``min_sites`` distinct sites.

    One sketch per line, built map-side and merged: a line on a third of all rows is one short row
    per task. Estimates beyond the band decide; lines inside it get an exact distinct count, whose
    rows are (line, site) pairs, distinct map-side first.
    """
    wide = staged(site_counts(lines, lg_k).where(F.col("sites") >= (1 - band) * min_sites), "spread")
    sure = wide.where(F.col("sites") > (1 + band) * min_sites).select("k1", "k2")
    near = wide.where(F.col("sites") <= (1 + band) * min_sites).select("k1", "k2")
    exact = (lines.join(near, ["k1", "k2"]).groupBy("k1", "k2").agg(F.count_distinct("site").alias("sites"))
             .where(F.col("sites") >= min_sites).select("k1", "k2"))
    return staged(sure.union(exact), "boilerplate")


def text_keys() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """All columns of ``docs`` as a struct ``doc``, with ``n_lines, n_removed, kept`` (the remaining text).

    A site is a ``source``; rows without one belong to one unnamed site. Each distinct text counts
    once, on the least of its sites, so copies of a page do not make its lines spread; then every
    spread line goes from every document, however much of it that is. Lines are compared without
    blanks at their ends; blank lines stay. A NULL text has no lines and stays NULL, an empty one
    has one blank line. Repeated rows have equal results; extra columns of any name pass through;
    an empty table gives an empty result.

    The sites of all rows are never fewer than those of distinct texts: their sketches leave the
    lines that can be spread, and only places of these learn which of their texts are copies.
    """
    site = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    texts = docs.where("text IS NOT NULL").select(*text_keys(), site.alias("site"), "text")
    lines = (texts.select("t1", "t2", "site", F.posexplode(line_array(F.col("text"))).alias("pos", "line"))
             .where(F.btrim("line", F.lit(BLANKS)) != "").select("t1", "t2", "site", "pos", *line_keys(F.col("line"))))
    wide = staged(site_counts(lines, LG_K).where(F.col("sites") >= (1 - BAND) * min_sites).select("k1", "k2"), "wide")
    held = staged(lines.join(wide, ["k1", "k2"]), "held")
    copied = staged(texts.groupBy("t1", "t2").agg(F.min("site").alias("one"), F.max("site").alias("last"))
                    .where("one <> last").select("t1", "t2", "one"), "copied")
    counted = held.join(copied, ["t1", "t2"], "left").select("k1", "k2", F.coalesce("one", "site").alias("site"))
    spread = spread_lines(counted, min_sites)
    # Positions to remove are found per distinct text, so neither copies nor repeated ids matter.
    places = staged(held.join(spread, ["k1", "k2"]).groupBy("t1", "t2").agg(F.collect_set("pos").alias("gone")), "places")
    rows = docs.select(F.struct("*").alias("doc"), "text", *text_keys()).join(places, ["t1", "t2"], "left")
    array = line_array(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(array) - 1), F.col("gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.get(array, i)), "\n")
    removed = F.col("gone").isNotNull()
    return rows.select(
        "doc", F.when(F.col("text").isNull(), 0).otherwise(F.size(array)).alias("n_lines"),
        F.when(removed, F.size("gone")).otherwise(0).alias("n_removed"),
        F.when(removed, rest).otherwise(F.col("text")).alias("kept"))


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``; ``n_chars``, if there, counts what is left."""
    rows = without_boilerplate(docs, **options)
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return rows.select(*[
        new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("doc").getField(c).alias(c)
        for c in docs.columns])


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT r, source, unnest(range(1, len(a) + 1)) AS pos, trim(unnest(a), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM d),
o AS (SELECT text, min(coalesce('s' || source, 'n')) AS site FROM documents GROUP BY text),
b AS (SELECT line FROM l JOIN d USING (r) JOIN o ON d.text = o.text WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
g AS (SELECT r, list(pos) AS gone FROM l JOIN b USING (line) GROUP BY r)
SELECT doc_id, coalesce(len(a), 0)::INT AS n_lines, coalesce(len(gone), 0)::INT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN text
              ELSE array_to_string([a[i] FOR i IN range(1, len(a) + 1) IF NOT list_contains(gone, i)], chr(10)) END) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""


@query("op3_line_dedup", SQL)
def op3_line_dedup(spark, sf_dir):
    """Lines and removed lines of every document, with a digest of the text that is left."""
    return without_boilerplate(table(spark, sf_dir, "documents")).select(
        "doc.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
