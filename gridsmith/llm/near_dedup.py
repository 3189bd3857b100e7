"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.base import block_keys, components, distance, query, table
from gridsmith.llm.kernels import majority, shingle_hashes, words_of
from gridsmith.session import staged

WIDTH = 3
RADIUS = 2
BLOCKS = 4
DENSE = 64  # rows of a block that are still compared in pairs


def simhash(text: Column, width: int = WIDTH) -> Column:
    """Fingerprint of the word shingles, repeats included; 0 for a text without words or NULL."""
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([majority(shingle_hashes(words_of(t.as_py()), width)) for t in texts], pa.int64())

    return fingerprint(text)


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def masks(bits: int, most: int) -> list[int]:
    """All words with at most ``most`` bits set, as signed 64-bit numbers."""
    out = []
    for n in range(most + 1):
        for places in combinations(range(bits), n):
            word = sum(1 << p for p in places)
            out.append(word - (1 << 64) if word >> 63 else word)
    return out


def links(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, dense: int = DENSE) -> DataFrame:
    """``a, b``: links between different fingerprints (column ``fp``, distinct) within the radius.

    Close pairs share all leading blocks of some table; those that share them are joined and their
    distance verified. A block shared by more than ``dense`` fingerprints would give all pairs of a
    dense group. There, each fingerprint meets others at the words half way: two lie within the
    radius exactly if some word is within floor(radius/2) of one and the rest of the other, and one
    link for each to the smallest there keeps all of them connected. So every fingerprint has the
    same component as with all pairs, and no link is longer than the radius.
    """
    keyed = staged(fingerprints.select("fp", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("k"))
                   .select("fp", "k.table", "k.key"), "blocks")
    sizes = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = staged(sizes, "block-sizes")
    plain = keyed.join(sizes.where(F.col("n") <= dense), ["table", "key"], "left_semi")
    pairs = (plain.select("table", "key", F.col("fp").alias("a"))
             .join(plain.select("table", "key", F.col("fp").alias("b")), ["table", "key"])
             .where((F.col("a") < F.col("b")) & (distance(F.col("a"), F.col("b")) <= radius))
             .select("a", "b").distinct())
    crowded = sizes.where(F.col("n") > dense)
    if crowded.isEmpty():
        return pairs
    small = radius // 2
    group = staged(keyed.join(crowded, ["table", "key"], "left_semi").select("fp").distinct(), "dense")
    words = lambda most: group.select(
        "fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in masks(64, most)])).alias("word"))
    centres = staged(words(small).groupBy("word").agg(F.min("fp").alias("b")), "centres")
    stars = (words(radius - small).join(centres, "word").where("fp <> b")
             .select(F.col("fp").alias("a"), "b").distinct())
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, blocks: int = BLOCKS,
                    dense: int = DENSE) -> DataFrame:
    """``doc_id, fp, component_id`` per row: the smallest doc_id reachable over links, itself included.

    Equal fingerprints are one class before any join, so copies never meet in pairs. NULL and empty
    texts have fingerprint 0 and are linked like any other; repeated rows are rows of one class; a
    NULL doc_id is never the smallest unless its component has no other. An empty table gives an
    empty result; further columns are not read.
    """
    rows = staged(docs.select("doc_id", simhash(F.col("text"), width).alias("fp")), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), radius, blocks, dense))
    least = (roots.join(classes, roots.node == classes.fp).groupBy("root").agg(F.min("first").alias("component_id")))
    named = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    labels = staged(classes.join(named, "fp", "left").select(
        "fp", F.when(F.col("component_id").isNull(), F.col("first")).otherwise(F.col("component_id"))
        .alias("component_id")), "labels")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component of near duplicates: that of the smallest doc_id, in one row.

    Rows that share a doc_id, NULL included, are one document. A doc_id with texts in several
    components stays if it is the smallest of any of them. Columns of any name pass through; an
    empty table stays empty.
    """
    found = staged(near_duplicates(docs, **options).select("doc_id", "component_id"), "near")
    per_id = staged(found.groupBy("doc_id").agg(
        F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count(F.lit(1)).alias("rows")), "near")
    # Staged on its own, so that Spark knows its size: small, it goes to the texts, not the texts to it.
    gone = staged(per_id.where("NOT stays").select("doc_id"), "gone").alias("g")
    rows = docs.select("doc_id", F.struct("*").alias("doc")).alias("r")
    same = lambda side: F.col("r.doc_id").eqNullSafe(F.col(f"{side}.doc_id"))
    kept = rows.join(gone, same("g"), "left_anti")
    repeated = per_id.where("stays AND rows > 1").select("doc_id").alias("t")
    if repeated.isEmpty():
        return kept.select("doc.*")
    twice = kept.alias("r").join(repeated, same("t"), "left_semi").dropDuplicates(["doc_id"])
    return kept.alias("r").join(repeated, same("t"), "left_anti").unionByName(twice).select("doc.*")


@query("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
