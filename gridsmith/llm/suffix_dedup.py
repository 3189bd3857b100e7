"""Repeated byte strings across and within documents, removed wherever they are covered.

Every string of ``length`` bytes is told by an anchor inside it (the gram of least hash), so only
places whose anchor occurs again can repeat. There, the Burrows-Wheeler transforms of the segments
around equal anchors are merged by interleave refinement, column by column, which gives common
prefixes and repeated intervals of all their suffixes without sorting them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.base import query, table
from gridsmith.llm.suffixes import anchors, merge_columns
from gridsmith.session import staged

LENGTH = 200
GRAM = 48
BUCKET = 5_000  # segments merged by one task, about
DENSE = 50_000  # segments of one anchor that are still merged in one task


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, raw, t, e``: the bytes, and 80 bits that name the id with its text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", raw.alias("raw"), F.xxhash64(name, raw).alias("t"),
                       F.xxhash64(F.lit(1), name, raw).bitwiseAND(0xFFFF).alias("e"))


def packed_anchors(raw: Column, length: int, gram: int) -> Column:
    """Array of (at, g, c): place with distances to first and last start, gram hash, segment hash."""
    kind = "array<struct<at:bigint,g:bigint,c:bigint>>"

    @F.arrow_udf(kind)
    def find(texts: pa.Array) -> pa.Array:
        found = [anchors(t.as_py(), length, gram) for t in texts]
        sizes = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])])
        place, first, last, g, c = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in range(5))
        at = (place << 16) | ((place - first) << 8) | (place - last)
        inner = pa.StructArray.from_arrays([pa.array(at), pa.array(g), pa.array(c)], ["at", "g", "c"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), inner)

    return find(raw)


def bits(c: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(c, shift).bitwiseAND((1 << width) - 1)


def spans(docs: DataFrame, length: int, gram: int, bucket: int, dense: int) -> DataFrame:
    """``t, e, start, end``: stretches of documents covered by repeated strings; they may overlap."""
    if not 0 < gram <= length or length - gram > 255:
        raise ValueError("a gram is at most 255 bytes shorter than the string")
    found = staged(docs.select("t", "e", packed_anchors(F.col("raw"), length, gram).alias("a")), "anchors")
    flat = found.select("t", "e", F.inline("a")).select(
        "t", F.shiftleft("e", 47).bitwiseOR(F.col("at")).alias("at"), "g", "c")
    again = staged(flat.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "repeated-anchors")
    held = staged(flat.join(again, "g"), "holders")

    # Equal segments are one row, combined map-side: a passage of a third of all rows is one per task.
    shape = bits(F.col("at"), 0, 16)
    segments = staged(held.groupBy("g", "c", shape.alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "at")).alias("holder")).select(
        "g", "c", "shape", "n", "holder.t", "holder.at"), "segments")
    several = segments.where("n > 1").select("g", "c", "shape")
    place = bits(F.col("at"), 16, 31)
    start = (place - bits(F.col("at"), 8, 8)).cast("int")
    end = (place - bits(F.col("at"), 0, 8) + length).cast("int")
    whole = held.withColumn("shape", shape).join(several, ["g", "c", "shape"]).select(
        "t", bits(F.col("at"), 47, 16).alias("e"), start.alias("start"), end.alias("end"))

    kinds = staged(segments.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "mixed-anchors")
    sizes = kinds.agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.max("kinds"), F.lit(0))).first()
    open_segments = segments.join(kinds, "g")

    def cut(chosen: DataFrame) -> DataFrame:
        """Segments with their bytes, taken from the document of one holder each."""
        wanted = chosen.select("t", bits(F.col("at"), 47, 16).alias("e"), "g", "c", "shape", "n", "at",
                               start.alias("start"), (end - start).alias("size"))
        lists = wanted.groupBy("t", "e").agg(F.collect_list(F.struct("g", "c", "shape", "n", "at", "start", "size")).alias("w"))
        # doc_id goes along so that this is the same shuffle of texts as the caller's, made once.
        rows = docs.join(lists, ["t", "e"]).select("doc_id", "t", "e", "raw", F.explode("w").alias("w"))
        return rows.select("doc_id", "t", "e", "w.g", "w.c", "w.shape", "w.n", "w.at", "w.start",
                           F.substring(F.col("raw"), F.col("w.start") + 1, F.col("w.size")).alias("segment"))

    buckets = max(1, -(-int(sizes[0]) // bucket))
    merged = (cut(open_segments.where(F.col("kinds") <= dense))
              .groupBy(F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"))
              .applyInArrow(merge_bucket(length), "t long, e long, start int, end int"))
    out = whole.unionByName(merged)
    if sizes[1] > dense:
        out = out.unionByName(crowded(staged(cut(open_segments.where(F.col("kinds") > dense)), "crowded"), length))
    return out


def merge_bucket(length: int):
    """Stretches of the segments of one bucket that repeat inside other segments of their anchors."""
    def merge(rows: pa.Table) -> pa.Table:
        names = ("g", "c", "shape", "n", "at", "t", "e")
        g, c, shape, n, at, t, e = (rows[k].to_numpy() for k in names)
        # Rows that repeat a document bring the same segment again.
        keep = np.unique(np.stack([g, c, shape], axis=1), axis=0, return_index=True)[1]
        keep.sort()
        g, shape, n, at, t, e = (a[keep] for a in (g, shape, n, at, t, e))
        texts = rows["segment"].take(pa.array(keep)).to_pylist()
        before, after = (shape >> 8) & 0xFF, shape & 0xFF
        marks = merge_columns(texts, g, before, after, n, length)
        deepest = int(before.max())
        marks[n > 1] = False  # these are repeated as a whole
        edges = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edges == 1)
        last = np.nonzero(edges == -1)[1] - 1
        place = ((at >> 16) & 0x7FFFFFFF)[row]
        return pa.table({
            "t": pa.array(t[row], pa.int64()), "e": pa.array(e[row], pa.int64()),
            "start": pa.array(place + first - deepest, pa.int32()),
            "end": pa.array(place + last - deepest + length, pa.int32())})
    return merge


def crowded(segments: DataFrame, length: int) -> DataFrame:
    """The same for anchors with more segments than one task should hold: their windows are counted."""
    starts = F.sequence(F.lit(0), F.octet_length("segment") - length)
    windows = segments.dropDuplicates(["g", "c", "shape"]).select(
        "t", "e", "g", "n", "start", "segment", (bits(F.col("shape"), 8, 8)).alias("before"), F.explode(starts).alias("i"))
    window = F.substring(F.col("segment"), F.col("i") + 1, F.lit(length))
    keyed = windows.select("t", "e", "g", "n", (F.col("start") + F.col("i")).alias("start"),
                           (F.col("i") - F.col("before")).alias("x"), F.md5(window).alias("w"))
    counts = staged(keyed.groupBy("g", "x", "w").agg(F.sum("n").alias("held")).where("held > 1").drop("held"), "windows")
    return keyed.where("n = 1").join(counts, ["g", "x", "w"]).select(
        "t", "e", F.col("start").cast("int").alias("start"), (F.col("start") + length).cast("int").alias("end"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET,
                    dense: int = DENSE) -> DataFrame:
    """``doc_id, raw, kept, n_removed, n_spans`` per row: bytes without those that a repeated string covers.

    A string of ``length`` bytes is repeated if it starts anywhere else, in the same document too;
    strings never cross documents and are judged on the input. A NULL text is empty and, like any
    shorter than ``length``, has nothing to remove; of equal texts of at least ``length`` bytes
    nothing stays, repeated rows included. A NULL doc_id is an id; further columns are not read.
    What is left of a text need not be valid UTF-8, as bytes are removed, not characters.
    """
    base = identified(docs)
    found = spans(base, length, gram, bucket, dense)
    lists = found.groupBy("t", "e").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    @F.arrow_udf("kept binary, n_removed long, n_spans long")
    def remove(texts: pa.Array, stretches: pa.Array) -> pa.Array:
        kept, removed, runs = [], [], []
        for text, parts in zip(texts, stretches, strict=True):
            raw, out, at, n = text.as_py(), [], 0, 0
            reach = -1  # end of the run so far
            for start, end in sorted((s["start"], s["end"]) for s in parts.as_py() or []):
                if start > reach:
                    out.append(raw[at:start])
                    n += 1
                reach = max(reach, end)
                at = reach
            out.append(raw[at:])
            kept.append(b"".join(out))
            removed.append(len(raw) - len(kept[-1]))
            runs.append(n)
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
            ["kept", "n_removed", "n_spans"])

    rows = base.join(lists, ["t", "e"], "left")
    return rows.select("doc_id", "raw", remove("raw", "spans").alias("r")).select("doc_id", "raw", "r.*")


@query("op7_suffix_array_dedup")
def op7_suffix_array_dedup(spark, sf_dir):
    """Bytes removed from every document, and a digest of what is left."""
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), "n_removed", "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"))
