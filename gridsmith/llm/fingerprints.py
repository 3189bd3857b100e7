"""Document fingerprints by weighted SimHash, and all fingerprints within a Hamming radius."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from gridsmith.llm.base import block_keys, distance, query, table
from gridsmith.llm.kernels import weighted_simhash
from gridsmith.llm.near_dedup import hex_digits
from gridsmith.session import staged

RADIUS = 3
BLOCKS = 5
EVERY = 100


def fingerprint(text: Column) -> Column:
    """64 bits of a whole text; 0 for a text without words. Equal texts have equal fingerprints."""
    @F.arrow_udf("long")
    def vote(texts: pa.Array) -> pa.Array:
        return pa.array([weighted_simhash(t.as_py()) for t in texts], pa.int64())

    return vote(text)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - distance(a, b) / 64


def within(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``query, fp, bits``: every fingerprint ``fp`` of the index within ``radius`` bits of a query.

    Both sides hold distinct fingerprints. One table per choice of leading blocks: two words within
    the radius agree on all leading blocks of some table, so none is missed; candidates of a table
    are then verified. Queries meet the index by equal keys only.
    """
    probe = queries.select(F.col("fp").alias("query"), F.explode(block_keys(F.col("fp"), radius, blocks)).alias("k"))
    rows = index.select("fp", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("k"))
    return (rows.select("fp", "k.table", "k.key").join(probe.select("query", "k.table", "k.key"), ["table", "key"])
            .withColumn("bits", distance(F.col("query"), F.col("fp"))).where(F.col("bits") <= radius)
            .select("query", "fp", "bits").distinct())


def edit(text: str, following: str) -> str:
    """The text with its last floor(n/4) code points replaced by the first as many of the following one."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


GROUP = pa.schema([
    ("_kind", pa.int8()), ("_part", pa.int32()), ("_id", pa.string()), ("_times", pa.int64()), ("_text", pa.string())])
FINISHED, FIRST, LAST = 0, 1, 2


def along_order(describe: Callable[[str, str], tuple], fields: pa.Schema):
    """Sorted rows of a partition to one row per document with ``describe(text, next text)``.

    Documents stream by one at a time. The first and the last of the partition come out as they
    are, as their neighbours are in other partitions.
    """
    schema = pa.schema([*GROUP, *fields])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """``doc_id, text, times`` of runs of equal rows."""
        last, times = None, 0
        for batch in batches:
            for row in ((name.as_py(), text.as_py()) for name, text in zip(*batch.columns, strict=True)):
                if row == last:
                    times += 1
                    continue
                if last is not None:
                    yield (*last, times)
                last, times = row, 1
        if last is not None:
            yield (*last, times)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, empty = TaskContext.get().partitionId(), (None,) * len(fields)
        out, before = [], None

        def packed() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for name, text, times in rows_of(batches):
            if before is None:
                out.append((FIRST, part, name, times, text, *empty))
            else:
                out.append((FINISHED, part, before[0], before[2], None, *describe(before[1], text)))
            before = (name, text, times)
            if len(out) >= 1000:
                yield packed()
        if before is not None:
            out.append((LAST, part, before[0], before[2], before[1], *empty))
        yield packed()

    return walk, schema


def with_successor(docs: DataFrame, describe: Callable[[str, str], tuple], fields: pa.Schema) -> DataFrame:
    """``doc_id`` and ``fields`` per row: ``describe(text, text of the next document)``, staged.

    The order is that of doc_id, after the last comes the first. Rows that repeat doc_id and text
    are one document in it, with equal results; rows that share a doc_id with other texts follow
    by a hash of the text; a NULL doc_id comes first, a NULL text is empty. A single document is
    its own successor. Texts are shuffled once, into ranges of the order; only the two documents
    at the ends of a range travel on to meet their neighbours. Further columns are not read.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.xxhash64(F.lit(1), "text").asc()]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    walk, schema = along_order(describe, fields)
    names = [f.name for f in fields]
    walked = staged(ranges.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(
        walk, from_arrow_schema(schema)), "successors")
    # One short row per range; after the last comes the first.
    along = Window.orderBy("_part")
    everything = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = walked.where(F.col("_kind") == LAST).select(
        "_part", F.coalesce(F.lead("_part").over(along), F.first("_part").over(everything)).alias("after"))
    heads = walked.where(F.col("_kind") == FIRST).select(F.col("_part").alias("after"), F.col("_text").alias("next"))
    ends = walked.where(F.col("_kind") == LAST).select("_part", "_id", "_times", "_text").join(following, "_part").join(heads, "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pa.schema([GROUP.field("_id"), GROUP.field("_times"), *fields])
        for batch in batches:
            made = [(d, n, *describe(t, x)) for d, n, t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = zip(*made, strict=True) if made else [()] * len(kept)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kept, strict=True)], schema=kept)

    joined = ends.select("_id", "_times", "_text", "next").mapInArrow(
        finish, from_arrow_schema(pa.schema([GROUP.field("_id"), GROUP.field("_times"), *fields])))
    whole = walked.where(F.col("_kind") == FINISHED).select("_id", "_times", *names).unionByName(joined)
    # Rows that repeat a document repeat its result.
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "_times"))
    return staged(whole.select(F.col("_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *names, copies.alias("_copy"))
                  .drop("_copy"), "described")


def edited(docs: DataFrame) -> DataFrame:
    """``doc_id, text, edited``: each text, and with its last quarter replaced (see ``with_successor``)."""
    return with_successor(docs, lambda text, following: (text, edit(text, following)),
                          pa.schema([("text", pa.string()), ("edited", pa.string())]))


EDITS = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.int64()), ("edited_fp", pa.int64()),
                   ("next_fp", pa.int64())])


def edit_prints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp``: fingerprints of each text, its edit and its successor."""
    known: dict[str, int] = {}

    def print_of(text: str) -> int:
        # A text is first the next one and then the one itself.
        if text not in known:
            if len(known) > 1:
                known.clear()
            known[text] = weighted_simhash(text)
        return known[text]

    def describe(text: str, following: str) -> tuple:
        own, after, changed = print_of(text), print_of(following), edit(text, following)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return len(text), digest, own, weighted_simhash(changed), after

    return with_successor(docs, describe, EDITS)


@query("op10_document_fingerprints")
def op10_document_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, their likeness and the next document's,
    and, for every hundredth id, how many other documents and texts lie within the radius."""
    rows = edit_prints(table(spark, sf_dir, "documents"))
    classes = staged(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies")), "classes")
    isasked = F.col("doc_id") % EVERY == 0
    asked = staged(rows.where(isasked).select("fp").distinct(), "asked")
    found = within(asked, classes.select("fp")).join(classes, "fp")
    near = staged(found.groupBy(F.col("query").alias("fp")).agg(
        (F.sum("copies") - 1).alias("near_docs"), (F.count(F.lit(1)) - 1).alias("near_fingerprints")), "near")
    return rows.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", hex_digits(F.col("fp")).alias("fingerprint"),
        hex_digits(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(isasked, F.col("near_docs")).alias("near_docs"),
        F.when(isasked, F.col("near_fingerprints")).alias("near_fingerprints"))
