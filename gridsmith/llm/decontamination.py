"""Benchmark items inside documents: size-partitioned MinHash containment, verified exactly.

Native throughout: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm.base import query, table
from gridsmith.session import staged

WIDTH = 5
THRESHOLD = (4, 5)  # containment of 0.8


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def places(items: Column, width: int) -> Column:
    """Start places of the runs of ``width`` neighbours."""
    n = F.size(items) - width
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(word_hashes: Column, width: int) -> Column:
    return F.transform(places(word_hashes, width), lambda i: F.xxhash64(*[F.get(word_hashes, i + j) for j in range(width)]))


def shingles(word_array: Column, width: int) -> Column:
    return F.transform(places(word_array, width), lambda i: F.array_join(F.slice(word_array, i + 1, width), " "))


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """``item_id, width, shingle, h, n``: the distinct shingles of each item and their number.

    An item of fewer words has one shingle of all its words.
    """
    rows = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("width", F.least(F.lit(width), F.size("w")))
    short = lambda make, of: F.coalesce(*[F.when(F.col("width") == k, make(of, k)) for k in range(1, width + 1)])
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    exploded = rows.withColumn("wh", hashes).select(
        "item_id", "width", F.explode(F.arrays_zip(short(shingles, F.col("w")).alias("shingle"),
                                                   short(shingle_hashes, F.col("wh")).alias("h"))).alias("s"))
    flat = exploded.select("item_id", "width", "s.shingle", "s.h").distinct()
    counts = flat.groupBy("item_id").agg(F.count_distinct("shingle").alias("n"))
    return flat.join(counts.withColumnRenamed("item_id", "_id"), F.col("item_id").eqNullSafe(F.col("_id"))).drop("_id")


def needed(n: Column, threshold: tuple[int, int]) -> Column:
    """The least number of shared shingles out of n."""
    return F.floor((n * threshold[0] + (threshold[1] - 1)) / threshold[1]).cast("long")


def sketches(shingled: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``item_id, h, need``: the bottom-k MinHash sketch of each item and how many of it must be met.

    Items are partitioned by size into classes up to 1, 2, 4, 8 ... shingles, and a class has its
    own k: twice what an item of its largest size may lack, and one more. A document that holds
    enough of an item lacks at most ``n - needed`` of its shingles, so it meets at least
    ``k - (n - needed)`` of the sketch: no item is ever missed, and few others come through.
    """
    largest = F.pow(F.lit(2), F.ceil(F.log2("n")))
    k = F.least(F.col("n"), 2 * F.floor(largest * (threshold[1] - threshold[0]) / threshold[1]) + 1).cast("long")
    order = Window.partitionBy("item_id").orderBy(F.xxhash64("h", F.lit("minhash")), "h")
    hashes = shingled.select("item_id", "h", "n").distinct()
    return (hashes.withColumn("place", F.row_number().over(order)).withColumn("k", k).where("place <= k")
            .select("item_id", "h", (F.col("k") - (F.col("n") - needed(F.col("n"), threshold))).alias("need")))


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH,
                    threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared``: items held by documents to at least the threshold.

    Whole texts of any length are searched; what an item shares may lie anywhere in the document.
    Document shingles meet only the sketches (joined by hash; broadcast only if Spark measures them
    as small); documents that meet enough are shingled again and verified on the shingle texts.
    Documents or items without words hold and give nothing. Rows that share a doc_id (or item_id),
    NULL included, are one document (item). Empty tables give an empty result; further columns are
    not read.
    """
    shingled = staged(item_shingles(items, width), "item-shingles")
    widths = sorted(r[0] for r in shingled.select("width").distinct().collect())  # at most ``width`` rows
    if not widths:
        widths = [width]
    sketch = staged(sketches(shingled, threshold), "sketches")
    hashed = docs.select("doc_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("wh"))
    probes = hashed.select("doc_id", F.explode(F.concat(*[shingle_hashes(F.col("wh"), k) for k in widths])).alias("h"))
    met = (probes.join(sketch, "h").groupBy("doc_id", "item_id", "need").agg(F.count_distinct("h").alias("met"))
           .where("met >= need"))
    candidates = staged(met.select(F.col("doc_id").alias("_doc"), F.col("item_id").alias("_item")), "candidates")
    suspects = docs.select("doc_id", "text").join(
        candidates.select("_doc").distinct(), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    spelled = suspects.select("doc_id", words(F.col("text")).alias("w")).select(
        "doc_id", F.explode(F.array_distinct(F.concat(*[shingles(F.col("w"), k) for k in widths]))).alias("shingle"))
    shared = (spelled.join(shingled.select("item_id", "shingle", "n").distinct(), "shingle")
              .groupBy("doc_id", "item_id", F.col("n").alias("n_shingles"))
              .agg(F.count_distinct("shingle").alias("n_shared"))
              .where(F.col("n_shared") >= needed(F.col("n_shingles"), threshold)))
    return shared.join(candidates, F.col("doc_id").eqNullSafe(F.col("_doc"))
                       & F.col("item_id").eqNullSafe(F.col("_item")), "left_semi")


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns of any name pass through."""
    found = staged(contained_items(docs, items, **options).select("doc_id").distinct(), "leaks").alias("f")
    rows = docs.select("doc_id", F.struct("*").alias("doc")).alias("r")
    return rows.join(found, F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")), "left_anti").select("doc.*")


def word_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"


def shingle_sql(source: str, key: str) -> str:
    return (f"SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - {WIDTH - 2}, 1)), "
            f"lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS shingle "
            f"FROM (SELECT {key}, {word_sql('text')} AS w FROM {source})")


SQL = f"""
WITH i AS ({shingle_sql('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
d AS ({shingle_sql('documents', 'doc_id')})
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM d JOIN i USING (shingle) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) * {THRESHOLD[1]} >= n * {THRESHOLD[0]}
"""


@query("op1_decontamination", SQL)
def op1_decontamination(spark, sf_dir):
    """Benchmark items held by documents."""
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
