"""Importance resampling towards a target: hashed n-gram gains, seeded noise, a cutoff by exact counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.base import query, ranked, table
from gridsmith.session import staged

BUCKETS = 10_000
SCALE = 1000
SEED = 7
LEAST_WORDS = 20
SHARE = (25, 100)
PIECES = 16  # of a range of values, counted by one job
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of letters and digits of ASCII, in lower case, and of all further characters."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def buckets(word_array: Column, n_buckets: int = BUCKETS) -> Column:
    """The bucket of each word and of each pair of consecutive words, repeats included."""
    place = lambda feature: (F.crc32(feature) % n_buckets).cast("int")
    after = F.slice(word_array, 2, F.greatest(F.size(word_array) - 1, F.lit(0)))
    pairs = F.transform(after, lambda w, i: place(F.concat(F.get(word_array, i), F.lit(" "), w)))
    return F.concat(F.transform(word_array, place), pairs)


def bucket_counts(texts: DataFrame, name: str, n_buckets: int) -> DataFrame:
    """``bucket`` and its number of features ``name``: counted map-side, so a task sends one short row for each bucket."""
    rows = texts.select(words(F.col("text")).alias("w")).select(F.explode(buckets(F.col("w"), n_buckets)).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """One row ``gains``: an array of the whole gain of every bucket, from add-one shares in both corpora."""
    both = bucket_counts(docs, "s", n_buckets).join(bucket_counts(target, "t", n_buckets), "bucket", "full")
    every = docs.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = staged(every.join(both, "bucket", "left").select(
        "bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "counts")
    sums = counts.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    over = (F.col("t") + 1).cast("double") * float(sums.S + n_buckets)
    under = (F.col("s") + 1).cast("double") * float(sums.T + n_buckets)
    gain = F.floor(scale * F.ln(over / under)).alias("gain")
    return staged(counts.select("bucket", gain).agg(F.sort_array(F.collect_list(F.struct("bucket", "gain"))).alias("g"))
                  .select(F.col("g.gain").alias("gains")), "gains")


def noise(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """A whole Gumbel draw that the seed and the id decide."""
    drawn = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8)
    h = F.conv(drawn, 16, 10).cast("double")
    return F.floor(-scale * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """``row, doc_id, n_words, n_features, weight, score`` of whole texts, staged: a number of each row, then the contract's columns."""
    table_of_gains = gains(docs, target, n_buckets, scale)
    rows = docs.select("doc_id", words(F.col("text")).alias("w"), table_of_gains.select("gains").scalar().alias("gains"))
    # An array in an array: the gains are named once, so they are no column of a row.
    total = F.get(F.transform(F.array("gains"), lambda g: F.aggregate(
        buckets(F.col("w"), n_buckets), F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(g, b))), F.lit(0))
    summed = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), total.alias("total"))
    n = F.col("n_words") + F.greatest(F.col("n_words") - 1, F.lit(0))
    mean = F.when(n == 0, F.lit(0).cast("long")).otherwise(((F.col("total") - F.pmod(F.col("total"), n)) / n).cast("long"))
    placed = summed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", n.alias("n_features"), mean.alias("weight"))
    return staged(placed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed, scale)), "scored")


def cutoff(rows: DataFrame, value: str, need: int) -> tuple[int, int]:
    """The least ``v`` with at least ``need`` rows of ``value <= v``, and the number of rows below it.

    ``rows`` has at least ``need`` rows, all with a value. Each job counts exactly, at the ends of
    equal pieces of the range that is left; no value comes to the driver but the ends.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    below = 0
    while low < high:
        width = -(-(high - low + 1) // PIECES)
        ends = [e for e in range(low + width - 1, high, width)]
        counts = rows.agg(*[F.count(F.when(F.col(value) <= F.lit(e), 1)) for e in ends]).first()
        for end, count in zip(ends, counts, strict=True):
            if count >= need:
                high = end
                break
            low, below = end + 1, count
    return low, below


def drawn(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of highest score, ties to the smaller doc_id (NULL last), then to the earlier row.

    The cutoff of each value in turn is found among the rows tied so far.
    """
    keyed = rows.withColumns({"falling": -F.col("score"), "unnamed": F.col("doc_id").isNull().cast("long"),
                              "id": F.coalesce("doc_id", F.lit(0)).cast("long")})
    if n <= 0:
        return rows.limit(0)
    chosen, tied = F.lit(False), F.lit(True)
    for value in ("falling", "unnamed", "id", "row"):
        at, below = cutoff(keyed.where(tied), value, n)
        chosen = chosen | (tied & (F.col(value) < F.lit(at)))
        tied = tied & (F.col(value) == F.lit(at))
        n -= below
        if keyed.where(tied).count() == n:
            break
    return keyed.where(chosen | tied).select(*rows.columns)


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; ``rank`` is NULL where the row is not drawn.

    ``docs`` needs ``doc_id`` (a whole number) and ``text``, ``target`` needs ``text``; further columns
    are not read. NULL and empty texts have no features and weight 0, and no text of fewer than
    ``least_words`` words is drawn. Rows that repeat a doc_id have one noise and are drawn one by
    one; a NULL doc_id draws as the name "null" and loses ties. Without a target all gains follow
    from add-one shares; an empty table gives an empty result.
    """
    rows = scored(docs, target, **options)
    able = rows.where(F.col("n_words") >= least_words)
    best = drawn(able, able.count() * share[0] // share[1])
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranks = ranked(best.select("row", "score", "doc_id"), order, "place").select("row", (F.col("place") + 1).alias("rank"))
    return rows.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_importance_resampling")
def op13_importance_resampling(spark, sf_dir):
    """Features, weight, score and rank of every document, drawn towards the benchmark texts."""
    return resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
