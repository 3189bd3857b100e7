"""Vectors as short codes: a codebook for each part, fitted in rounds, nearest entries by Orchard's search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.base import query, table
from gridsmith.session import staged

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 1 << 27  # components beyond it count as it: sums of squared distances then fit 64 bits
SEARCHED = 4096  # parts that search side by side


def component_codes(vector: Column, scale: int = SCALE) -> Column:
    """Whole components, NULL where the vector is NULL or empty or holds NULL or non-finite components."""
    values = vector.cast("array<double>")
    fine = (F.size(values) > 0) & F.forall(values, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    whole = F.transform(values, lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return F.when(fine, whole)


def cuts(length: int, parts: int) -> list[slice]:
    """Consecutive parts, equal where the length allows, else the first ones longer by one."""
    ends = np.cumsum([length // parts + (i < length % parts) for i in range(parts)])
    return [slice(int(b) - length // parts - (i < length % parts), int(b)) for i, b in enumerate(ends)]


class Neighbours:
    """A codebook with, for every entry, all entries sorted by their distance from it."""

    def __init__(self, book: np.ndarray):
        self.book = book
        apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.lists, axis=1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry, ties to the lower index.

        Orchard's search, for many points side by side. A point goes down the list of its current
        entry; a better entry's list takes its place. Beyond twice the current distance (four times
        the squared one) no entry can be as near as the current one, by the triangle inequality.
        """
        n, entries = len(points), len(self.book)
        at = np.zeros(n, np.int64)
        best = ((points - self.book[0]) ** 2).sum(axis=1)
        place = np.zeros(n, np.int64)
        visited = np.zeros((n, entries), bool)
        visited[:, 0] = True
        live = np.arange(n)
        while len(live):
            here, step = at[live], place[live]
            going = (step < entries) & (self.apart[here, np.minimum(step, entries - 1)] <= 4 * best[live])
            live, here, step = live[going], here[going], step[going]
            if not len(live):
                break
            other = self.lists[here, step]
            place[live] += 1
            new = ~visited[live, other]
            asked, other = live[new], other[new]
            visited[asked, other] = True
            apart = ((points[asked] - self.book[other]) ** 2).sum(axis=1)
            better = (apart < best[asked]) | ((apart == best[asked]) & (other < at[asked]))
            moved = asked[better]
            at[moved], best[moved], place[moved] = other[better], apart[better], 0
        return at, best


def assigned(matrix: np.ndarray, books: list[Neighbours]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows by parts) and the squared distances summed over parts."""
    codes = np.zeros((len(matrix), len(books)), np.int64)
    errors = np.zeros(len(matrix), np.int64)
    for start in range(0, len(matrix), SEARCHED):
        rows = slice(start, start + SEARCHED)
        for p, cut in enumerate(cuts(matrix.shape[1], len(books))):
            codes[rows, p], apart = books[p].nearest(matrix[rows, cut])
            errors[rows] += apart
    return codes, errors


def as_matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def part_sums(vectors: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """``part, entry, pos, total, n`` over all vectors: each task adds its own, then Spark adds those of all tasks."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Neighbours(b) for b in books]
        entries = len(books[0])
        counts = np.zeros((len(books), entries), np.int64)
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            matrix = as_matrix(batch.column(0), length)
            codes, _ = assigned(matrix, lists)
            for p, cut in enumerate(cuts(length, len(books))):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(totals[p], codes[:, p], matrix[:, cut])
        for p, total in enumerate(totals):
            used = np.flatnonzero(counts[p])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[p][used]),
                 pa.array(list(total[used]), pa.list_(pa.int64()))], ["part", "entry", "n", "totals"])

    sums = vectors.select("codes").mapInArrow(add, "part int, entry int, n long, totals array<long>")
    return (sums.select("part", "entry", "n", F.posexplode("totals").alias("pos", "total"))
            .groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))


def kept_vectors(vectors: DataFrame, key: str, column: str, entries: int) -> tuple[DataFrame, np.ndarray]:
    """All columns as a struct ``row`` with whole components ``codes``, staged, and the first entries' vectors.

    Of several lengths that of the smallest key's vector is kept; ties of keys go by the vector.
    """
    whole = vectors.select(F.struct("*").alias("row"), component_codes(F.col(column)).alias("codes")).where("codes IS NOT NULL")
    whole = staged(whole, "vectors")
    first = whole.select(F.col(f"row.{key}").alias("key"), "codes").orderBy(F.col("key").asc_nulls_last(), "codes")
    least = first.limit(1).collect()  # one vector
    if not least:
        return whole, np.zeros((0, 0), np.int64)
    whole = whole.where(F.size("codes") == len(least[0].codes))
    first = first.where(F.size("codes") == len(least[0].codes))
    return whole, np.array([r.codes for r in first.limit(entries).collect()], np.int64)  # at most ``entries`` vectors


def fitted(whole: DataFrame, first: np.ndarray, parts: int, rounds: int) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds over all vectors. A round brings one sum per entry to the driver."""
    length = first.shape[1]
    books = [first[:, cut].copy() for cut in cuts(length, parts)]
    for _ in range(rounds):
        for part, entry, pos, total, n in part_sums(whole, books, length).collect():
            books[part][entry, pos] = total // n
    return books


def compressed(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
               rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """All columns of the kept rows as a struct ``row``, with ``code`` (hex, a byte for each part) and ``error``, and the codebooks.

    Rows whose vector is NULL, empty, or holds NULL or non-finite components are dropped, and those of
    another length than the vector of the smallest key. Whole components beyond 2^27 count as 2^27.
    Fewer rows than entries make smaller codebooks; repeated rows weigh as often as they stand; a NULL
    key is the last; an empty table gives an empty result.
    """
    if entries > 256:
        raise ValueError("a code is one byte for each part")
    whole, first = kept_vectors(vectors, key, column, entries)
    books = fitted(whole, first, parts, rounds) if len(first) else []
    length = first.shape[1]

    @F.arrow_udf("code string, error long")
    def encode(rows: pa.Array) -> pa.Array:
        codes, errors = assigned(as_matrix(rows, length), [Neighbours(b) for b in books])
        return pa.StructArray.from_arrays(
            [pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string()), pa.array(errors)], ["code", "error"])

    coded = whole.select("row", encode("codes").alias("c")) if books else whole.select(
        "row", F.struct(F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).alias("c"))
    return staged(coded.select("row", "c.code", "c.error"), "codes"), books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def codes_sql(rounds: int = ROUNDS) -> str:
    """The same in SQL: every distance of every part to every entry, round after round."""
    nearest = ("a{k} AS MATERIALIZED (SELECT rid, p, min(struct_pack(d := d, e := e)) AS m FROM (SELECT x.rid, x.p, c.e, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d "
               "FROM x JOIN c{k} c USING (p, i) GROUP BY x.rid, x.p, c.e) GROUP BY rid, p)")
    moved = ("c{n} AS MATERIALIZED (SELECT c.p, c.e, c.i, coalesce(floor(s / n)::BIGINT, c.x) AS x FROM c{k} c LEFT JOIN (SELECT x.p, a.m.e AS e, x.i, "
             "sum(x.x)::DOUBLE AS s, count(*) AS n FROM x JOIN a{k} a USING (rid, p) GROUP BY ALL) s ON c.p = s.p AND c.e = s.e AND c.i = s.i)")
    steps = ", ".join(nearest.format(k=k) + ", " + moved.format(k=k, n=k + 1) for k in range(rounds))
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT rid, (j - 1) // (n // {PARTS}) AS p, (j - 1) % (n // {PARTS}) AS i, v[j] AS x
  FROM (SELECT rid, v, len(v) AS n, unnest(range(1, len(v) + 1)) AS j FROM k)),
c0 AS MATERIALIZED (SELECT p, rid AS e, i, x FROM x WHERE rid < {ENTRIES}),
{steps}, {nearest.format(k=rounds)},
b AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT rid, string_agg(lower(lpad(to_hex(m.e), 2, '0')), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN r USING (rid), b
"""


@query("op11_vector_codes", codes_sql())
def op11_vector_codes(spark, sf_dir):
    """Code and error of every vector, with the error of its label and a digest of the codebooks."""
    coded, books = compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = coded.select("row.vec_id", "row.label", "code", "error").alias("r")
    per_label = staged(coded.groupBy(F.col("row.label").alias("label")).agg(F.sum("error").alias("label_error")), "label-errors").alias("l")
    return rows.join(per_label, F.col("r.label").eqNullSafe(F.col("l.label"))).select(
        "r.vec_id", "r.code", "r.error", "l.label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
