"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.base import query, table
from gridsmith.llm.kernels import STATISTICS, statistics
from gridsmith.session import staged

SAMPLE = 200_000  # most labelled rows that a model is fitted on
FEATURES = 256
RIDGE = 1.0
BINS = 400
TASKS = 32
ACCEPT = 0.3


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines of random projections: their products approximate a Gaussian kernel."""
        scaled = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(scaled @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values``: neighbours that fall are pooled."""
    pools: list[list[float]] = []  # mean, weight, length
    for value, weight in zip(values, weights, strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            mean, heavy, length = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[1] + mean * heavy) / (last[1] + heavy)
            last[1] += heavy
            last[2] += length
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` of whole texts, staged: the texts are read once."""
    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return staged(docs.select("doc_id", measure("text").alias("stats")), "statistics")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def summed(rows: DataFrame, part) -> list[np.ndarray]:
    """Sum over all rows of ``part(stats, y)``, a list of arrays; each task sends one sum."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                new = part(matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
                total = new if total is None else [a + b for a, b in zip(total, new, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[a.tobytes() for a in total]], pa.list_(pa.binary()))], ["sums"])

    parts = sorted(r[0] for r in rows.select("stats", "y").coalesce(TASKS).mapInArrow(add, "sums array<binary>").collect())
    arrays = [[np.frombuffer(a) for a in p] for p in parts]
    return [np.sum(a, axis=0) for a in zip(*arrays, strict=True)]


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, ridge: float = RIDGE,
          seed: int = 1) -> QualityModel:
    """A model of ``doc_id, stats`` and ``doc_id, quality`` (0 or 1; several labels of a document are averaged).

    At most about ``sample`` rows are used, chosen by a seeded hash of the id. Sums, never rows,
    come to the driver: means, then the normal equations, then counts per bin of raw scores.
    Without any label the score is 0.5 throughout.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    n = known.count()
    kept = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < (1 << 30) * min(1.0, sample / max(n, 1)))
    rows = staged(stats.join(kept, "doc_id").select("stats", "y"), "labelled")
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, features))
    phases = rng.uniform(0, 2 * np.pi, features)
    sums = summed(rows, lambda x, y: [np.array([float(len(x))]), x.sum(axis=0), (x * x).sum(axis=0)])
    if not sums:
        return QualityModel(np.zeros(STATISTICS), np.ones(STATISTICS), directions, phases)
    count, mean = sums[0][0], sums[1] / sums[0][0]
    model = QualityModel(mean, np.sqrt(np.maximum(sums[2] / count - mean * mean, 1e-9)) + 1e-6, directions, phases)

    def equations(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = model.features(x)
        return [(z.T @ z).ravel(), z.T @ y]

    gram, right = summed(rows, equations)
    penalty = ridge * np.eye(features + 1)
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(gram.reshape(features + 1, features + 1) + penalty, right)

    def bins(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        raw = np.clip(model.raw(x), -0.5, 1.5)
        place = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)
        return [np.bincount(place, minlength=BINS).astype(float), np.bincount(place, raw, BINS), np.bincount(place, y, BINS)]

    counts, raws, hits = summed(rows, bins)
    full = counts > 0
    model.knots = raws[full] / counts[full]
    model.levels = isotonic(hits[full] / counts[full], counts[full])
    return model


def score_text(text: Column, model: QualityModel) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        stats = np.array([statistics(t.as_py()) for t in texts]).reshape(-1, STATISTICS)
        return pa.array(model.score(stats), pa.float64())

    return score(text)


def score_statistics(stats: Column, model: QualityModel) -> Column:
    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(matrix(rows)), pa.float64())

    return score(stats)


def accepted(docs: DataFrame, labels: DataFrame, at_least: float = ACCEPT, **options) -> DataFrame:
    """``docs`` without the documents whose score is below ``at_least``, in the order of columns given.

    NULL and empty texts have statistics of 0 and a score like any other; rows are scored on their
    own, so repeated rows and ids have no effect on each other. Extra columns pass through.
    """
    model = train(with_statistics(docs), labels, **options)
    return docs.where(score_text(F.col("text"), model) >= at_least)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@query("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    """Quality of every document, learned from the labels that are not held out."""
    stats = with_statistics(table(spark, sf_dir, "documents"))
    model = train(stats, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                          score_statistics(F.col("stats"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
