"""Language of a text: string kernels, Nystroem landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is the number of character n-grams of length 1 to 4 that both hold
(blended spectrum, presence), divided by the root of the product of their own numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm.base import query, table
from gridsmith.llm.kernels import places_in, spectrum
from gridsmith.session import staged

LONGEST = 4
DIM_BITS = 64  # hashes, not places: no text is long enough to fill them
SAMPLE = 2400  # most training texts, in equal parts of the languages
LANDMARKS = 160
RIDGE = 0.3
UNKNOWN = "und"
BATCH = 128  # texts that are scored by one product
BLOCK = 8192  # n-grams of a block of columns


@dataclass
class LanguageModel:
    names: list[str]
    held: np.ndarray  # hashes of the landmarks' n-grams, sorted
    weights: np.ndarray  # n-grams of the landmarks x languages
    bias: np.ndarray
    longest: int
    dim_bits: int

    def scores(self, texts: list[str]) -> np.ndarray:
        """Texts x languages; 1 for a sure yes, -1 for a sure no.

        A batch of texts is one matrix of 0 and 1, texts x n-grams, whose column blocks are multiplied
        with the weights. Only blocks that some text of the batch meets are laid out, ``BATCH`` x ``BLOCK``
        cells at a time; results are rounded, so that they do not depend on who shares a batch.
        """
        out = np.empty((len(texts), len(self.names)))
        for start in range(0, len(texts), BATCH):
            found, sizes = [], []
            for text in texts[start:start + BATCH]:
                grams = spectrum(text, self.longest, self.dim_bits)
                found.append(places_in(self.held, grams))
                sizes.append(max(len(grams), 1))
            texts_of = np.repeat(np.arange(len(found)), [len(f) for f in found])
            places = np.concatenate(found)
            order = np.argsort(places, kind="stable")
            texts_of, places = texts_of[order], places[order]
            total = np.zeros((len(found), len(self.names)))
            for block in np.unique(places // BLOCK):
                lo, hi = np.searchsorted(places, [block * BLOCK, (block + 1) * BLOCK])
                weights = self.weights[block * BLOCK:(block + 1) * BLOCK]
                presence = np.zeros((len(found), len(weights)))
                presence[texts_of[lo:hi], places[lo:hi] - block * BLOCK] = 1
                total += presence @ weights.astype(np.float64)
            out[start:start + BATCH] = total / np.sqrt(sizes)[:, None] + self.bias
        return out.round(9)


def fit_model(labels: list[str], grams: list[np.ndarray], landmarks: int = LANDMARKS, ridge: float = RIDGE,
              longest: int = LONGEST, dim_bits: int = DIM_BITS) -> LanguageModel:
    """Kernel ridge regression on the landmarks' span; ``grams`` are the spectra of the sample in a fixed order."""
    names = sorted(set(labels))
    by_name = {name: [i for i, x in enumerate(labels) if x == name] for name in names}
    each = max(1, landmarks // max(1, len(names)))
    marks = [i for name in names for i in by_name[name][:each]]
    held = np.unique(np.concatenate([grams[i] for i in marks])) if marks else np.empty(0, np.uint64)
    norms = np.sqrt([max(len(g), 1) for g in grams])
    # The landmarks of each n-gram, so that a text meets only those that share one with it.
    columns = [places_in(held, grams[i]) for i in marks]
    holders = np.repeat(np.arange(len(marks)), [len(c) for c in columns])
    flat = np.concatenate(columns) if columns else np.empty(0, np.int64)
    holders = holders[np.argsort(flat, kind="stable")]
    ends = np.cumsum(np.bincount(flat, minlength=len(held)))
    kernel = np.zeros((len(grams), len(marks)))
    for i, text in enumerate(grams):
        at = places_in(held, text)
        counts = ends[at] - np.where(at > 0, ends[at - 1], 0)
        first = np.repeat(ends[at] - np.cumsum(counts), counts)
        kernel[i] = np.bincount(holders[first + np.arange(len(first))], minlength=len(marks)) / norms[marks] / norms[i]
    # Nystroem features: the landmarks' kernel to the power of -1/2.
    values, vectors = np.linalg.eigh(kernel[marks])
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = np.hstack([kernel @ root, np.ones((len(grams), 1))])
    target = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    penalty = ridge * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-6
    solved = np.linalg.solve(features.T @ features + penalty, features.T @ target)
    strength = (root @ solved[:-1]) / norms[marks][:, None]
    weights = np.zeros((len(held), len(names)))
    for at, row in zip(columns, strength, strict=True):
        weights[at] += row
    return LanguageModel(names, held, weights.astype(np.float32), solved[-1], longest, dim_bits)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE,
          longest: int = LONGEST, dim_bits: int = DIM_BITS, seed: str = "language-1") -> LanguageModel | None:
    """A model of ``text, lang`` rows, or None if no row has both a letter and a language.

    At most ``sample`` distinct texts are used, 900 of a language at most: of each language those
    with the least seeded hash, whichever task holds them; copies count once, so a much copied text
    takes one place. Their spectra, not their texts, come to the driver.
    """
    rows = labelled.where(has_letter(F.col("text")) & F.col("lang").isNotNull()).select(
        "lang", "text", F.xxhash64(F.lit(seed), "text").alias("h"))
    hashes = staged(rows.select("lang", "h").distinct(), "hashes")
    classes = hashes.select("lang").distinct().count()
    if not classes:
        return None
    # Each task ranks and keeps its own least rows before the shuffle.
    order = Window.partitionBy("lang").orderBy("h")
    least = (hashes.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(1, min(900, sample // classes)))
             .groupBy("lang").agg(F.max("h").alias("most")))
    chosen = rows.join(staged(least, "cutoffs"), "lang").where("h <= most").dropDuplicates(["lang", "h"])

    @F.arrow_udf("binary")
    def spectra(texts: pa.Array) -> pa.Array:
        return pa.array([spectrum(t.as_py(), longest, dim_bits).tobytes() for t in texts], pa.binary())

    picked = chosen.select("lang", "h", spectra("text").alias("grams")).toPandas().sort_values(["lang", "h"])
    return fit_model(list(picked["lang"]), [np.frombuffer(g, np.uint64) for g in picked["grams"]],
                     landmarks, ridge, longest, dim_bits)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the whole text alone.

    A NULL text, one without a letter, and every text under an absent model are ``und`` with score 0.
    Rows are judged on their own; other columns pass through, but for those that the result names.
    """
    @F.arrow_udf("lang_pred string, score double")
    def guess(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        known = [i for i, t in enumerate(values) if t is not None]
        names, scores = [UNKNOWN] * len(values), [0.0] * len(values)
        if known and model is not None:
            found = model.scores([values[i] for i in known])
            best = found.argmax(axis=1)
            for i, k, row in zip(known, best, found, strict=True):
                names[i], scores[i] = model.names[k], float(min(1.0, max(0.0, (row[k] + 1) / 2)))
        return pa.StructArray.from_arrays([pa.array(names), pa.array(scores)], ["lang_pred", "score"])

    readable = F.when(has_letter(F.col(text)), F.col(text))
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*rest).alias("doc"), guess(readable).alias("guess"))
    return rows.select("doc.*", "guess.*")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    """Language of every document, learned from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    model = train(docs.where("NOT held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")
