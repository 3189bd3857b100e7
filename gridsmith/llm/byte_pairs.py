"""Byte-pair encoding by folds of ranked merges over the distinct words of a batch, and decoding by joining pieces."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import PATTERN, path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm.base import query, table
from gridsmith.session import staged

TEXTS = 256  # texts of a batch that are put together at a time
AT_ONCE = 1 << 18  # distinct words of a batch that are folded together
NO_RANK = np.iinfo(np.int32).max


class Ranks:
    """Ids of single bytes, and the merged ids of pairs of ids in sorted order of the pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.singles = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = np.array(sorted(pairs), np.int64)
        # One more place, where pairs beyond the last are looked up.
        self.ids = np.array([pairs[p] for p in self.pairs.tolist()] + [NO_RANK], np.int32)
        self.pairs = np.append(self.pairs, np.iinfo(np.int64).max)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids that neighbouring ids merge to, NO_RANK if none."""
        keys = left << 32 | right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.ids[at], NO_RANK)

    def folded(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has. ``data`` holds the bytes of words that end before ``ends``.

        In each round every word merges its pairs of the least rank, from the left, until none has a
        rank; a word that is done leaves. No merge makes a pair of a lower rank: a piece's own merges
        all rank below it, so they are done.
        """
        ids, word = self.singles[data], np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        ranks = np.full(len(ids), NO_RANK, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        ranks[inner] = self.merged(ids[inner], ids[inner + 1])
        done = []
        while len(ids):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(starts, append=len(ids))
            least = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            left = least != NO_RANK
            done.append((word[~left], ids[~left]))
            ids, word, ranks, least = ids[left], word[left], ranks[left], least[left]
            place = np.arange(len(ids))
            hit = ranks == least
            # Of pairs that overlap, every second one merges, counted from the first.
            opens = hit & ~np.concatenate([[False], hit[:-1]])
            hit &= (place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0
            kept = np.concatenate([[True], ~hit[:-1]])[:len(ids)]
            ids = np.where(hit, least, ids)[kept]
            word, ranks, new = word[kept], ranks[kept], np.flatnonzero(hit[kept])
            # Only pairs with a merged id change.
            stale = np.union1d(new, new[new > 0] - 1)
            ranks[stale] = NO_RANK
            stale = stale[stale + 1 < len(ids)]
            stale = stale[word[stale] == word[stale + 1]]
            ranks[stale] = self.merged(ids[stale], ids[stale + 1])
        word, ids = (np.concatenate([d[i] for d in done] or [np.zeros(0, np.int64)]) for i in (0, 1))
        return ids[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(ends))


@dataclass
class Tokenizer:
    """The pattern of words, the ranks, and one staged row: the pieces of ids in hex."""

    pattern: str
    ranks: Ranks
    tables: DataFrame


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read_ranks(where: str) -> dict[bytes, int]:
    with open(where, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, lines))}


def tokenizer(spark: SparkSession, where: str, pattern: str = PATTERN) -> Tokenizer:
    """A tokenizer of a file of ranks, read by the driver. Its size is that of the vocabulary, not of the texts."""
    ranks = read_ranks(where)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks must hold all single bytes")
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    tables = staged(spark.createDataFrame(pa.table({"pieces": pa.array([pieces], pa.list_(pa.string()))})), "vocabulary")
    # (?U): blanks are those of Unicode.
    return Tokenizer("(?U)" + pattern, Ranks(ranks), tables)


def held(tables: DataFrame, names: tuple[str, ...]) -> Column:
    """A struct of values of a one-row table, which Spark reads once and gives to all tasks.

    To be selected as a column that the next step uses in one place: the optimizer puts it there,
    and no row carries it.
    """
    return F.struct(*[tables.select(c).scalar().alias(c) for c in names])


def word_array(text: Column, t: Tokenizer) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(t.pattern), F.lit(0))


def word_ids(words: Column, t: Tokenizer, most: int) -> Column:
    """The ids of arrays of words, one after the other. The distinct words of a batch are folded once, ``most`` at a time."""
    ranks = t.ranks

    # Local, so that it travels to the executors by value.
    @F.arrow_udf("array<int>")
    def ids(words: pa.Array) -> pa.Array:
        coded = words.flatten().dictionary_encode()
        found, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for start in range(0, len(coded.dictionary), most):
            some = pa.concat_arrays([coded.dictionary[start:start + most]]).cast(pa.large_binary())
            ends = np.frombuffer(some.buffers()[1], np.int64)[some.offset:some.offset + len(some) + 1]
            data = np.frombuffer(some.buffers()[2], np.uint8)[ends[0]:ends[-1]]
            for whole, out in zip(ranks.folded(data, ends[1:] - ends[0]), (found, sizes)):
                out.append(whole)
        of_word, size = np.concatenate(found), np.concatenate(sizes)
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))])
        # A few texts at a time, as places take more memory than ids.
        texts, n_ids = [], [np.zeros(1, np.int64)]
        for start in range(0, len(words), TEXTS):
            edges = cuts[start:start + TEXTS + 1]
            mine = at[edges[0]:edges[-1]]
            n = np.concatenate([[0], np.cumsum(size[mine])])
            texts.append(of_word[np.repeat(first[mine] - n[:-1], size[mine]) + np.arange(n[-1])])
            n_ids.append(n_ids[-1][-1] + n[edges[1:] - edges[0]])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(n_ids).astype(np.int32)), pa.array(np.concatenate([found[0], *texts])))

    return ids(words)


def encoded(docs: DataFrame, t: Tokenizer, most: int = AT_ONCE) -> DataFrame:
    """``doc`` (all columns) and ``ids`` of whole texts."""
    return docs.select(F.struct("*").alias("doc"), word_ids(word_array(F.col("text"), t), t, most).alias("ids"))


def decoded(rows: DataFrame, t: Tokenizer) -> DataFrame:
    """``rows`` with ``bytes``: the pieces of ``ids``, one after the other."""
    return rows.select("*", held(t.tables, ("pieces",)).alias("_held")).select(*rows.columns, let(
        F.col("_held")["pieces"], lambda pieces: F.unhex(F.array_join(F.transform("ids", lambda i: F.get(pieces, i)), ""))).alias("bytes"))


def tokenized(docs: DataFrame, where: str | None = None, **options) -> tuple[DataFrame, Tokenizer]:
    """``docs`` as a struct ``doc`` with the ``ids`` of its whole text, and the tokenizer that decodes them.

    NULL and empty texts have no ids. Rows are encoded on their own: repeated rows and ids change
    nothing. An empty table gives an empty result; columns of any name
    pass through in ``doc``.
    """
    t = tokenizer(docs.sparkSession, where or path("byte_bpe_50k.tiktoken"))
    return encoded(docs, t, **options), t


@query("op12_byte_bpe")
def op12_byte_bpe(spark, sf_dir):
    """Tokens of every document, with digests of their ids and of the bytes that these decode to."""
    return decoded(*tokenized(table(spark, sf_dir, "documents").select("doc_id", "text"))).select(
        "doc.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
