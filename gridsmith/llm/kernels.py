"""Small array functions that run inside tasks."""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from operator import eq

import numpy as np
import regex
import xxhash


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII whitespace, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words joined by a space; of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """The word whose bits are set in over half of the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        part = np.ascontiguousarray(hashes[i:i + block], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


CACHE: dict[str, np.ndarray] = {}
SCRIPT_PLANES = 0x30000  # beyond them no letters are assigned for living scripts


def letter_flags() -> np.ndarray:
    if "letters" not in CACHE:
        CACHE["letters"] = np.array([chr(i).isalpha() for i in range(SCRIPT_PLANES)] + [False])
    return CACHE["letters"]


def spectrum(text: str, longest: int, dim_bits: int) -> np.ndarray:
    """The set of hashed character n-grams, n from 1 to ``longest``: sorted hashes of ``dim_bits`` bits.

    Letters count in lower case; everything between them is one blank.
    """
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(letter_flags()[np.minimum(codes, SCRIPT_PLANES)], codes, 32)
    blank = codes == 32
    codes = codes[~(blank & np.roll(blank, 1)) | (np.arange(len(codes)) == 0)].astype(np.uint64)
    found = []
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, longest + 1):
        if len(codes) < n:
            break
        rolled = rolled[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:]
        mixed = (rolled ^ (rolled >> np.uint64(29)) ^ np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
        found.append(np.unique(mixed >> np.uint64(64 - dim_bits)))
    return np.unique(np.concatenate(found))


def places_in(held: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places in the sorted ``held`` of those ``grams`` that it has."""
    if not len(held):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(held, grams), len(held) - 1)
    return at[held[at] == grams]


STATISTICS = 20


def statistics(text: str | None) -> np.ndarray:
    """Shares, lengths and repetitions of a whole text; all 0 for an empty one."""
    out = np.zeros(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return out
    n, n_words = len(raw), len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    other = counts[128:].sum()
    blanks = counts[32] + counts[9:14].sum()
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    often = Counter(words)
    lines = raw.split(b"\n")
    share = counts[counts > 0] / n
    ends = counts[ord(".")] + counts[ord("?")] + counts[ord("!")]
    out[:] = (
        np.log1p(n), np.log1p(n_words), np.sqrt(upper / n), (lower + other) / n, np.sqrt(digits / n), blanks / n,
        np.sqrt(counts[ord(".")] / n), np.sqrt(counts[ord(",")] / n), np.sqrt(counts[ord("!")] / n),
        np.sqrt((n - upper - lower - digits - other - blanks - counts[ord(".")] - counts[ord(",")] - counts[ord("!")]) / n),
        np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(lengths.max()),
        len(often) / n_words, np.log(len(often)) / np.log(n_words + 1), max(often.values()) / n_words,
        sum(map(eq, words, words[1:])) / n_words, np.log1p(ends / n_words * 10),
        1 - len(set(lines)) / len(lines), -(share * np.log2(share)).sum())
    return out


def weighted_simhash(text: str | None, block: int = 1 << 15) -> int:
    """Signed-bit votes of the words and neighbouring pairs of a text, as a signed 64-bit number.

    A term votes with ``1 + ln(count)``, a pair, which says more, with twice that.
    """
    words = words_of(text)
    if not words:
        return 0
    single = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    pair = (single[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ ((single[1:] << np.uint64(31)) | (single[1:] >> np.uint64(33)))
    pair = (pair ^ (pair >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    pair ^= pair >> np.uint64(32)
    votes = np.zeros(64)
    for terms, weight in ((single, 1.0), (pair, 2.0)):
        distinct, counts = np.unique(terms, return_counts=True)
        strength = (weight * (1 + np.log(counts))).astype(np.float32)
        for i in range(0, len(distinct), block):
            part = np.ascontiguousarray(distinct[i:i + block], "<u8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32)
            some = strength[i:i + block]
            votes += 2.0 * (some @ bits) - some.sum()
    return int(np.packbits(votes > 0, bitorder="little").view("<i8")[0])


def token_spans(text: str) -> tuple[list[str], list[int], list[int]]:
    """Runs of letters and digits in lower case, and where each starts and ends."""
    found = [(m.group().lower(), m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", text)]
    return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]


def banded_alignment(template: list[str], tokens: list[str], low: list[int], high: list[int]) -> tuple[int, int, int]:
    """Most template tokens that match in order inside a band; the first and last place matched.

    Template token i may only meet text tokens from ``low[i]`` to ``high[i]``, neither of which
    falls; either side may skip tokens. Of equal alignments the shortest span counts, then the first.
    """
    unit = len(tokens) + 1  # a cell is matches * unit + first place: more matches, then a later start
    best = (0, 0, 0, -1)  # matches, minus the length, minus the first place, last place
    row: list[int] = []
    start = 0
    for word, lo, hi in zip(template, low, high, strict=True):
        lo, hi = max(lo, 0), min(hi, len(tokens) - 1)
        if lo > hi:
            continue
        new, left, end = [], 0, start + len(row) - 1

        def above(j: int) -> int:
            return row[min(j, end) - start] if row and j >= start else 0

        for j in range(lo, hi + 1):
            left = max(left, above(j))
            if tokens[j] == word:
                before = above(j - 1)
                cell = before + unit if before else unit + j
                n, first = divmod(cell, unit)
                best = max(best, (n, first - j, -first, j))
                left = max(left, cell)
            new.append(left)
        row, start = new, lo
    n, _, first, last = best
    return (n, -first, last) if n else (0, -1, -1)


def gram_chains(hits: list[tuple[int, int]], band: int) -> list[list[tuple[int, int]]]:
    """``(place in the text, place in the template)`` of shared grams as chains that rise in both.

    Neighbours of a chain lie on diagonals at most ``band`` apart, so words that a copy has more or
    fewer add up along the chain without leaving it. Longest chains first; each hit is in one.
    """
    hits = sorted(set(hits))
    on: dict[int, list[int]] = {}
    size, link = [1] * len(hits), [-1] * len(hits)
    for k, (place, at) in enumerate(hits):
        here, best = place - at, (0, 0, -1)
        for diagonal in range(here - band, here + band + 1):
            for i in reversed(on.get(diagonal, ())):
                if hits[i][0] < place and hits[i][1] < at:
                    best = max(best, (size[i], -abs(diagonal - here), i))
                    break
        size[k], link[k] = best[0] + 1, best[2]
        on.setdefault(here, []).append(k)
    out, used = [], [False] * len(hits)
    for k in sorted(range(len(hits)), key=lambda k: (-size[k], k)):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(hits[k])
            k = link[k]
        if chain:
            out.append(chain[::-1])
    return sorted(out, key=lambda c: (-len(c), c))


def chain_band(chain: list[tuple[int, int]], length: int, band: int) -> tuple[list[int], list[int]]:
    """The text places that each of ``length`` template tokens may meet: those of the chain, ``band`` to either side."""
    low, high, k = [], [], 0
    for i in range(length):
        while k < len(chain) and chain[k][1] <= i:
            k += 1
        near = [place - at for place, at in chain[max(k - 1, 0):k + 1]]
        low.append(i + min(near) - band)
        high.append(i + max(near) + band)
    for i in range(length - 2, -1, -1):
        low[i] = min(low[i], low[i + 1])
    for i in range(1, length):
        high[i] = max(high[i], high[i - 1])
    return low, high
