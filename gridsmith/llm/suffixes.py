"""Array work of the suffix operator: anchors of a text, and the merge of aligned Burrows-Wheeler columns."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 20  # bytes of a text that are hashed at once
TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if size not in TABLES:
        steps = (np.full(size, np.uint64(b)) for b in (BASE, pow(BASE, -1, 1 << 64)))
        TABLES[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], s[1:]]), dtype=np.uint64) for s in steps)
    return TABLES[size]


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Place, first and last window start, gram hash and segment hash of every anchor.

    The anchor of a window of ``length`` bytes is its gram of least hash, the leftmost if several.
    Equal windows have their anchors at equal offsets. Neighbouring windows with one anchor form a
    run; its segment reaches from the first byte of the first window to the last of the last.
    """
    parts = [anchors_of_piece(raw[s:s + PIECE + length - 1], s, length, gram)
             for s in range(0, max(len(raw) - length + 1, 0), PIECE)]
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def anchors_of_piece(raw: bytes, offset: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    span = length - gram + 1
    power, inverse = powers(PIECE + length)
    data = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data * power[:n], out=sums[1:])
    grams = stirred((sums[gram:] - sums[:-gram]) * inverse[:n - gram + 1])
    # High half of the hash, then the place: the least is the leftmost gram of least hash.
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(keys) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[span - 1:span - 1 + windows])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [windows]]) - 1
    at = place[first]
    segments = stirred((sums[last + length] - sums[first]) * inverse[first])
    return (at + offset, first + offset, last + offset, grams[at].view(np.int64), segments.view(np.int64))


def merge_columns(segments: list[bytes], group: np.ndarray, before: np.ndarray, after: np.ndarray,
                  copies: np.ndarray, length: int) -> np.ndarray:
    """Rows x starts: whether the window that starts there is repeated in the row's group.

    Segments of a group are aligned at their anchor, ``before`` bytes from the first window start and
    ``after`` from the last; a window at one place of the alignment can only equal windows at the
    same place. The transforms of all segments are merged by interleave refinement: the interleave
    starts as the concatenation of the segments in shard order and each round, from the last
    column to the first, prepends one symbol, by a stable partition of every group by that column
    of the transform. The common prefix of two neighbours is one more than the least between them
    before, or 0 if their symbols differ. Stretches with common prefixes of ``length`` are the
    repeated intervals. No suffix is sorted again.
    """
    rows = len(segments)
    deepest = int(before.max())
    width = deepest + max(len(s) - int(b) for s, b in zip(segments, before, strict=True))
    table = np.zeros((rows, width), np.uint8)
    for i, segment in enumerate(segments):
        start = deepest - int(before[i])
        table[i, start:start + len(segment)] = np.frombuffer(segment, np.uint8)
    columns = np.ascontiguousarray(table.T)
    order = np.argsort(group, kind="stable")
    bound = np.unique(group, return_inverse=True)[1].astype(np.int64)[order] << 8
    # common[i]: prefix that the i-th and the row before it share; -1 between groups.
    common = np.zeros(rows + 1, np.int64)
    common[0] = -1
    common[1:rows][bound[1:] != bound[:-1]] = -1
    apart = common[:rows] < 0
    out = np.zeros((rows, deepest + 1), bool)
    for x in range(width - 1, -1, -1):
        keys = bound + columns[x, order]
        if (keys[1:] < keys[:-1]).any():
            move = np.argsort(keys, kind="stable")
            order, keys = order[move], keys[move]
        else:
            move = np.arange(rows)
        met = np.zeros(rows, bool)
        met[1:] = keys[1:] == keys[:-1]
        new = np.zeros(rows + 1, np.int64)
        here = np.flatnonzero(met)
        if len(here):
            left, right = move[here - 1] + 1, move[here]
            least = common[right]
            far = np.flatnonzero(left < right)
            if len(far):
                pairs = np.stack([left[far], right[far] + 1], axis=1).ravel()
                least[far] = np.minimum.reduceat(common, pairs)[::2]
            new[here] = least + 1
        new[:rows][apart] = -1
        common = new
        if x <= deepest:
            block = np.cumsum(common[:rows] < length) - 1
            valid = (deepest - before[order] <= x) & (x <= deepest - after[order])
            held = np.bincount(block[valid], copies[order][valid], minlength=block[-1] + 1)
            out[order[valid], x] = held[block[valid]] >= 2
    return out
