"""Vector codes, byte-pair encoding and importance resampling against plain versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gridsmith.llm import byte_pairs as BP
from gridsmith.llm import resampling as RS
from gridsmith.llm import vector_codes as VC
from gridsmith.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# -- 11

@pytest.mark.parametrize("entries, size, spread", [(1, 3, 5), (2, 1, 2), (40, 4, 3), (256, 16, 400), (17, 16, 1)])
def test_orchard_finds_the_nearest_with_ties_to_the_lower_index(entries, size, spread):
    rng = np.random.default_rng(entries)
    book = rng.integers(-spread, spread + 1, (entries, size))
    points = np.concatenate([rng.integers(-spread, spread + 1, (700, size)), book, np.zeros((1, size), np.int64)])
    apart = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
    at, best = VC.Neighbours(book).nearest(points)
    assert (at == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def plain_codes(rows, entries, rounds, parts):
    kept = sorted([(k, [max(min(math.floor(1024 * x), 1 << 27), -(1 << 27)) for x in v]) for k, v in rows
                   if v and all(x is not None and math.isfinite(x) for x in v)], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    matrix = np.array([v for _, v in kept], np.int64)
    cuts = np.array_split(np.arange(matrix.shape[1]), parts)
    books = [matrix[:entries][:, c].copy() for c in cuts]
    for k in range(rounds + 1):
        apart = [((matrix[:, c][:, None, :] - b[None]) ** 2).sum(axis=2) for c, b in zip(cuts, books)]
        at = [a.argmin(axis=1) for a in apart]
        for a, c, b in zip(at, cuts, books):
            for e in set(a) if k < rounds else ():
                b[e] = matrix[a == e][:, c].sum(axis=0) // (a == e).sum()
    return sorted((str(k), bytes(int(a[i]) for a in at).hex(), int(sum(a[i].min() for a in apart))) for i, (k, _) in enumerate(kept)), books


def test_codes_as_by_hand(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.25, -0.25, rng.gauss(0, 1)]) for _ in range(10)]) for i in range(300)]
    rows += [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 10), (404, [float("inf")] * 10), (405, [1.0, 2.0]),
             (406, [1e30] * 10), (7, rows[7][1]), (7, [0.5] * 10), (None, [0.125] * 10)]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, code int, error string")
    as_float = [(k, v and [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    for parts in (4, 1):
        out, books = VC.compressed(df, parts=parts, entries=16)
        expected, by_hand = plain_codes(as_float, 16, 4, parts)
        assert sorted((str(r.row.vec_id), r.code, r.error) for r in out.collect()) == expected
        assert all((a == b).all() for a, b in zip(books, by_hand)) and out.columns == ["row", "code", "error"]
    out, books = VC.compressed(df.limit(0))
    assert out.count() == 0 and not books and VC.books_digest(books) == hashlib.sha256(b"").hexdigest()


def test_codes_query_on_empty_and_unfit_tables(spark, tmp_path):
    spark.createDataFrame([(1, None, 3), (2, [None], None)], "vec_id long, embedding array<float>, label int").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    assert QUERIES["op11_vector_codes"](spark, str(tmp_path)).count() == 0


# -- 12

@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digits(text, encoding):
    ids = encoding.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def test_ids_as_the_library_has_them(spark, encoding):
    rng = random.Random(8)
    alphabet = "aabcdehinorst  \n\t'’.,0123éüßñ中文漢字کتاب🙂  ́\u0000=-_#ẞ"
    texts = ["".join(rng.choices(alphabet, k=rng.choice([1, 3, 20, 200]))) for _ in range(300)]
    texts += [None, "", " ", "\n\n\n", "don't we'll I'M", "x" * 5000, " " * 3000 + "end", "=" * 777, "<|endoftext|>",
              "".join(rng.choices("etaoinshr", k=700)), "alpha beta gamma " * 8000, "中" * 400, "  ᠎ ​ 　 \x1c \x85 "]
    texts += ["same words " * 3] * 4
    df = spark.createDataFrame([(i if i % 9 else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, ids int, held int")
    for most in (1 << 18, 3):
        rows, t = BP.tokenized(df, most=most)
        out = BP.decoded(rows, t).collect()
        expected = [(t, encoding.encode_ordinary(t or "")) for t in texts]
        assert sorted(((r.doc.text, list(r.ids)) for r in out), key=str) == sorted(expected, key=str)
        assert all(bytes(r.bytes) == (r.doc.text or "").encode() for r in out)
    rows, _ = BP.tokenized(df.limit(0))
    assert rows.count() == 0 and rows.columns == ["doc", "ids"]


def test_words_are_folded_side_by_side(encoding):
    """All words in one call, long ones and runs of one letter among them."""
    rng = random.Random(9)
    words = ["".join(rng.choices("aabcdehinorst '’0é中🙂", k=rng.choice([1, 2, 5, 12]))) for _ in range(20_000)]
    words += ["", "x" * 5000, "a" * 7, "=" * 777, "".join(rng.choices("etaoinshr", k=3000))]
    data = [w.encode() for w in words]
    ids, sizes = BP.Ranks(encoding._mergeable_ranks).folded(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(b) for b in data]))
    own = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=encoding._mergeable_ranks, special_tokens={})
    assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [own.encode_ordinary(w) for w in words]


def test_every_piece_is_reached_by_its_own_merges(encoding):
    """What lets all pairs of the least rank merge at once."""
    ranks = BP.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for piece, rank in ranks.items():
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            pairs = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            at = pairs.index(min(pairs))
            assert pairs[at] < rank
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        assert b"".join(parts) == piece


def test_tokens_query(spark, encoding):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op12_byte_bpe"](spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out} == {d: digits(t, encoding) for d, t in rows.items()}


# -- 13

def plain_resample(docs, target, least_words=20, share=25):
    def features(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [" ".join(p) for p in zip(words, words[1:])]]

    found = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, ((d, _), (words, f)) in enumerate(zip(docs, found)):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least_words, i))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    rank = {r[5]: k + 1 for k, r in enumerate(able[:len(able) * share // 100])}
    return [(*r[:4], rank.get(r[5])) for r in rows]


def test_resampling_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = [tuple(r) for r in QUERIES["op13_importance_resampling"](spark, SF).collect()]
    assert sorted(out) == sorted(plain_resample(docs, target), key=lambda r: r[0]) and sum(r[4] is not None for r in out) > 20


def test_resampling_awkward(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices(["Ab", "cd", "éa", "x1", "中文", "zz"], k=n))
    same = text(30)
    docs = [(i, text(rng.choice([3, 19, 20, 25, 60]))) for i in range(60)] + [(7, same)] * 9 + [(None, same)] * 5
    docs += [(100, None), (101, ""), (102, " ,.- "), (103, "long words " * 30_000), (-5, same), (104, "ONE")]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, gains int")
    target = ["ab cd", None, "", "x1 x1 zz"]
    items = spark.createDataFrame([(t, 3) for t in target], "text string, w int")
    for share in (0, 3, 25, 50, 100):
        got = sorted(map(tuple, RS.resampled(df, items, share=(share, 100)).collect()), key=str)
        assert got == sorted(plain_resample(docs, target, share=share), key=str)
    assert RS.resampled(df.limit(0), items).count() == 0
    assert sorted(map(tuple, RS.resampled(df, items.limit(0)).collect()), key=str) == sorted(plain_resample(docs, []), key=str)


def test_cutoff_counts_exactly(spark):
    rng = random.Random(6)
    values = [rng.choice([-3, -3, 0, 5, rng.randrange(-10**6, 10**6)]) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for need in (1, 2, 250, 499, 500):
        at, below = RS.cutoff(rows, "v", need)
        assert at == sorted(values)[need - 1] and below == sum(v < at for v in values)
