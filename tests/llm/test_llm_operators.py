"""Operators against plain Python on small and awkward inputs."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import pytest
import xxhash

from gridsmith.llm import decontamination as DC
from gridsmith.llm import fingerprints as FP
from gridsmith.llm import language_id as LI
from gridsmith.llm import licenses as LS
from gridsmith.llm import line_dedup as LD
from gridsmith.llm import mixing as MX
from gridsmith.llm import near_dedup as ND
from gridsmith.llm import quality as QC
from gridsmith.llm import suffix_dedup as SD
from gridsmith.llm import warc as WA
from gridsmith.llm.base import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("size target taken whole cutoff copy fp component_id key place h n stats score held_out lang_pred "
           "template coverage pos line k1 site item_id edited kept raw t e draw gone rest "
           "_doc _gone _twice mix_copy doc one held g r f").split()
LONG = "alpha beta gamma delta epsilon zeta " * 20_000


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [(1, "One plain text of a few words here.\nSecond line.", "en", "a", 48), (2, None, "en", "b", None), (3, "", "de", None, 0),
            (None, "no id but words are there", None, "a", 3), (5, LONG, "en", "a", len(LONG)), (6, " \n\t ", "fr", "c", 4),
            (7, "same row", "en", "a", 8), (7, "same row", "en", "a", 8), (8, "12345 !!! ###", "en", "b", 13),
            (9, "twin text of nine and ten", "de", "b", 25), (10, "twin text of nine and ten", "de", "c", 25), (None, None, None, None, None)]
    df = docs_of(spark, rows)
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def empty(spark):
    return docs_of(spark, [])


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- 1

def item_words(text):
    import regex
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def runs(words, n):
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute_contained(docs, items):
    out = []
    for i, text in items:
        w = item_words(text)
        if not w:
            continue
        n = min(5, len(w))
        want = runs(w, n)
        for d, t in docs:
            have = len(want & runs(item_words(t), n))
            if have * 5 >= 4 * len(want) and have:
                out.append((d, i, len(want), have))
    return sorted(out, key=str)


def test_contained_items_as_by_hand(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 12, 40, 90])))) for i in range(40)] + [(90, ""), (91, None)]
    docs = []
    for d in range(120):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 300)))]
        for _, text in rng.sample(items[:40], 3):
            words = text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):  # some stay over, some fall under the threshold
                words[rng.randrange(len(words))] = "x"
            parts.insert(rng.randrange(len(parts) + 1), ", ".join(words).title())
        docs.append((d, "\n".join(parts), None, None, None))
    found = DC.contained_items(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    expected = brute_contained([(r[0], r[1]) for r in docs], items)
    assert got(found) == expected and len(expected) > 60


def test_contained_items_awkward(spark, awkward):
    items = spark.createDataFrame([(1, "zeta alpha beta gamma delta epsilon"), (2, ""), (None, "twin text of nine"), (4, None)],
                                  "item_id long, text string")
    assert got(DC.contained_items(awkward, items)) == [(10, None, 1, 1), (5, 1, 2, 2), (9, None, 1, 1)]
    kept = DC.decontaminated(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 3
    assert DC.decontaminated(awkward, items.limit(0)).count() == awkward.count()
    assert DC.contained_items(empty(spark), items).count() == 0


# -- 2

def test_language_awkward(spark, awkward):
    train = docs_of(spark, [(i, t, n, None, None) for i, (t, n) in enumerate(
        [("the house and the garden of the town", "en"), ("das haus und der garten in der stadt", "de")] * 20)])
    model = LI.train(train)
    out = {r.doc_id: r for r in LI.predict(awkward, model).collect()}
    assert out[1].lang_pred in ("en", "de") and all(out[i].lang_pred == "und" and out[i].score == 0 for i in (2, 3, 6, 8))
    assert all(0 <= r.score <= 1 for r in out.values())
    assert set(r.lang_pred for r in LI.predict(awkward, LI.train(empty(spark))).collect()) == {"und"}
    assert LI.predict(empty(spark), model).count() == 0


def test_language_learns_from_distinct_texts(spark, monkeypatch):
    texts = [f"satz nummer {'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(50)]
    rows = [(i, t, "aa", None, None) for i, t in enumerate(texts)] + [(100 + i, texts[0], "aa", None, None) for i in range(3000)]
    seen = []
    monkeypatch.setattr(LI, "fit_model", lambda names, spectra, *_: seen.extend(names))
    LI.train(docs_of(spark, rows), sample=40)
    assert seen == ["aa"] * 40


def test_language_held_out(spark):
    from pyspark.sql import functions as F
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = LI.op2_language_id(spark, sf).where("held_out").join(docs, "doc_id").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_spectrum_kernel_is_that_of_sets():
    from gridsmith.llm.kernels import spectrum

    def sets(text):
        flat = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        flat = f" {flat} " if flat else " "
        return {flat[i:i + n] for n in range(1, 5) for i in range(len(flat) - n + 1)}

    for text in ("A house", "a  HOUSE!", "éÉ x", "12"):
        assert len(spectrum(text, 4, 22)) == len(sets(text))
    a, b = "the old house", "an old mouse"
    assert len(set(spectrum(a, 4, 22)) & set(spectrum(b, 4, 22))) == len(sets(a) & sets(b))


def test_language_scores_are_plain_kernel_ridge(monkeypatch):
    """With every text a landmark the scores are those of kernel ridge regression on sets of n-grams, in any batch."""
    import numpy as np

    from gridsmith.llm.kernels import spectrum

    def sets(text):
        flat = f" {' '.join(text.lower().split())} "
        return {flat[i:i + n] for n in range(1, 5) for i in range(len(flat) - n + 1)}

    def kernel(xs, ys):
        return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in ys] for x in xs])

    known = [("the old house by the lake", "en"), ("a garden and a house", "en"), ("where is the boat", "en"), ("das alte haus am see", "de"),
             ("ein garten und ein haus", "de"), ("wo ist das boot", "de"), ("la vieille maison du lac", "fr"), ("un jardin et une maison", "fr")]
    asked = ["the boat", "das boot am see", "une vieille maison", "x", "the boat"] + [t for t, _ in known]
    names = sorted({n for _, n in known})
    target = np.array([[1.0 if n == m else -1.0 for m in names] for _, n in known])
    held = [sets(t) for t, _ in known]
    # The constant is a feature of its own, with a penalty of a millionth.
    shift = LI.RIDGE / 1e-6
    dual = np.linalg.solve(kernel(held, held) + shift + LI.RIDGE * np.eye(len(held)), target)
    expected = (kernel([sets(t) for t in asked], held) + shift) @ dual
    model = LI.fit_model([n for _, n in known], [spectrum(t, 4, 64) for t, _ in known], landmarks=9)
    found = model.scores(asked)
    assert model.names == names and np.abs(found - expected).max() < 1e-4
    for batch, block in ((1, 8192), (4, 7), (128, 1)):
        monkeypatch.setattr(LI, "BATCH", batch)
        monkeypatch.setattr(LI, "BLOCK", block)
        assert (model.scores(asked) == found).all()
    assert model.scores([]).shape == (0, 3)


def test_language_of_very_long_texts_of_large_alphabets():
    import numpy as np

    from gridsmith.llm.kernels import spectrum
    rng = np.random.default_rng(13)
    shares = {name: rng.permutation(1 / np.arange(1, 3001)) for name in "abc"}  # one alphabet, other frequencies
    starts = {name: 0x4E00 + 1500 * k for k, name in enumerate(shares)}

    def write(name, n):
        return "".join(map(chr, starts[name] + rng.choice(3000, n, p=shares[name] / shares[name].sum())))

    labels = [name for name in shares for _ in range(30)]
    model = LI.fit_model(labels, [spectrum(write(name, 400), LI.LONGEST, LI.DIM_BITS) for name in labels])
    names = [name for name in shares for _ in range(2)]
    for n in (400, 100_000, 400_000):
        found = model.scores([write(name, n) for name in names]).argmax(axis=1)
        assert [model.names[k] for k in found] == names


# -- 3

def brute_lines(rows, min_sites=3):
    first = {}
    for _, text, _, source, _ in rows:
        if text is not None:
            name = "n" if source is None else f"s{source}"
            first[text] = min(name, first.get(text, name))
    sites = {}
    for text, source in first.items():
        for line in text.split("\n"):
            bare = line.strip(" \t\r\x0b\x0c")
            if bare:
                sites.setdefault(bare, set()).add(source)
    out = []
    for d, text, *_ in rows:
        if text is None:
            out.append((d, 0, 0, None))
            continue
        lines = text.split("\n")
        left = [x for x in lines if len(sites.get(x.strip(" \t\r\x0b\x0c"), ())) < min_sites]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def test_lines_as_by_hand(spark, awkward):
    rng = random.Random(2)
    pool = [f"line {i} " + "word " * (i % 5) for i in range(40)] + ["", "  ", " pad", "pad ", "pad\r"]
    rows = [(d, "\n".join(rng.choices(pool, k=rng.randrange(1, 12)) + [f"own {d} " * 8]), None, rng.choice([None, *"abcdef"]), None)
            for d in range(80)] + [(80, None, None, "a", None), (81, "", None, "b", None)]
    out = LD.without_boilerplate(docs_of(spark, rows), min_sites=3).select("doc.doc_id", "n_lines", "n_removed", "kept")
    assert got(out) == brute_lines(rows) and sum(r[2] for r in got(out)) > 50
    clean = LD.cleaned(awkward)
    assert clean.columns == awkward.columns and clean.dtypes == awkward.dtypes and clean.count() == awkward.count()
    assert LD.cleaned(empty(spark)).count() == 0


def test_pages_mostly_of_boilerplate_lose_it_and_copies_keep_their_lines(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    menu = "\n".join(words(6) for _ in range(4))
    own = {i: words(12) for i in range(15)}
    article = [words(40) for _ in range(5)]
    rows = [(i, f"{menu}\n{own[i]}", None, f"s{i}", 0) for i in own]
    rows += [(100 + i, "\n".join(article), None, f"s{i}", 0) for i in range(15)]
    out = {r.doc_id: r.text for r in LD.cleaned(docs_of(spark, rows)).collect()}
    assert out == {d: own.get(d, text) for d, text, *_ in rows}


def test_sketch_and_exact_count_agree_at_the_threshold(spark):
    rows = [(i, f"spread {k}\n{'own text ' * 20}{i}", None, f"s{i}", None) for k in range(8, 60) for i in range(k)]
    out = LD.spread_lines(docs_of(spark, rows).selectExpr(
        "xxhash64(split(text, '\n')[0]) k1", "xxhash64(1, split(text, '\n')[0]) k2", "source site"), 30)
    assert out.count() == len(range(30, 60))


# -- 4

def test_licenses(spark, awkward):
    notice = LS.TEMPLATES["gpl-3.0-notice"]
    changed = notice.replace("redistribute", "copy").replace("either version 3 of", "either version 3, 1 June, of")
    text = f"Ünïcode före. {notice.upper()} middle {changed}\nReleased under the\nMIT license; Released under no license."
    docs = docs_of(spark, [(1, text, None, None, None), (2, "licensed under nothing", None, None, None), (1, text, None, None, None)])
    out = LS.scan(docs).select("doc_id", "template", "matched", "length", "span_start", "span_end").collect()
    assert len(out) == 6 and len(set(out)) == 3
    spans = {(r.template, r.matched): text[r.span_start:r.span_end] for r in out}
    words = len(item_words(notice))
    assert spans[("gpl-3.0-notice", words)] == notice.upper()[:-1]
    assert spans[("gpl-3.0-notice", words - 1)] == changed[:-1]
    assert spans[("mit-line", 5)] == "Released under the\nMIT license"
    assert LS.scan(awkward).count() == 0 and LS.scan(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        LS.scan(docs, {"short": "all rights reserved"})


def test_banded_alignment_is_the_longest_common_sequence():
    from gridsmith.llm.kernels import banded_alignment

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randrange(1, 12)) for _ in range(2))
        n, first, last = banded_alignment(a, b, [-30] * len(a), [30] * len(a))
        assert n == lcs(a, b) and (n == 0 or lcs(a, b[first:last + 1]) == n)
        spans = [j - i for i in range(len(b)) for j in range(i, len(b)) if n and lcs(a, b[i:j + 1]) == n]
        assert n == 0 or last - first == min(spans)


def ordered_matches(a, b, longest):
    """Per place of ``b`` the most words of ``a`` that stand in order in the ``longest`` words from there, bit by bit."""
    at = {x: sum(1 << i for i, y in enumerate(a) if x == y) for x in set(a)}
    out = []
    for start in range(len(b)):
        row = full = (1 << len(a)) - 1
        for y in b[start:start + longest]:
            met = row & at.get(y, 0)
            row = ((row + met) | (row - met)) & full
        out.append(len(a) - row.bit_count())
    return out


def edited_copies(template, rng):
    """A template's words as they stand in files, with the words that still match."""
    lines = [template[i:i + 10] for i in range(0, len(template), 10)]
    swapped = set(rng.sample(range(len(template)), len(template) // 12))
    return {
        "as it is": (template, len(template)),
        "a mark on each line": ([w for line in lines for w in ["rem", *line]], len(template)),
        "two marks on each line": ([w for line in lines for w in ["rem", *line, "rem"]], len(template)),
        "words changed": (["changed" if i in swapped else w for i, w in enumerate(template)], len(template) - len(swapped)),
        "a word less on each line": ([w for line in lines for w in line[1:]], len(template) - len(lines)),
    }


def test_long_templates_against_every_place(spark):
    """A template of 300 words with a word more, changed or less on each line is found whole; brute
    force over all places of all texts finds the same texts, no others."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    template = [rng.choice(vocabulary) for _ in range(300)]
    short = [rng.choice(vocabulary) for _ in range(12)]
    templates = {"long": " ".join(template), "short": " ".join(short)}
    copies = edited_copies(template, rng)
    rows, expected = [], {}
    for i, (words, n) in enumerate(copies.values()):
        before = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        rows.append((i, " ".join(before + words + ["end", *short, *short]), None, None, None))
        where = len(before) + (words[0] == "rem")
        expected[i] = (n, where)
    half = template[:150]
    rows += [(90, " ".join(half + [rng.choice(vocabulary) for _ in range(200)]), None, None, None),
             (91, " ".join(rng.choice(vocabulary) for _ in range(400)), None, None, None), (92, "", None, None, None)]
    out = LS.scan(docs_of(spark, rows), templates).select("doc_id", "template", "matched", "span_start").collect()
    texts = {r[0]: r[1] for r in rows}
    placed = {(r.doc_id): (r.matched, len(texts[r.doc_id][:r.span_start].split())) for r in out if r.template == "long"}
    assert {d: n for d, (n, _) in placed.items()} == {d: n for d, (n, _) in expected.items()}
    assert all(placed[d][1] == expected[d][1] for d in (0, 1, 2))
    assert Counter(r.doc_id for r in out if r.template == "short") == {d: 2 for d in expected}
    for name, words, longest in (("long", template, 370), ("short", short, 18)):
        brute = {d for d, text in texts.items() if max(ordered_matches(words, text.split(), longest), default=0) >= 0.8 * len(words)}
        assert brute == {r.doc_id for r in out if r.template == name}


def test_a_notice_is_the_template_that_matches_most(spark):
    """Notices that differ in a word are told apart; the line inside a notice is part of it."""
    names = [n for n in LS.TEMPLATES]
    docs = docs_of(spark, [(i, f"before {LS.TEMPLATES[n]} after", None, None, None) for i, n in enumerate(names)])
    assert got(LS.scan(docs).select("doc_id", "template", "coverage")) == sorted(((i, n, 1.0) for i, n in enumerate(names)), key=str)
    both = {r.template for r in LS.scan(docs, every=True).where(f"doc_id = {names.index('agpl-3.0-notice')}").collect()}
    assert both == {"agpl-3.0-notice", "gpl-3.0-notice", "lgpl-2.1-notice"}


# -- 5

def test_mixing_targets(spark, awkward):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 40), None, rng.choices(["a", "b", "c", "d", None], [60, 20, 10, 5, 5])[0], None) for i in range(3000)]
    out = MX.mixed(docs_of(spark, rows)).select("doc.source", "size", "source_size", "target", "repeats").collect()
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.size * r.repeats
        target[r.source] = r.target
        assert 0 <= r.repeats <= 2
    total = sum(r.size for r in out)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    again = MX.mixed(docs_of(spark, rows)).select("doc.source", "size", "source_size", "target", "repeats").collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    mix = MX.mixture(awkward)
    assert set(awkward.columns) < set(mix.columns) and MX.mixed(awkward).count() == awkward.count()
    assert MX.mixture(empty(spark)).count() == 0


def test_water_level_clamps_and_reshares(spark):
    sources = spark.createDataFrame([("a", 5, 20), ("b", 2, 1000), ("c", 1, 1000), ("d", 5, 400)], "source string, weight long, cap long")
    level = MX.water_level(sources, 1500, 1)
    assert abs(sum(min(c, level * w) for _, w, c in [(0, 5, 20), (0, 2, 1000), (0, 1, 1000), (0, 5, 400)]) - 1500) < 1e-9
    assert MX.water_level(sources, 10_000, 1) is None


# -- 6

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QC.op6_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows)
    assert all(r.predicted == 1 for r in rows if r.quality) and all(0 <= r.score <= 1 for r in rows)


def test_quality_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (1, 1), (8, 0), (None, 1), (9, None), (99, 1)], "doc_id long, quality int")
    kept = QC.accepted(awkward, labels)
    assert kept.columns == awkward.columns and 8 not in {r.doc_id for r in kept.collect()}
    assert QC.accepted(awkward, labels.limit(0)).count() == awkward.count()
    assert QC.accepted(empty(spark), labels).count() == 0


def test_isotonic_is_the_nearest_monotone_sequence():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(50):
        y, w = rng.random(9), rng.random(9) + 0.1
        out = QC.isotonic(y, w)
        best = [max(min(np.average(y[a:b + 1], weights=w[a:b + 1]) for b in range(i, 9)) for a in range(i + 1)) for i in range(9)]
        assert np.allclose(out, best)


# -- 7

def brute_repeats(rows, length):
    raws = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(r[i:i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        starts = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, bytes(b for b, g in zip(r, gone, strict=True) if not g), sum(gone), starts))
    return sorted(out, key=str)


@pytest.mark.parametrize("alphabet, length, gram, bucket, dense", [("ab", 9, 4, 20, 6), ("ab\0é", 6, 3, 1000, 1000), ("abcdefgh", 5, 5, 7, 3)])
def test_repeats_as_by_hand(spark, alphabet, length, gram, bucket, dense):
    rng = random.Random(5)
    shared = ["".join(rng.choices(alphabet, k=12)) for _ in range(4)]
    rows = [(d, "".join(rng.choices(alphabet, k=rng.randrange(0, 40))) + rng.choice(shared + [""]) +
             "".join(rng.choices(alphabet, k=rng.randrange(0, 40))), None, None, None) for d in range(60)]
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, "ab" * 30, None, None, None), rows[0], (None, rows[1][1], None, None, None)]
    out = SD.without_repeats(docs_of(spark, rows), length, gram, bucket, dense).select("doc_id", "kept", "n_removed", "n_spans")
    assert sorted(((a, bytes(b), c, d) for a, b, c, d in out.collect()), key=str) == brute_repeats(rows, length)


def test_repeats_in_long_texts(spark, awkward, monkeypatch):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    out = SD.without_repeats(awkward, 200).select("doc_id", "kept", "n_removed", "n_spans")
    assert sorted(((a, bytes(b), c, d) for a, b, c, d in out.collect()), key=str) == brute_repeats(rows, 200)
    assert SD.without_repeats(empty(spark)).count() == 0


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    from gridsmith.llm import suffixes
    rng = random.Random(6)
    raw = bytes(rng.choices(b"abc", k=5000))
    whole = suffixes.anchors(raw, 60, 20)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    cut = suffixes.anchors(raw, 60, 20)
    spread = lambda a: {s: (int(p), int(g)) for p, f, l, g in zip(*a[:4], strict=True) for s in range(f, l + 1)}  # noqa: E731, E741
    assert spread(whole) == spread(cut) and len(spread(whole)) == 5000 - 59


# -- 8

def plain_fingerprint(text, width=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def grouped(links, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_near_duplicates_as_by_hand(spark, awkward):
    base = " ".join(f"word{i % 97}" for i in range(400))
    rows = [(i, base.replace(f"word{i}", "other", 1) if i else base, None, None, None) for i in range(40)]
    rows += [(100 + r[0] if r[0] else None, r[1], None, None, None) for r in awkward.select("doc_id", "text").collect()]
    out = ND.near_duplicates(docs_of(spark, rows)).collect()
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    assert sorted(((r.doc_id, r.fp % (1 << 64)) for r in out), key=str) == sorted(prints, key=str)
    distinct = {f for _, f in prints}
    label = grouped([(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 2], distinct)
    least = {}
    for d, f in prints:
        if d is not None:
            least[label[f]] = min(d, least.get(label[f], d))
    assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == sorted(((d, least.get(label[f])) for d, f in prints), key=str)
    kept = ND.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 9 in ids and 10 not in ids
    assert {r.doc_id for r in ND.one_of_each(docs_of(spark, rows)).collect()} == {
        d for d, f in prints if d == least.get(label[f])}
    assert ND.one_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("radius, blocks, dense", [(2, 4, 64), (2, 4, 2), (3, 5, 2), (1, 3, 2)])
def test_links_connect_as_all_pairs(spark, radius, blocks, dense):
    rng = random.Random(7)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(25)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = ND.links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius, blocks, dense)
    pairs = [tuple(r) for r in found.collect()]
    near = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= radius]
    assert {frozenset(p) for p in pairs} <= {frozenset(p) for p in near}
    expected = grouped(near, signed)
    assert grouped(pairs, signed) == expected
    roots = {r.node: r.root for r in components(found).collect()}
    assert {n: roots.get(n, n) for n in signed} == expected


def test_components_of_a_path(spark):
    order = list(range(300))
    random.Random(8).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(300)}


# -- 9

def warc_rows():
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello"
    odd = [None, "", "plain", "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\n", record, f"\r\n\r\n{record}\r\n\r\n",
           f"a{'' if False else chr(13) + chr(10)}\r\n\r\n{record}\r\n\r\n{record}\r\n\r\nz", "ü" * 300, "\r\n\r\nWARC/1.0", "x" * 70_000]
    rows = [(i, f"http://a/{i}\r\nX: y", body) for i, body in enumerate(odd)]
    rng = random.Random(9)
    rows += [(50 + i, "http://b/WARC/1.1", "".join(rng.choices(["\r\n", "\r", "\n", "\r\n\r\n", "WARC/1.", "1", record, "q"], k=30)))
             for i in range(60)]
    return rows + [(200, None, "plain"), (201, None, None), (None, "u", "plain"), (201, None, "")]


@pytest.mark.parametrize("split", ["128m", "700"])
def test_warc_round_trip(spark, tmp_path, split):
    import base64
    rows = warc_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    WA.write_warc(pages.repartition(3), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        records = WA.read_records(spark, path)
        out = got(WA.page_records(records))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for i, _, body in rows:
        first[body or ""] = max(first.get(body or "", -1), -1 if i is None else i)
    expected = []
    for i, _, body in rows:
        raw = (body or "").encode()
        last = first[body or ""]
        response = i == last or (i is None and last < 0)
        expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                         "response" if response else "revisit", None if response else last))
    assert out == sorted(expected, key=str)
    assert records.where("NOT complete").count() == 0


def test_warc_cut_off_and_empty(spark, tmp_path):
    path = tmp_path / "cut"
    path.mkdir()
    good = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (path / "a.warc").write_bytes(good + good.replace(b"3", b"30"))
    (path / "b.warc").write_bytes(b"junk\r\n\r\n" + good)
    out = WA.read_records(spark, str(path)).select("at", "length", "complete", "digest").collect()
    assert sorted((r.at, r.length, r.complete) for r in out) == [(0, 3, True), (len(good), 30, False)]
    WA.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert WA.read_records(spark, str(tmp_path / "none")).count() == 0


# -- 10

def test_edited_texts(spark, awkward):
    rows = sorted({(r.doc_id, r.text or "") for r in awkward.collect()}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = {(r.doc_id, r.text): r.edited for r in FP.edited(awkward).collect()}
    assert FP.edited(awkward).count() == awkward.count()
    ids = [r[0] for r in rows]
    for k, (d, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        if ids.count(d) == 1 and ids.count(rows[(k + 1) % len(rows)][0]) == 1:
            assert out[(d, text)] == text[:len(text) - q] + after[:q]
    one = docs_of(spark, [(1, "abcdefgh", None, None, None)])
    assert FP.edited(one).first().edited == "abcdefab" and FP.edited(empty(spark)).count() == 0


def test_all_within_the_radius(spark):
    rng = random.Random(10)
    base = [rng.getrandbits(63) for _ in range(30)]
    index = {b ^ sum(1 << x for x in rng.sample(range(63), rng.randrange(0, 6))) for b in base for _ in range(20)} | set(base)
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "fp long")
    out = {tuple(r) for r in FP.within(frame(base), frame(index)).collect()}
    assert out == {(q, f, (q ^ f).bit_count()) for q in base for f in index if (q ^ f).bit_count() <= 3}


def test_weighted_fingerprint_votes():
    import math

    from gridsmith.llm.kernels import weighted_simhash
    assert weighted_simhash(None) == weighted_simhash(" ") == 0
    word = "solo"
    assert weighted_simhash(word) % (1 << 64) == xxhash.xxh64_intdigest(word)
    assert weighted_simhash("A b") == weighted_simhash("a  B\n")
    assert math.isfinite(weighted_simhash(LONG))
