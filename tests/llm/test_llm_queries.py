"""Registered queries against SQL, and the pipeline against plain Python."""

import hashlib
from collections import defaultdict

import check
import corpus_pipeline
import pytest
from test_llm_operators import brute_contained, brute_lines, brute_repeats, got, grouped, plain_fingerprint

from gridsmith.llm.queries import ORACLES, QUERIES
from gridsmith.session import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    _, text, ok = check.compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("make", [lambda s: QUERIES["op1_decontamination"](s, SF)])
def test_native_main_path(spark, make):
    plan = make(spark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_repeats_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expected = sorted((d, len((dict(rows)[d] or "").encode()), n, s, hashlib.sha256(k).hexdigest()) for d, k, n, s in brute_repeats(rows, 200))
    assert sorted(tuple(r) for r in QUERIES["op7_suffix_array_dedup"](spark, SF).collect()) == expected


def test_near_duplicates_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    prints = {d: plain_fingerprint(t) for d, t in rows}
    label = grouped([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], list(prints))
    assert got(QUERIES["op8_simhash_near_dedup"](spark, SF)) == sorted(((d, f"{f:016x}", label[d]) for d, f in prints.items()), key=str)


def test_fingerprints_query(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    out = {r.doc_id: r for r in QUERIES["op10_document_fingerprints"](spark, SF).collect()}
    near = defaultdict(int)
    for k, (d, text) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)]
        q = len(text) // 4
        edited = text[:len(text) - q] + follow[1][:q]
        r = out[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
        assert r.near_edited == 1 - bits(r.fingerprint, r.edited_fingerprint) / 64
        assert r.near_next == 1 - bits(r.fingerprint, out[follow[0]].fingerprint) / 64
        near[d] = sum(bits(r.fingerprint, o.fingerprint) <= 3 for o in out.values()) - 1
        assert r.near_docs == (near[d] if d % 100 == 0 else None)


def test_pipeline_as_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    scored = staged(stages["quality"](spark, docs, SF))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stay = {r.doc_id for r in scored.collect()}
    assert all(d in stay for d, q in labels.items() if q) and sum(d in stay for d, q in labels.items() if not q) <= 1
    rows = [tuple(r) for r in scored.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    lined = staged(stages["line_dedup"](spark, scored, SF))
    expected = {d: kept for d, _, _, kept in brute_lines(rows, 10)}
    assert {r.doc_id: r.text for r in lined.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    near = staged(stages["near_dedup"](spark, lined, SF))
    prints = {d: plain_fingerprint(t) for d, t in expected.items()}
    label = grouped([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], list(prints))
    assert {r.doc_id for r in near.collect()} == set(label.values())
    clean = staged(stages["decontamination"](spark, near, SF))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    held = {d for d, *_ in brute_contained([(d, expected[d]) for d in label.values()], items)}
    assert {r.doc_id for r in clean.collect()} == set(label.values()) - held
    assert all(x.columns == docs.columns for x in (scored, lined, near, clean))
    mix = stages["mixing"](spark, clean, SF).collect()
    sizes = {r.doc_id: len(r.text.encode().split()) for r in clean.collect()}
    assert abs(sum(sizes[r.doc_id] for r in mix) - 1.5 * sum(sizes.values())) < 0.1 * sum(sizes.values())
    assert {(r.doc_id, r.text) for r in mix} <= {(r.doc_id, r.text) for r in clean.collect()}
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, mix))
