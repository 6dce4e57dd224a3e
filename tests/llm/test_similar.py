"""The similarity form of near-duplicate detection, and the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodex.llm import packing, pii, simhash, toxicity

from .test_operators import ODD, ODD_IDS, table


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def family():
    """Texts with edited copies of many similarities, and unrelated ones."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for edits in (1, 2, 6, 25):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    return texts


def test_groups_follow_jaccard(spark, family):
    docs = table(spark, family)
    root = {r.doc_id: r.root for r in simhash.similar_groups(docs).collect()}
    sets = [shingles(t) for t in family]
    caught = missed = wrong = 0
    for i in range(len(family)):
        for j in range(i):
            s = jaccard(sets[i], sets[j]) if i // 5 == j // 5 else 0.0
            same = root[i] == root[j]
            if s >= 0.85:
                caught, missed = caught + same, missed + (not same)
            elif i // 5 != j // 5:
                wrong += same
    assert wrong == 0 and caught > 100 and missed <= 0.03 * caught


def test_groups_are_those_of_the_exact_similarity(spark):
    """Pairs on both sides of 0.8, where 512 bits cannot decide, and short texts that differ in a word."""
    rng = random.Random(5)
    texts = []
    for length in (10, 11, 12, 13, 24, 25, 26, 60, 104):
        for k in range(12):
            base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
            edits = 1 if length < 20 else max(1, length // 50 + k % 2)
            texts += [" ".join(base), " ".join([*base[:-edits], *(f"x{k}e{e}" for e in range(edits))]), " ".join([f"y{k}", *base[1:-1], f"z{k}"])]
    for k in range(60):
        base = [f"v{rng.randrange(10**6)}" for _ in range(104)]
        texts += [" ".join(base), " ".join(["a", *base[:20], "b", *base[21:50], "c", *base[51 : 104 - 4 * (k % 2)]])]
    sets = [shingles(t) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] & sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                want = [min(want[i], want[j]) if w in (want[i], want[j]) else w for w in want]
    groups = {}
    for r in simhash.similar_groups(table(spark, texts)).collect():
        groups.setdefault(r.root, []).append(r.doc_id)
    got = {d: min(own) for own in groups.values() for d in own}
    assert [got[i] for i in range(len(texts))] == want and 0 < sum(w != i for i, w in enumerate(want)) < len(texts) // 2


def test_one_of_each_group_stays(spark, family):
    texts = [*family, family[0], family[0], "short one", "short one", "another short", None, "", " "]
    docs = table(spark, texts)
    kept = simhash.deduplicated(docs).collect()
    assert all(r.lang is None or r.lang == "en" for r in kept)
    by = {r.doc_id for r in kept}
    n = len(family)
    assert {0, n + 2, n + 4, n + 5} <= by and not {1, n, n + 1, n + 3, n + 6, n + 7} & by


def test_odd_documents_survive(spark):
    docs = table(spark, [*ODD, ODD[6]], [*ODD_IDS, 6]).withColumns({c: F.lit(1) for c in ("kept_id", "kept_th", "th", "root", "node", "fp", "x")})
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == [(False, 0), (False, 3), (False, 4), (False, 5), (False, 6), (False, 8), (False, 10), (True, 0)]
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_blocks_of_hot_buckets_change_nothing(spark, family):
    docs = table(spark, family[:100])
    ways = []
    for block in (1024, 8):
        groups = {}
        for r in simhash.similar_groups(docs, block=block).collect():
            groups.setdefault(r.root, set()).add(r.doc_id)
        ways.append(sorted(map(sorted, groups.values())))
    assert ways[0] == ways[1]


def test_segments_are_the_bits(spark):
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    df = spark.createDataFrame([tuple(int(x) for x in fp.view(np.int64))], ", ".join(f"f{k} long" for k in range(8)))
    got = list(df.select(*simhash.segment_values([f"f{k}" for k in range(8)])).first())
    whole = sum(int(x) << 64 * k for k, x in enumerate(fp))
    assert got == [whole >> 14 * i & 0x3FFF for i in range(36)]


def test_allowed_bits_grow_with_dissimilarity():
    assert simhash.allowed_bits(1.0, 512) == 0 < simhash.allowed_bits(0.9, 512) < simhash.allowed_bits(0.8, 512) < 100


def test_wide_fingerprints_estimate_similarity(family):
    a, b = simhash.wide_fingerprint(family[0]), simhash.wide_fingerprint(family[2])
    s = jaccard(shingles(family[0]), shingles(family[2]))
    expected = np.arccos(2 * s / (1 + s)) / np.pi * 512
    assert abs(np.bitwise_count(a ^ b).sum() - expected) < 35


# --- pipeline


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.cut(stage(spark, docs, sf), "test")
        if k < 4:
            assert docs.schema.names == before.schema.names and docs.count() <= before.count()
        if k == 1:
            texts = [r.text for r in docs.collect()]
            assert len(set(texts)) == len(texts)
        if k == 3:
            assert not any(pii.base_spans(r.text) for r in docs.collect())
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}


def test_run_equals_its_stages(spark, sf):
    whole = sorted(map(str, corpus_pipeline.run(spark, sf).drop("sequence_id").collect()))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf), "test")
    assert sorted(map(str, docs.drop("sequence_id").collect())) == whole


def test_stages_on_odd_documents(spark, sf):
    """Nulls, empty and long texts, repeated rows and clashing columns pass every stage."""
    docs = table(spark, [*ODD, ODD[6]], [*ODD_IDS, 6])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.count() >= 0 and (k == 4 or out.columns == docs.columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_toxic_rows_go(spark):
    machine = toxicity.Machine(20, *_weight_of("zonk"))
    docs = table(spark, ["a zonk here", "fine text", None])
    assert sorted(r.doc_id for r in toxicity.without_toxic(docs, machine).collect()) == [1, 2]


def _weight_of(word):
    at = toxicity.columns(word)
    return np.sort(at), -4.0, np.full(len(at), 6.0), np.zeros((len(at), 4))


def test_queries_are_registered():
    from lodex.llm.queries import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert packing.WINDOW == 2048
