"""Importance resampling against a plain re-computation of its definition."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import pytest

from sieveline.llm import importance as I

SF = "/root/testdata/sf0.001"


def features(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def brute(docs, target, percent=25, least=20):
    """{doc_id: (n_features, weight, score, rank)} of {doc_id: text}."""
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s = collections.Counter(bucket(g) for t in docs.values() for g in features(t)[1])
    t = collections.Counter(bucket(g) for x in target for g in features(x)[1])
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out, able = {}, []
    for d, text in docs.items():
        w, f = features(text)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if len(w) >= least:
            able.append((-out[d][2], d))
    for k, (_, d) in enumerate(sorted(able)[:percent * len(able) // 100]):
        out[d][3] = k + 1
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_matches_brute_force(spark):
    from sieveline.llm import catalog
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in
           catalog.op12_importance_resampling(spark, SF).collect()}
    assert got == brute(docs, target)
    assert sum(x[3] is not None for x in got.values()) > 10


def test_table_interns_by_bytes_not_by_hash():
    rng = random.Random(2)
    grams = [rng.choice("abcdefghij").encode() * rng.randint(1, 6) for _ in range(3000)]
    for hash_of in (None, len, lambda g: 0):  # many or all keys collide
        table = I.NgramTable(grams, hash_of=hash_of)
        slots = collections.defaultdict(set)
        for g, s in zip(grams, table.slot.tolist(), strict=True):
            slots[g].add(s)
        assert all(len(x) == 1 for x in slots.values()) and len(set.union(*slots.values())) == len(slots)
        for g, n in collections.Counter(grams).items():
            (s,) = slots[g]
            assert table.count[s] == n and table.bucket[s] == zlib.crc32(g) % I.BUCKETS
    assert I.NgramTable([]).count.sum() == 0


def test_long_texts_batches_and_repeated_words(spark, monkeypatch):
    monkeypatch.setattr(I, "BATCH_WORDS", 50)
    rng = random.Random(5)
    docs = {d: " ".join(rng.choices("Ab b É1 x-y".split(), k=rng.randint(0, 90))) for d in range(60)}
    docs |= {100: "word " * 30_000, 101: "", 102: None, 103: "東京 " * 25}
    df = spark.createDataFrame([(d, t, 1) for d, t in docs.items()], "doc_id long, text string, score int")
    target = ["ab b é1", None, "東京 東京"]
    corpus = I.count_buckets(df)
    gain = I.gains(corpus, I.count_buckets(spark.createDataFrame([(t,) for t in target], "text string")))
    got = {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in I.draw(I.weigh(df, gain)).collect()}
    assert got == brute(docs, target)


def test_null_ids_ties_and_empty_tables(spark):
    text = "one two three " * 10
    rows = [(None, text), (None, text), (7, text), (7, text), (None, text + "x"), (3, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = df.limit(0)
    got = I.resample(df, target, percent=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5] and {r.doc_id for r in got} == {None, 7}
    again = I.resample(df, target, percent=100).collect()
    assert sorted((r["rank"], r.text) for r in got) == sorted((r["rank"], r.text) for r in again)
    assert I.resample(target, df).collect() == [] and I.resample(df, target, percent=0).collect() == []
