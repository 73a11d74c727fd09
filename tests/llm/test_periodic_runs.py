"""Runs of words against a brute-force search of every period."""

import hashlib
import os
import random
import zlib

import pytest

from sieveline.llm import periodic_runs as P

SF = "/root/testdata/sf0.001"


def brute(w, least=12):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1 if j == i else j
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    yield list("ab" * 12 + "a") * 2
    for size in (1, 2, 3, 5):
        for _ in range(8):  # touching regions of one small period: runs of large periods without other anchors
            u = [rng.choice("ab") for _ in range(size)]
            k = rng.randint(5, 70)
            yield u * k + u[:rng.randint(0, size)] + u * rng.randint(5, 70) + rng.choices("abc", k=3) + u * k
            yield (u * k)[:rng.randint(10, 120)] * rng.randint(2, 4)
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    yield list(b)
    for letters in ("ab", "abc", "abcdefgh"):
        for _ in range(25):
            base = rng.choices(letters, k=rng.randint(1, 150))
            x = []
            for _ in range(rng.randint(1, 5)):
                s = rng.randrange(len(base))
                x += base[s:s + rng.randint(1, len(base))] * rng.randint(1, 4)
            yield x[:700]
    yield []
    yield ["x"]
    yield ["x"] * 12


def test_all_runs_of_random_and_highly_periodic_words():
    texts = list(made(random.Random(3)))
    found = P.runs_of(texts)
    for words, runs in zip(texts, found, strict=True):
        assert [tuple(r) for r in runs.tolist()] == brute(words), words
    assert max(q for words in texts for _, _, q in brute(words)) > 100
    assert [len(r) for r in P.runs_of([list("aab" * 4), list("ab" * 3)], least=4)] == [len(brute(list("aab" * 4), 4)), 1]


def test_hash_collisions_only_cost_time(monkeypatch):
    from sieveline.llm import syncsets as S
    monkeypatch.setattr(S, "mix", lambda x: x & S._U(1))  # words hash to 0 or 1
    rng = random.Random(4)
    texts = [rng.choices("abcd", k=rng.randint(0, 20)) * rng.randint(1, 4) for _ in range(40)]
    assert [[tuple(r) for r in runs.tolist()] for runs in P.runs_of(texts)] == [brute(t) for t in texts]


def test_columns_collapsed_text_and_edge_rows(spark):
    run = "a b c " * 5
    rows = [(1, "x " + run + "z", "own"), (1, "x " + run + "z", "own"), (None, run, None), (2, None, None), (3, " \n\t", None),
            (4, " a " * 12, None), (5, "w" * 100_000 + " " + "é " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {(r.doc_id, r.text): r for r in P.mark_runs(df).collect()}
    assert len(got) == 6 and P.mark_runs(df).count() == 7
    one = got[(1, rows[0][1])]
    assert [tuple(r) for r in one.runs] == [(1, 15, 3)] and one.collapsed == "x a b c z" and one.n_words == 17
    assert got[(None, run)].collapsed == "a b c"
    assert got[(2, None)].collapsed == got[(3, " \n\t")].collapsed == "" and got[(2, None)].runs == []
    assert got[(4, rows[5][1])].collapsed == " a"  # no-break space is part of a word
    assert [tuple(r) for r in got[(5, rows[6][1])].runs] == [(1, 5000, 1)]
    assert P.mark_runs(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_matches_its_contract(spark):
    from sieveline.llm import catalog
    got = {r.doc_id: r for r in catalog.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words = (d.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words) if n < 1500 else [tuple(r) for r in P.runs_of([words])[0].tolist()]
        gone = {i for s, e, q in runs for i in range(s + q, e)}
        r = got[d.doc_id]
        text = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert (r.n_runs, r.runs_sha256) == (len(runs), hashlib.sha256(text.encode()).hexdigest())
        assert r.collapsed_sha256 == hashlib.sha256(left).hexdigest()
        best = max(((e - s, -s, -q) for s, e, q in runs), default=None)
        assert (r.length, r.start, r.period) == ((best[0], -best[1], -best[2]) if best else (None, None, None))
        assert r.exponent_milli == (1000 * best[0] // -best[2] if best else None)
