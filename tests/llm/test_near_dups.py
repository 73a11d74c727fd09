"""Near duplicates against brute force over all pairs; signatures; components."""

import itertools
import random

import numpy as np
import pytest

from sieveline.llm import near_dups as N
from sieveline.llm import superminhash as S
from sieveline.llm.components import components

COLUMNS = "doc_id long, text string, kept string"


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check(spark, docs):
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], COLUMNS)
    got = {r.doc_id: r for r in N.near_duplicates(df).collect()}
    want = brute(docs)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.component_id == d) for d, r in got.items())
    left = sorted(r.doc_id for r in N.deduplicated(df).collect())
    assert left == sorted({c for _, c in want.values()})


def prose(rng, n):
    return ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 6))) for _ in range(n)]


def test_matches_brute_force(spark):
    rng = random.Random(7)
    docs, passage = [], prose(rng, 60)
    bases = [prose(rng, rng.randint(5, 300)) for _ in range(25)]
    for i in range(160):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
            w[rng.randrange(len(w))] = "x" + str(rng.random())
        if rng.random() < 0.3:
            w += passage
        docs.append((i * 3 + 1, rng.choice([" ", "\n"]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    docs += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "One\ttwo"), (5005, "one"), (5006, "É a b c d"),
             (5007, "é a b c d"), (5008, "y " * 3000), (5009, "y y y y y")]
    check(spark, docs)


def test_a_hot_group_of_near_copies_and_a_chain(spark):
    rng = random.Random(8)
    base = prose(rng, 120)
    docs = []
    for i in range(120):  # copies of one text with one word changed: every pair is similar
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        docs.append((i, " ".join(w)))
    chain = prose(rng, 200)
    for i in range(12):  # each is close to the next one only
        chain = [*chain[18:], *prose(rng, 18)]
        docs.append((1000 - i, " ".join(chain)))
    check(spark, docs)


def test_null_ids_equal_rows_empty_table(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(2, text, ""), (2, text, ""), (None, text, ""), (None, "lone text", ""), (3, text + " h", "")], COLUMNS)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in N.near_duplicates(df).collect())
    assert got == [(0, 0, True), (0, 2, False), (2, 2, True), (2, 2, True), (3, 2, False)]
    assert sorted(r.doc_id or 0 for r in N.deduplicated(df).collect()) == [0, 2]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_similarity_with_less_variance_than_minhash():
    rng = np.random.default_rng(0)
    a, b = [], []
    for _ in range(300):
        x = rng.integers(0, 2**63, size=46, dtype=np.uint64)
        a.append(np.unique(x[:40]))
        b.append(np.unique(x[6:]))
    share = (S.signatures(a, 128) == S.signatures(b, 128)).mean(axis=1)
    j = 34 / 46
    assert abs(share.mean() - j) < 0.01 and share.std() < 0.8 * (j * (1 - j) / 128) ** 0.5


def test_early_stop_gives_the_signature_of_the_plain_algorithm():
    """One element and position at a time, without early stopping or grouping."""
    rng = np.random.default_rng(1)
    m = 16
    sets = [np.unique(rng.integers(0, 2**63, size=n, dtype=np.uint64)) for n in (1, 2, 5, 40, 300)]
    want = []
    for s in sets:
        sig = [int(S.EMPTY)] * m
        for e in s:
            p = list(range(m))
            for j in range(m):
                r = int(S.mix(np.array([e + S._step(j)], dtype=np.uint64))[0])
                k = j + ((r & 0xFFFFFFFF) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                sig[p[j]] = min(sig[p[j]], j << 52 | r >> 12)
        want.append(sig)
    assert S.signatures([np.array([], dtype=np.uint64), *sets], m).tolist() == [[int(S.EMPTY)] * m, *want]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 501 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
