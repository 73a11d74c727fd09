"""Decontamination against a search of every window at every place."""

import random
import re

import numpy as np
import pytest

from sieveline.llm import decontamination as D


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        k = min(window, len(v))
        wanted = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in wanted:
                hit |= set(range(i, i + k))
                names.add("" if name is None else str(name))
    return len(w), len(hit), sorted(names)


def corpus(rng, letters, n_docs=60, n_items=25):
    items = [(i if i else None, " ".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 8, 12, 20])))) for i in range(n_items)]
    items += [(90, items[-1][1].upper()), (90, items[-1][1]), (91, None)]
    docs = []
    for d in range(n_docs):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choices([*letters, "unseen"], k=rng.randint(0, 6))
            v = words(rng.choice(items)[1])
            a = rng.randint(0, len(v))
            text += v[a:a + rng.randint(0, 15)]
        docs.append((d, ", ".join(text)))
    return docs, items


@pytest.mark.parametrize("letters, window", [("ab", 3), ("abcdefghijkl", 3), ("abcdefgh", 5)])
@pytest.mark.parametrize("how", [{}, {"shard_words": 20}, {"block_bytes": 64}])
def test_random_documents_match_brute_force(spark, letters, window, how):
    docs, items = corpus(random.Random(len(letters) + window), letters)
    docs += [(None, docs[5][1]), (5, docs[5][1]), (200, None), (201, ""), (202, "!?")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_items(df, bench, window=window, **how).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted(
        (d is None, d, *brute(t, items, window)) for d, t in docs)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)
    names = {str(i or ""): words(t) for i, t in items}
    for r in got:
        w = words(r.text)
        for m in r.matches:  # verbatim, and not to be extended
            v = next(words(t) for i, t in items if str(i or "") == m.item_id and words(t)[m.item_start:m.item_start + m.n_words]
                     == w[m.doc_start:m.doc_start + m.n_words])
            a, b, n = m.item_start, m.doc_start, m.n_words
            assert a + n == len(v) or b + n == len(w) or v[a + n] != w[b + n]
            assert a == 0 or b == 0 or v[a - 1] != w[b - 1]
    assert names


def test_suffix_array_order_and_longest_matches():
    rng = random.Random(8)
    for letters in ("ab", "abcdef"):
        items = D.Items([(str(i), " ".join(rng.choices(letters, k=rng.randint(1, 30))).encode()) for i in range(12)], 4)
        text = [rng.choice([0, *range(1, len(items.number) + 1)]) for _ in range(400)] + [1, 2] * 60
        shard = D.Shard(np.array(text), items.longest)
        view = lambda p: text[p:next((i for i in range(p, len(text)) if not text[i]), len(text))][:items.longest]
        views = [view(p) for p in shard.at.tolist()]
        assert views == sorted(views) and sorted(shard.at.tolist()) == [p for p, x in enumerate(text) if x]
        length, place = shard.longest(items, items.suffix)
        for s, n, p in zip(items.suffix.tolist(), length.tolist(), place.tolist(), strict=True):
            v = items.words[s:s + items.longest].tolist()
            v = v[:v.index(0)] if 0 in v else v
            best = max((next((i for i, (a, b) in enumerate(zip(v, x, strict=False)) if a != b), min(len(v), len(x))) for x in views), default=0)
            assert n == best and (n == 0 or text[p:p + n] == v[:n])


def test_removal_long_text_and_empty_tables(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, f"Clean text {i} of its own" , 1) for i in range(3)] + [(2, "so " * 40_000 + item.upper() + " so" * 40_000, 2), (3, item[6:], 3),
                                                                       (4, item[:-7].replace(" ", "\n"), 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    left = D.decontaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 1, 1]
    long = D.find_items(docs, bench).where("doc_id = 2").first()
    assert [tuple(m) for m in long.matches] == [("1", 0, 40_000, 11)] and [tuple(s) for s in long.spans] == [(40_000, 40_011)]
    assert D.decontaminated(docs, bench.limit(0)).count() == 6 and D.decontaminated(docs.limit(0), bench).count() == 0
