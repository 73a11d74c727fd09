"""Source mixing: targets, schedule, totals, and the emitted texts."""

import random
import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from sieveline.llm import mixing as M

COLUMNS = "doc_id long, source string, text string"


def water_fill(sizes, weights=M.WEIGHTS, percent=M.SHARE_PERCENT, cap=M.CAP):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values()) * percent / 100
    target = dict.fromkeys(sizes, 0.0)
    open_ = set(sizes)
    while open_ and total > 1e-9:
        share = total / sum(w[s] for s in open_)
        full = {s for s in open_ if share * w[s] >= cap * sizes[s] - 1e-9}
        for s in full or open_:
            target[s] = float(cap * sizes[s]) if full else share * w[s]
            total -= target[s]
        open_ -= full or open_
    return target


def make(n, seed, sources):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), " ".join(["w"] * rng.choice([0, 1, 5, 40, 200]))) for i in range(n)]


@pytest.mark.parametrize("seed,sources,block", [(1, ["a", "b", None], 16), (2, ["hot"] * 6 + ["b", "c", "é", "z"], 64),
                                               (3, ["only"], 7), (4, [f"s{i}" for i in range(40)], 128)])
def test_targets_and_totals(spark, seed, sources, block):
    rows = make(300, seed, sources)
    df = spark.createDataFrame([(*r, "x") for r in rows], COLUMNS + ", taken string")
    got = M.mix(df, block_words=block).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = water_fill({s: size[s] for s in size})
    for r in got:
        assert r.source_size == size[r.source]
    for s in size:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert taken[s] == int(target[s])
    again = {(r.doc_id, r.taken) for r in M.mix(df.repartition(7), block_words=block).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_schedule_is_exact_and_low_discrepancy(spark):
    rows = make(400, 5, ["a", "a", "a", "b", "c"])
    sizes = M.sized(spark.createDataFrame(rows, COLUMNS))
    goal = M.targets(sizes)
    slots = sorted((r.slot, r["__sid"], r.block) for r in M.schedule(goal, 32).collect())
    need = {r["__sid"]: -(-r["__words"] // 32) for r in goal.collect()}
    assert Counter(s for _, s, _ in slots) == Counter(need)
    ranks = defaultdict(list)
    for _, s, b in slots:
        ranks[s].append(b)
    assert all(b == list(range(len(b))) for b in ranks.values())
    total = sum(need.values())
    for n in (total // 4, total // 2):
        part = Counter(s for _, s, _ in slots[:n])
        for s, k in need.items():
            assert abs(part[s] - n * k / total) <= 8


def test_segments_cover_what_is_taken(spark):
    df = spark.createDataFrame(make(100, 6, ["a", "b", "c"]), COLUMNS)
    sizes = M.sized(df)
    goal = M.targets(sizes)
    places = M.placed(sizes, goal)
    seg = M.segments(places, M.schedule(goal, 16), 16).collect()
    assert all(0 < r.to_word - r.from_word <= 16 for r in seg)
    assert sum(r.to_word - r.from_word for r in seg) == sum(r["__words"] for r in goal.collect())


def test_edge_rows(spark):
    rows = [(1, "a", None), (2, "a", ""), (None, None, "x y"), (None, None, "x y"), (3, "b", "p q r\n s"), (3, "b", "p q r\n s")]
    df = spark.createDataFrame(rows, COLUMNS)
    got = M.mix(df, block_words=2).collect()
    assert len(got) == 6 and sum(r.taken for r in got) == int(sum({(r.source, r.target) for r in got} and
                                                              {r.source: r.target for r in got}.values()))
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert M.mix(df.limit(0)).count() == 0
    none = M.mix(df.where("doc_id < 3")).collect()
    assert [r.target for r in none] == [0.0, 0.0]


def test_emitted_texts(spark):
    text = " \tone  two\nthree four \n"
    rows = [(0, text, 4, 0), (1, text, 4, 3), (2, text, 4, 4), (3, text, 4, 7), (4, "a b", 2, 4), (5, "a b", 2, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long, taken long")
    got = defaultdict(list)
    for r in M.emit(df).collect():
        got[r.doc_id].append(r.text)
    words = {d: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in t) for d, t in got.items()}
    assert words == {1: 3, 2: 4, 3: 7, 4: 4, 5: 1}
    assert got[2] == [text] and got[4] == ["a b", "a b"] and got[1] == [" \tone  two\nthree "]


def test_mixture_rows_are_in_the_order_of_the_schedule(spark):
    """Every part of the mixture has nearly its sources' shares; texts and counts are those of the takings."""
    rows = make(900, 8, ["a", "a", "a", "b", "c"]) + [(5000, "b", "twice the same row")] * 2
    df = spark.createDataFrame(rows, COLUMNS).withColumn("size", F.lit("own"))
    got = M.mixture(df, block_words=64).collect()
    assert [c for c in got[0].asDict()] == df.columns
    taken = defaultdict(int)
    for r in got:
        taken[r.doc_id] += len(r.text.split())
    mixed = M.mix(df, block_words=64).collect()
    want = defaultdict(int)
    for r in mixed:
        want[r.doc_id] += r.taken
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in want.items() if n}
    words = [(r.source, len(r.text.split())) for r in got]
    total = sum(n for _, n in words)
    share = Counter()
    for s, n in words:
        share[s] += n
    done, so_far = 0, Counter()
    longest = max(n for _, n in words)
    for s, n in words:
        so_far[s] += n
        done += n
        for x in share:
            assert abs(so_far[x] - done * share[x] / total) <= 12 * (64 + longest), (x, done)
    slots = [tuple(x) for r in mixed if r.slots for x in r.slots]
    assert len(set(slots)) == len(slots) == sum(-(-r.taken // r.size) for r in mixed if r.taken)
    assert M.mixture(df.limit(0)).count() == 0
