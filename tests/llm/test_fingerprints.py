"""Fingerprints: homomorphism, equality, likeness, neighbours and edited texts."""

import hashlib
import random

from pyspark.sql import functions as F

from sieveline.llm import fingerprints as P

COLUMNS = "doc_id long, text string"


def vectors(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], COLUMNS)
    rows = P.with_vector(df.withColumn("text", F.coalesce("text", F.lit(""))), "text", "v").withColumn("fp", P.as_text(F.col("v")))
    return {r.doc_id: (r.v, r.fp) for r in rows.collect()}


def test_order_does_not_matter_but_content_does(spark):
    v = vectors(spark, ["a b.\nc d.\ne", "e\na b.\nc d.", "c d. a b.\n\n \ne", "a b.\nc d.", "a b.\na b.\nc d.\ne", "", None, " \n"])
    assert v[0] == v[1] == v[2] and len({x[1] for x in v.values()}) == 4
    assert v[5] == v[6] == v[7] and set(v[5][0]) == {0}
    assert all(len(fp) == 8 * (1 + P.DENSE) + 4 * P.SPARSE for _, fp in v.values())


def test_insert_and_delete(spark):
    rng = random.Random(1)
    lines = [f"line {rng.random()}" for _ in range(300)]
    v = vectors(spark, ["\n".join(lines), "\n".join(lines[:120]), "\n".join(lines[120:])])
    df = spark.createDataFrame([(v[0][0], v[1][0], v[2][0])], "a array<long>, b array<long>, c array<long>")
    r = df.select(P.combine(F.col("b"), F.col("c")).alias("sum"), P.combine(F.col("a"), F.col("b"), -1).alias("rest")).first()
    assert r["sum"] == v[0][0] and r["rest"] == v[2][0]


def test_likeness_follows_common_pieces(spark):
    rng = random.Random(2)
    pool = [f"piece {rng.random()}" for _ in range(400)]
    cases = [(100, 100, 0), (100, 50, 0), (100, 0, 100), (20, 10, 10), (60, 45, 15), (1, 1, 1)]
    pairs = []
    for n, common, new in cases:
        pairs.append(("\n".join(pool[:n]), "\n".join(pool[:common] + pool[200:200 + new]), common / (n + new)))
    v = vectors(spark, [x for a, b, _ in pairs for x in (a, b)])
    df = spark.createDataFrame([(v[2 * i][0], v[2 * i + 1][0], want) for i, (_, _, want) in enumerate(pairs)],
                               "a array<long>, b array<long>, want double")
    for r in df.withColumn("got", P.likeness(F.col("a"), F.col("b"))).collect():
        assert 0 <= r.got <= 1 and abs(r.got - r.want) < 0.13, (r.got, r.want)


def expected(rows):
    key = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for i, (d, t) in enumerate(key):
        t, nxt = t or "", key[(i + 1) % len(key)][1] or ""
        h = len(t) // 2
        e = t[:len(t) - h] + nxt[:h]
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest())
    return out


def test_edited_texts_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 7)
    rng = random.Random(3)
    ids = rng.sample(range(10**12), 60) + rng.sample(range(1000), 60)
    rows = [(d, "".join(rng.choices("ab \n.é\U0001f600", k=rng.randint(0, 50)))) for d in ids] + [(-5, None), (None, "null id é")]
    df = spark.createDataFrame([(*r, "x") for r in rows], COLUMNS + ", vector string")
    got = P.edited_texts(df).select("doc_id", "n_chars", F.sha2("edited", 256).alias("e"),
                                    P.likeness(F.col("vector"), F.col("next_vector")).alias("n")).collect()
    assert {r.doc_id: (r.n_chars, r.e) for r in got} == expected(rows) and len(got) == len(rows)
    assert all(0 <= r.n <= 1 for r in got)


def test_single_row_equal_ids_and_empty_table(spark):
    one = spark.createDataFrame([(1, "abcd")], COLUMNS)
    r = P.edited_texts(one).first()
    assert (r.edited, r.vector == r.next_vector) == ("abab", True)
    two = spark.createDataFrame([(1, "abcd"), (1, "efgh"), (1, "efgh")], COLUMNS)
    assert P.edited_texts(two).count() == 3
    assert P.edited_texts(one.limit(0)).count() == 0


def test_likeness_of_thousands_of_pieces(spark):
    rng = random.Random(4)
    pool = [f"piece {rng.random()}" for _ in range(60_000)]
    cases = [(3000, 2400, 600), (1600, 800, 50), (5000, 2500, 50), (30_000, 15_000, 15_000), (3000, 0, 3000), (700, 350, 350)]
    texts = [x for n, common, new in cases for x in ("\n".join(pool[:n]), "\n".join(pool[:common] + pool[30_000:30_000 + new]))]
    v = vectors(spark, texts)
    df = spark.createDataFrame([(v[2 * i][0], v[2 * i + 1][0], common / (n + new)) for i, (n, common, new) in enumerate(cases)],
                               "a array<long>, b array<long>, want double")
    for r in df.withColumn("got", P.likeness(F.col("a"), F.col("b"))).collect():
        assert abs(r.got - r.want) < 0.13, (r.got, r.want)
