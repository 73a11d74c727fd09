"""Quality metrics against brute force, adaptive fences, and defined edge cases."""

import collections
import random
import re

from sieveline.llm import quality as Q

COLUMNS = "doc_id long, text string, lang string, source string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + d for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1
               for d in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
            "n_shouts": text.count("!")}


def texts():
    rng = random.Random(1)
    made = [" ".join(rng.choices(["a", "b", "c", "dé", "東京!", "#x", "\n", "\t"], k=rng.randint(0, 40)))
            for _ in range(150)]
    return [*made, "", None, " \n\t ", "one", "a b", "a b c a b c", "x " * 5000, "\U0001f600    w",
            "\x1c \x85", "same\nsame\n same\n\n\n", "a a a a"]


def test_metrics_match_brute_force(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in Q.measure(spark.createDataFrame(rows, COLUMNS)).collect()}
    for i, t, _, _ in rows:
        assert {m: got[i][m] for m in Q.METRICS} == brute(t), repr(t)


def corpus(rng, n, junk=0.1):
    out = []
    for i in range(n):
        lang, source = rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", "b", None])
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(60, 120))]
        kind = "clean"
        if rng.random() < junk:
            kind = rng.choice(["symbols", "shouts"])
            words = [w + ("###" if kind == "symbols" else "!!") for w in words]
        out.append((i, " ".join(words), lang, source, kind))
    return out


def test_adaptive_fences_reject_junk_and_keep_clean(spark):
    rows = corpus(random.Random(3), 400)
    df = spark.createDataFrame([(*r[:4], r[4], 5) for r in rows], COLUMNS + ", kind string, n_words int")
    got = Q.quality_rules(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.kept == (r.kind == "clean") and r.failed_rules == ([] if r.kind == "clean" else [r.kind])


def test_fences_follow_the_group(spark):
    """Symbols that are normal in one source are odd in another."""
    rng = random.Random(4)
    table = " ".join(f"c{i} |" for i in range(60))
    plain = [" ".join(f"w{rng.random()}" for _ in range(80)) for _ in range(30)]
    rows = ([(i, table + f" z{i}", "en", "tables") for i in range(30)] + [(100 + i, t, "en", "prose") for i, t in enumerate(plain)]
            + [(200, table, "en", "prose")])
    kept = {r.doc_id: r.kept for r in Q.quality_rules(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert not kept.pop(200) and all(kept.values())


def test_sketches_merge_and_stay_small(spark):
    rows = corpus(random.Random(5), 300)
    df = spark.createDataFrame([r[:4] for r in rows], COLUMNS)
    bins = Q.sketches(Q.measure(df))
    whole = {tuple(r[:5]): r.n for r in bins.collect()}
    merged = collections.Counter()
    for part in (df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1")):
        for r in Q.sketches(Q.measure(part)).collect():
            merged[tuple(r[:5])] += r.n
    assert whole == dict(merged)
    for _, _, _, low, high in whole:
        assert high - low <= max(0, low / 2 ** (Q.BIN_BITS - 1))


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a " * 60, "en", "s")] * 3 + [(None, None, None, None)], COLUMNS)
    assert Q.quality_rules(df.limit(0)).count() == 0
    got = Q.quality_rules(df).collect()
    assert len(got) == 4 and all(r.base_failed and not r.kept for r in got)


def test_junk_in_small_and_hot_groups_is_rejected(spark):
    """A tail of sources with up to three documents, all junk, and a hot source that is two fifths junk."""
    rng = random.Random(6)
    clean = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(80))
    junk = lambda: clean().replace(" ", "### ")
    rows = [(i, junk() if i % 5 < 2 else clean(), "en", "hot") for i in range(200)]
    rows += [(1000 + i, junk(), "en", f"tail{i // 3}") for i in range(30)] + [(2000, junk(), "xx", "one"), (2001, clean(), "xx", "two")]
    got = {r.doc_id: r.kept for r in Q.quality_rules(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {d: "#" not in t for d, t, _, _ in rows}
