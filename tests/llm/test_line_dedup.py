"""Line dedup against a brute-force version of its guarantee."""

import random
import re

import pytest

from sieveline.llm import line_dedup as L

MIN = 6


WS = " \t\x0b\x0c\r"


def words(line):
    return [w for w in re.split(f"[{WS}\n]+", line) if w]


def pieces_of(text, inside):
    """Pieces (text, number of line): lines, cut after sentence ends and at bars where ``inside``."""
    out = []
    for n, line in enumerate((text or "").split("\n") if text is not None else []):
        parts = re.split(rf"(?<=[.!?|][{WS}])|(?<=[。！？])|(?=[{WS}]\|)", line) if inside else [line]
        # Java leaves no empty piece at the front of a match of no width.
        parts = parts[1:] if len(parts) > 1 and parts[0] == "" else parts
        out += [(x, n) for x in parts]
    return out


def brute(docs, min_words, inside):
    """{doc: (lines with words as (number of piece, text), places among them that go)} from the guarantee alone: every
    run of ``min_words`` words that stands, line by line, at an earlier place."""
    seen, out = set(), {}
    for d in sorted(docs):
        rows = [(i, x.strip(" "), len(words(x))) for i, (x, _) in enumerate(pieces_of(docs[d], inside))]
        rows = [r for r in rows if r[2] and not (inside and r[1] == "|")]
        gone = set()
        for a in range(len(rows)):
            n = 0
            for b in range(a, len(rows)):
                n += rows[b][2]
                if n >= min_words:
                    key = tuple(x for _, x, _ in rows[a:b + 1])
                    if key in seen:
                        gone |= set(range(a, b + 1))
                    seen.add(key)
        out[d] = rows, gone
    return out


def run(spark, docs, min_words=MIN, inside=True):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id long, text string, n_lines string")
    return {r.doc_id: r for r in L.dedup_lines(df, min_words=min_words, inside=inside).collect()}


def check(spark, docs, min_words=MIN, inside=True):
    got = run(spark, docs, min_words, inside)
    for d, (rows, gone) in brute(docs, min_words, inside).items():
        pieces = pieces_of(docs[d], inside)
        removed = {i for r in got[d].removed_runs for i in range(r["from"], r["to"] + 1)}
        where = {i: k for k, (i, _, _) in enumerate(rows)}
        assert {where[i] for i in removed if i in where} == gone, (d, docs[d])
        for i in removed - set(where):  # a bar or a line without words goes only between deleted lines
            assert max((k for j, k in where.items() if j < i), default=-1) in gone
            assert min((k for j, k in where.items() if j > i), default=-1) in gone
        left = [(x, n) for i, (x, n) in enumerate(pieces) if i not in removed]
        text = "".join(("\n" if k and left[k - 1][1] != n else "") + x for k, (x, n) in enumerate(left))
        assert got[d].text == (None if docs[d] is None else text if removed else docs[d])
        assert got[d].n_removed == len(removed)
    return got


@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_random_documents_match_the_guarantee(spark, inside, seed):
    rng = random.Random(seed)
    end = ["", "", ".", "!", " |", "。", ".\t"]
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) + rng.choice(end) for _ in range(12)] + ["", "  ", "a  b", "|"]
    passages = [[rng.choice(pool) for _ in range(rng.randint(2, 6))] for _ in range(6)]
    docs = {}
    for d in range(70):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [f"u{d} " + rng.choice(pool)]
        docs[d] = "".join(x + rng.choice(["\n", "\n", " "]) for x in parts)
    docs |= {100: None, 101: "", 102: "one. " * 9, 103: "\n".join(["same line of text"] * 7)}
    check(spark, docs, inside=inside)


@pytest.mark.parametrize("inside", [True, False])
def test_lines_that_only_stand_elsewhere_stay(spark, inside):
    """Two lines that each occur once in two unrelated documents and stand side by side in a third."""
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(14))
    docs = {}
    for k in range(40):
        a, b = line(), line()
        docs |= {3 * k: f"{line()}\n{a}\n{line()}", 3 * k + 1: f"{line()}\n{b}\n{line()}", 3 * k + 2: f"{line()}\n{a}\n{b}\n{line()}"}
    got = check(spark, docs, 25, inside)
    assert all(r.n_removed == 0 for r in got.values())


def test_a_passage_of_many_lines_in_its_second_place(spark):
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(rng.randint(1, 9)))
    passage = "\n".join(line() for _ in range(30))
    docs = {1: f"{line()}\n{passage}\n{line()}", 2: f"{line()} x\n{passage}\n{line()} y", 3: passage, 4: f"{passage}\n{passage}"}
    got = check(spark, docs, 25)
    assert got[1].n_removed == 0 and got[2].n_removed == 30 and got[3].text == "" and got[4].text == ""


def test_guarantee_first_place_stays_and_unique_lines_stay(spark):
    passage = "one two three\nfour five\n\nsix seven eight nine"
    docs = {1: f"intro here\n{passage}\nend of one", 2: f"other\n{passage}", 3: f"{passage}\nnew line\n{passage}\nlast",
            4: "short line", 5: "short line", 6: None, 7: "", 8: " \n\t\n", 9: passage}
    got = check(spark, docs)
    assert got[1].text == docs[1] and got[2].text == "other" and got[3].text == "new line\nlast"
    assert got[4].text == got[5].text == "short line" and got[6].text is None and got[9].text == ""
    assert got[6].n_lines == 0 and got[1].n_lines == 6


def test_equal_rows_null_ids_and_empty_table(spark):
    long = "a b c d e f g h"
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long + "\nz")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in L.dedup_lines(df, min_words=MIN).collect())
    assert got == [(0, ""), (1, long), (1, long), (2, "z")]
    assert L.dedup_lines(df.limit(0), min_words=MIN).count() == 0


def test_hot_line_and_long_document(spark):
    hot = "this very common line has more than six words"
    docs = {d: f"unique {d}\n{hot}" for d in range(300)} | {1000: "\n".join(f"w{i}" for i in range(3000))}
    got = run(spark, docs)
    assert got[0].n_removed == 0 and all(got[d].text == f"unique {d}" for d in range(1, 300))
    assert got[1000].n_removed == 0


def test_passages_inside_longer_lines(spark):
    """Glued to half a sentence, or between table cells; what is left keeps its separators."""
    passage = "One two three four. Five six seven! Eight nine ten."
    docs = {1: f"intro\n{passage}", 2: f"and a half {passage} Then  more.\tEnd", 3: f"a | b | {passage} | c\nlast. line", 4: "x. y | z!  w\n"}
    got = run(spark, docs)
    assert got[1].text == docs[1] and got[4].text == docs[4]
    assert got[2].text == "and a half One two three four. Then  more.\tEnd"
    assert got[3].text == "a | b |  | c\nlast. line"


@pytest.mark.parametrize("inside", [True, False])
def test_pieces_of_whole_texts_are_those_of_lines(spark, inside):
    """Cut in one go, or line by line where the text has the mark itself."""
    rng = random.Random(5)
    texts = ["", " |", "\n |", "x. |", "x.\n|", "x. \n", "a。 |b", "| |\n| |", "。\n。", "a |\x01b. c\n d"]
    texts += ["".join(rng.choices(" \t\x0b\r\n.|。！x?" + "\x01" * (k % 2), k=rng.randint(1, 30))) for k in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "__text string").coalesce(2)
    rows = df.selectExpr("__text", f"{L._pieces(inside, False)} AS a", f"{L._pieces(inside, True)} AS b").collect()
    for t, a, b in rows:
        want = pieces_of(t, inside)
        assert a == [x for x, _ in want], repr(t)
        assert b == ["\n" * (k > 0 and want[k - 1][1] != n) + x for k, (x, n) in enumerate(want)], repr(t)


def test_odd_white_space_and_marks_in_repeated_passages(spark):
    rng = random.Random(8)
    pool = ["one two three.", "a\tb  c", "| x |", "mark\x01ed words here", "\x0b", "vier。fünf", " ", "|", "e f\r", ""]
    docs = {d: "".join(rng.choice(pool) + rng.choice(["\n", " ", "  "]) for _ in range(rng.randint(3, 25))) for d in range(60)}
    got = check(spark, docs)
    assert sum(r.n_removed for r in got.values()) > 50


def test_windows_are_shuffled_once_and_nothing_is_written(spark):
    """By key, then by document, with the texts; before, nine shuffles and three written tables."""
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = L.dedup_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "FileScan" not in plan


@pytest.mark.parametrize("inside", [True, False])
def test_pieces_with_and_without_bars_and_wide_ends(spark, inside):
    """Each mix of the characters that decide how a text is cut, the mark among them."""
    rng = random.Random(6)
    texts = ["".join(rng.choices(" \n.x" + "".join(c for b, c in enumerate("|？！。\x01\t") if k >> b & 1), k=rng.randint(1, 25)))
             for k in range(640)]
    df = spark.createDataFrame([(t,) for t in texts], "__text string").coalesce(2)
    rows = df.selectExpr("__text", f"{L._pieces(inside, False)} AS a", f"{L._pieces(inside, True)} AS b").collect()
    for t, a, b in rows:
        assert a == [x for x, _ in pieces_of(t, inside)] and "".join(b) == t, repr(t)


def windows_of(text, min_words):
    """[(first, last piece)] of the shortest windows from each line on, and up to each line."""
    rows = [(i, len(words(x))) for i, (x, _) in enumerate(pieces_of(text, True)) if words(x) and x.strip(" ") != "|"]
    spans = {(a, b) for a in range(len(rows)) for b in range(a, len(rows)) if sum(n for _, n in rows[a:b + 1]) >= min_words}
    return sorted((rows[a][0], rows[b][0]) for a, b in spans if (a, b - 1) not in spans or (a + 1, b) not in spans)


def test_each_window_is_made_once_outside_of_loops_over_words(spark):
    """The keys of all windows are made from rows; before, in a loop over arrays that is not compiled, then made distinct."""
    rng = random.Random(7)
    texts = ["".join(f"{rng.choice('abc')}" + rng.choice([" ", " ", ". ", "\n", "。", " | "]) for _ in range(rng.randint(0, 40)))
             for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "__id long, __text string").selectExpr("*", "xxhash64(__text) AS __hash")
    found = {}
    for r in L.windows(df.coalesce(2), MIN).collect():
        found.setdefault(r["__id"], []).append((r["at"] >> 32, r["at"] & 0xFFFFFFFF))
    assert {k: sorted(v) for k, v in found.items()} == {k: w for k, t in enumerate(texts) if (w := windows_of(t, MIN))}
    plan = L.windows(df)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Generate ", 1)
    assert "xxhash64(slice(" in above and "xxhash64(slice(" not in below and "array_distinct" not in plan
    assert re.search(r"\*\(\d+\) $", above) and "Filter" not in above and "flatten" not in below.split("\n")[0]
