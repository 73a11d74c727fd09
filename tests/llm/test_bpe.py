"""BPE round trips and token counts against the tokenizers library."""

import os
import random

import pytest

from sieveline.llm import bpe, token_counts, vocab

PATH = vocab.default_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return vocab.Coder(vocab.load(PATH))


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "\n\n", "a", "Hello world's end", "x<|endoftext|>y <|endoftext|>", "!!<|endoftext|>''s",
         "tab\t\tspace   end  ", "né ñandú 東京 \U0001f600\U0001f468‍\U0001f469", "12345 6 a1b2", "a" * 5000,
         " " * 700 + "x", "\n \t " * 50, "<|endoftext|", "\x00\x1c\x1f\x85\u180e\u200b\u3000x", "ab" * 3000 + " tail "]


def test_every_character_splits_like_the_library(coder, library):
    rng = random.Random(0)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    chosen = [c for c in points if c < 0x3000] + rng.sample(points, 4000)
    for i in range(0, len(chosen), 500):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}b" for c in chosen[i:i + 500])
        assert coder.encode(text) == ids_of(library, text)
        assert [p for x, s in coder.parts(text) for p in coder.pretokens(x)] == [
            text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_segments_join_to_the_same_ids(coder, library, size):
    rng = random.Random(size)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "'s", "1", "!", "é", "東", "<|endoftext|>", "zzzz", "\t"]
    made = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(300)]
    for text in TEXTS + made:
        runs = []
        for kind, piece in bpe.cut(coder, text, size):
            ids = bpe.encode_segment(coder, "token" if kind == "more" else kind, piece)
            runs[-1].append(ids) if kind == "more" else runs.append([ids])
        assert [i for r in runs for i in bpe.join_all(coder, r)] == ids_of(library, text), repr(text)


def test_window_grows_until_both_sides_agree(coder):
    text = "".join(random.Random(3).choices("etaoinshr", k=20_000))
    whole = coder.merge(text)
    for at in (1, 777, 10_001, 19_999):
        assert bpe.join(coder, coder.merge(text[:at]), coder.merge(text[at:]), window=1) == whole


def frame(spark, texts):
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")


def test_encode_decode_operator(spark, library):
    long = " ".join(random.Random(1).choices(["alpha", "beta's", "12", "\n", "q" * 300], k=400))
    texts = [*TEXTS, None, long, long, "w" * 3000, " " * 2000 + long]
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(frame(spark, texts), segment_chars=256)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = ids_of(library, t or "")
        assert bpe.unpack(bytes(got[i].token_ids)) == want
        assert got[i].n_tokens == len(want)
        assert got[i].decoded_text == library.decode(want, skip_special_tokens=False) == (t or "")


def test_decode_replaces_broken_bytes(spark, library, coder):
    ids = [coder.merge("é".encode())[0], *coder.merge(b"\xe6\x9d"), 50256, *coder.merge(b"\xff a")]
    df = spark.createDataFrame([(1, bytearray(bpe.pack(ids))), (2, None)], "doc_id long, token_ids binary")
    got = {r.doc_id: r.decoded_text for r in bpe.decode(df).collect()}
    assert got == {1: library.decode(ids, skip_special_tokens=False), 2: ""}


def test_token_counts(spark, library):
    texts = [*TEXTS, None, TEXTS[5]]
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, texts)).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == [len(ids_of(library, t or "")) for t in texts]
    assert got[3].n_whole == 1 and got[0].n_whole == 0
    assert token_counts.count_tokens(frame(spark, [])).count() == 0
    assert bpe.encode(frame(spark, [])).count() == 0


def test_whole_tokens_are_proved(library):
    whole = vocab.load(PATH).whole_tokens()
    assert 49_000 < len(whole) < 50_257
    sample = random.Random(2).sample(sorted(whole), 3000)
    assert all(len(e.ids) == 1 for e in library.encode_batch(sample, add_special_tokens=False))


def test_count_table_stays_bounded(coder):
    counts = token_counts._Counts(frozenset({"a"}), coder.merge)
    for i in range(token_counts.KEPT_COUNTS + 10):
        counts[f"qz{i}"]
    assert len(counts) <= token_counts.KEPT_COUNTS + 1 and counts["a"] == 1


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_registered_queries(spark, library):
    import hashlib

    from sieveline.llm.catalog import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe"](spark, SF).collect():
        ids = ids_of(library, texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(bpe.pack(ids)).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in QUERIES["op9_token_counts"](spark, SF).collect():
        n = len(ids_of(library, texts[r.doc_id]))
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 512, len(texts[r.doc_id].encode()))
