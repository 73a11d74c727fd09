"""The pipeline on a small corpus, stage by stage and against the operators' definitions; entry guard."""

import os
import random
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as C
    from sieveline.llm import common
    docs = common.read(spark, SF, "documents")
    out = [("documents", docs)]
    for name, stage in C.STAGES:
        docs = common.written(stage(spark, docs, SF), "test-pipeline")
        out.append((name, docs))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert len(stages) == 6
    for _, df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_and_dedup_stages(stages):
    from .test_line_dedup import pieces_of
    from .test_near_dups import brute
    docs, good, lines, unique = ([(r.doc_id, r.text) for r in df.collect()] for _, df in stages[:4])
    assert set(good) < set(docs)
    text = dict(good)
    def pieces(t):
        return [x.strip(" ") for x, _ in pieces_of(t, True) if x.split()]
    for d, t in lines:
        left = iter(pieces(text[d]))
        assert all(x in left for x in pieces(t)) and t.split()  # a subsequence of its pieces
    gone = set(text) - {d for d, _ in lines}
    first = {x for d, t in good if d not in gone for x in pieces(t)}
    assert all(set(pieces(text[d])) <= first for d in gone)
    assert sorted(d for d, _ in unique) == sorted({c for _, c in brute(lines).values()})


def test_mixing_and_encoding_stages(stages):
    from tokenizers import Tokenizer

    from sieveline.llm import bpe, vocab
    unique, mixed = ([r.asDict() for r in df.collect()] for _, df in stages[3:5])
    size = {r["doc_id"]: len(r["text"].split()) for r in unique}
    taken = {}
    for r in mixed:
        assert r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].split())
    assert all(n <= 2 * size[d] for d, n in taken.items())
    total = sum(size.values())
    assert abs(sum(taken.values()) - 1.5 * total) <= 25 + 0.01 * total
    library = Tokenizer.from_file(vocab.default_path())
    want = sorted((r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in mixed)
    assert sorted((r.doc_id, bpe.unpack(bytes(r.token_ids))) for r in stages[5][1].collect()) == want


def test_run_equals_the_stages(spark, stages):
    import corpus_pipeline as C
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in df.collect())
    assert key(C.run(spark, SF)) == key(stages[5][1])


def test_edge_tables(spark):
    import corpus_pipeline as C
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(200))
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, None, None, None, None), (None, long + " x", None, None, 0), (3, "", "en", "s", 0)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in C.STAGES:
            docs = stage(spark, docs, SF)
        got = docs.collect()
        assert {r.doc_id for r in got} <= {1, None} and bool(got) == bool(data)


def test_line_stage_cuts_a_text_once(spark):
    """Time grows with the number of pieces; before, each piece that is kept cut the text anew."""
    import time

    import corpus_pipeline as C
    n = 12000
    texts = [" ".join(f"w{k} x{k}." for k in range(n)), " ".join(f"w{k} {'x' if k % 50 < 25 else 'y'}{k}." for k in range(n))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    start = time.time()
    got = {r.doc_id: r for r in C.dedup_lines(spark, docs, SF).collect()}
    assert time.time() - start < 60
    assert got[0].text == texts[0] and got[1].text == " ".join(f"w{k} y{k}." for k in range(n) if k % 50 >= 25)
    assert got[1].n_chars == len(got[1].text)


@pytest.mark.parametrize("blocked", ["sieveline.llm", "corpus_pipeline"])
def test_entry_without_the_folders(blocked):
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            f"        if name == {blocked!r} or name.startswith({blocked!r} + '.') or name == 'corpus_pipeline':\n"
            "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "q = e.queries(); assert 'dashboard_stats' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)\n"
            f"assert any(n.startswith('op1_') for n in q) == ({blocked!r} == 'corpus_pipeline')\n")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_last_plans_of_the_document_and_mixing_stages_are_small(spark):
    """The driver holds a plan as long as it runs; before, the texts' joins stood in one plan with all that decides what
    is kept or taken."""
    import corpus_pipeline as C
    docs = spark.createDataFrame([(d, f"a{d} b{d} c{d} d{d} e{d} f{d}", "en", "s", 20) for d in range(9)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for stage, step in ((C.dedup_documents, "HashAggregate"), (C.mix_sources, "Window")):
        plan = stage(spark, docs, SF)._jdf.queryExecution().sparkPlan()
        kinds = [plan.p(i).nodeName() for i in range(plan.treeString().count("\n"))]
        joins = [k for k in kinds if "Join" in k]
        assert len(joins) == 1 and step not in kinds, kinds


def test_driver_does_not_hold_the_vocabulary(spark, monkeypatch):
    """A task takes the file apart, once for all stages; before, the driver made the vocabulary's 50,000 entries and sent
    them for each of encode and decode."""
    from sieveline.llm import bpe, vocab

    def on_the_driver(*_):
        raise AssertionError("made on the driver")
    vocab.load.cache_clear()
    vocab._SHARED.clear()
    monkeypatch.setattr(vocab.Vocabulary, "__init__", on_the_driver)
    df = spark.createDataFrame([(1, "Hello wörld"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.decoded_text for r in bpe.decode(bpe.encode(df)).collect()}
    assert got == {1: "Hello wörld", 2: ""}
    assert vocab.share(spark, None) is vocab.share(spark, None)


def test_refused_vocabulary_is_an_error_of_the_caller(spark, tmp_path):
    import json

    from sieveline.llm import vocab
    with open(vocab.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="byte-level"):
        vocab.share(spark, str(tmp_path / "other.json"))
