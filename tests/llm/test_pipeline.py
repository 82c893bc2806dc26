"""The pipeline against the same stages written plainly."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest

import public_tokenizers
from arborlake.llm import common
from arborlake.llm.simhash import similar_documents
from test_llm import ODD, SF, slow_contamination
from test_near_copies import least_linked


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    rows = []
    for i in range(80):
        text = [word() for _ in range(400)]
        rows.append((2 * i, " ".join(text)))
        text[rng.randrange(400)] = "changed"
        rows.append((2 * i + 1, " ".join(text) if i < 40 else " ".join(word() for _ in range(400))))
    got = dict(map(tuple, similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert all(got[2 * i] == 2 * i for i in range(80)) and all(got[2 * i + 1] == 2 * i + 1 for i in range(40, 80))
    assert sum(got[2 * i + 1] == 2 * i for i in range(40)) >= 34


def test_stages_and_run(spark, tmp_path):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k == 0:
            assert kept == {i: t for i, t in rows.items() if any(c.isalpha() for c in t)}
        if k == 1:
            root = least_linked(rows)
            assert kept == {i: t for i, t in rows.items() if root[i] == i} and len(kept) < len(rows)
        if k == 3:
            assert kept == {i: t for i, t in rows.items() if not slow_contamination(t, items)[-1]}
        rows = kept
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert pieces.keys() == rows.keys()
    for i, text in rows.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for start, length, crc in sorted(pieces[i]):
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, removed string, row_key long, id_key string, lang_pred string, score double, doc_tokens long, kept_id long, hit_runs long"


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = random.Random(15)
    own = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(6)]
    texts = [*ODD, (7, own[0]), (7, own[1]), (None, own[2]), (None, own[3]), (None, own[3]), (30, own[4]), (30, own[4]), (31, own[4] + " end"), (40, own[5] + " w" * 60_000)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", 1, "k", "p", 0.5, 2, 3, 4) for i, t in texts], CLASHING)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows_and_empty_tables(spark, odd_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    none = stage(spark, odd_docs.filter("false"), SF)
    assert none.count() == 0
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    out = stage(spark, odd_docs, SF)
    got = sorted(((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()), key=str) if name != "packing" else out.collect()
    if name == "language":
        assert got == sorted([x for x in rows if any(c.isalpha() for c in x[1] or "")], key=str) and out.columns == odd_docs.columns
    if name == "near_dedup":
        own = [x for x in rows if x[0] in (7, 40) or (x[0] is None)]
        assert set(own) <= set(got) and len(got) == len(set(got)) and (31, rows[-2][1]) not in got and (30, rows[-3][1]) in got
        assert sum(not (t or "").split() for _, t in got) == 1 and out.columns == odd_docs.columns
    if name == "substring_dedup":
        assert {(i, t) for i, t in rows if not (t or "").strip()} <= set(got) and (7, rows[11][1]) in got
        assert out.columns == [c for c in odd_docs.columns if c != "removed"]
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    if name == "decontamination":
        assert got == sorted(rows, key=str) and out.columns == odd_docs.columns
    if name == "packing":
        assert {r["doc_id"] for r in got} == {i for i, _ in rows} and sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
        assert sum(r["start"] == 0 for r in got) == len(rows)


def test_language_with_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "words here", None), (2, None, None), (3, "12 34", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()] == [1]
