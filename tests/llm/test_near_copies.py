"""Near copies against exact Jaccard similarity, and rows that share an id."""

import random

import corpus_pipeline
import pytest
import xxhash

from arborlake.llm import common
from arborlake.llm.simhash import similar_documents, similar_rows
from test_llm import SF


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def least_linked(texts, similarity=0.8):
    """doc_id -> smallest id of its component, comparing all pairs."""
    ids, root = sorted(texts), {i: i for i in texts}
    sets = {i: shingle_set(texts[i]) for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(5), {}
    for i in range(60):  # pairs from about 0.7 to 0.95
        text = words(rng, 400)
        out[len(out)] = " ".join(text)
        for at in rng.sample(range(0, 400, 8), 2 + i % 13):
            text[at] = "changed"
        out[len(out)] = " ".join(text)
    base = words(rng, 300)
    for _ in range(60):  # a group whose members are partly linked through others only
        text = list(base)
        for at in rng.sample(range(0, 300, 8), rng.randrange(1, 8)):
            text[at] = "other" + str(rng.randrange(50))
        out[len(out)] = " ".join(text)
    return out | {1000: "", 1001: None, 1002: "one two"}


def test_pairs_at_the_bound_are_linked_and_others_left(spark, texts):
    got = dict(map(tuple, similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()))
    want = least_linked(texts)
    assert got == want and 20 < sum(want[i] != i for i in range(120)) < 60


@pytest.mark.parametrize("block", [3, 16])
def test_groups_are_compared_in_small_blocks(spark, texts, block):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = similar_rows(df, block=block).collect()
    least = {}
    for r in rows:
        least[r["component"]] = min(r["doc_id"], least.get(r["component"], r["doc_id"]))
    assert {r["doc_id"]: least[r["component"]] for r in rows} == least_linked(texts)


def test_near_copies_of_the_smallest_tables(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text")
    got = dict(map(tuple, similar_documents(docs).collect()))
    assert got == least_linked(dict(map(tuple, docs.collect())))


def test_rows_that_share_an_id_or_have_none_stay(spark):
    rng = random.Random(7)
    own = [" ".join(words(rng, 60)) for _ in range(8)]
    copy = own[1] + " more"
    rows = [(7, own[0]), (7, own[1]), (7, own[2]), (None, own[3]), (None, own[4]), (None, own[4]), (3, copy), (9, own[5]), (9, own[5]), (12, own[0] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str)
    assert got == sorted([(7, own[0]), (7, own[2]), (3, copy), (None, own[3]), (None, own[4]), (9, own[5])], key=str)


def test_fingerprints_alone_link_what_they_find(spark):
    rng, out = random.Random(21), {}
    for i in range(40):
        text = words(rng, 1000)
        out[len(out)] = " ".join(text)
        for at in rng.sample(range(0, 1000, 8), 1 + i % 20):
            text[at] = "changed"
        out[len(out)] = " ".join(text)
    of = {i: slow_print(shingle_set(t)) for i, t in out.items()}
    near = {(i, j) for i in of for j in of if i < j and (of[i] ^ of[j]).bit_count() <= 3}
    found = {}
    for r in similar_rows(spark.createDataFrame(list(out.items()), "doc_id long, text string"), bands=0).collect():
        found.setdefault(r["component"], []).append(r["doc_id"])
    assert {tuple(sorted(c)) for c in found.values() if len(c) > 1} == near and 5 < len(near) < 40


def slow_print(units):
    hashes = [xxhash.xxh64_intdigest(u, 42) for u in units]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
