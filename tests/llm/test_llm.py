"""The corpus operators against brute force, on small tables with the odd cases."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from arborlake.llm import common, decontaminate, language, lcp_merge, packing, permutation_index, quality, sharding, simhash, simhash_bits, substring_dedup, suffix_dedup, token_files, tokenization

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row_key long, removed string, n_words string"
BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9.0, 7, "x", "y") for i, t in rows], DOCS)


ODD = [(1, "Hello there world, hello again."), (2, None), (3, ""), (4, "  \n\n "), (None, "no id here"), (5, "same text twice"), (5, "same text twice"), (6, "é" * 3000), (7, "a  b\t c <|endoftext|> it's 12,5\n\n x"), (8, "…“quotes” — ﬁ 日本語 \U0001f600 x")]


@pytest.fixture(scope="module")
def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_piecewise_ids_are_the_ids_of_the_text(plain_tokenizer):
    rng = random.Random(1)
    mine = tokenization.TextEncoder(BPE, limit=50)
    parts = ["the", " ", "  ", "\n", "\t", " \n ", "don't", "Öl", "x.", "12", "ǅ", "ʼ", "¿que?", "\x1c", " ", "日本", "a,b", "!?", "<|endoftext|>", "end.\nNext", "\nline", "stop!!", ",", ".\n", "\r", "\u3000", "\x85", "12.\n12", "'s"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == plain_tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_special_tokens_and_other_tokenizers(tmp_path, plain_tokenizer):
    ids = lambda e, t: np.frombuffer(e.encode(t), "<u4").tolist()
    mine = tokenization.TextEncoder(BPE)
    assert ids(mine, "a <|endoftext|> b") == [64, 220, 50256, 275] == plain_tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert mine.piecewise
    settings = json.loads(plain_tokenizer.to_str())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": settings["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": settings["model"] | {"dropout": 0.0, "end_of_word_suffix": "x"}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(settings | change))
        from tokenizers import Tokenizer

        other = tokenization.TextEncoder(str(path))
        assert not other.piecewise
        text = "Hello There, wide  WORLD. It's 12,5 x"
        assert ids(other, text) == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def test_levels_give_random_access():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 3_000_000, 4000)
    ids[::3] %= 200
    segment = token_files.Segment(token_files.encode_levels(ids))
    assert [segment[i] for i in range(4000)] == ids.tolist() and segment.range(17, 3821).tolist() == ids[17:3821].tolist()
    assert len(token_files.Segment(token_files.encode_levels(np.zeros(0, dtype=int)))) == 0


def test_token_files_round_trip(spark, plain_tokenizer):
    path = common.scratch_path(spark, "t")
    token_files.write_token_files(docs(spark, ODD).repartition(3), path, BPE, segment_tokens=500)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, path).collect()]
    at, want = 0, []
    for i, t in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.array(plain_tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want


def test_single_tokens_of_the_data_set(spark, plain_tokenizer):
    rows = [(1, "Hello there world"), (2, "x " * 700), (None, "first by its null id"), (2, "another text of id two"), (9, ""), (9, None)]
    path = common.scratch_path(spark, "t")
    token_files.write_token_files(docs(spark, rows).repartition(3), path, BPE, segment_tokens=5)
    places = token_files.read_token_files(spark, path).collect()
    assert spark.read.parquet(path).count() > 3
    by_crc = {zlib.crc32(np.array(ids, dtype="<u4").tobytes()): ids for ids in (plain_tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows)}
    every = [i for r in sorted(places, key=lambda r: r["start"]) for i in by_crc[r["ids_crc32"]]]
    assert sum(len(by_crc[r["ids_crc32"]]) for r in places) == len(every) > 700
    asked = [0, 1, 5, 6, 300, len(every) - 1]
    assert [token_files.token_at(spark, path, p) for p in asked] == [every[p] for p in asked]
    for p in (-1, len(every)):
        with pytest.raises(IndexError):
            token_files.token_at(spark, path, p)
    many = spark.createDataFrame([(p,) for p in [*range(-3, len(every) + 3), 5, 5]] + [(None,)], "position long")
    assert dict(map(tuple, token_files.tokens_at(spark, path, many).collect())) == dict(enumerate(every))


def test_one_id_is_dealt_to_several_ranges(spark):
    rows = [(7, f"text number {i}") for i in range(400)] + [(1, "one"), (9, "nine")]
    path = common.scratch_path(spark, "t")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        token_files.write_token_files(docs(spark, rows).repartition(4), path, BPE)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [1, *[7] * 400, 9] and len({r["part"] for r in got if r["doc_id"] == 7}) == 2
    assert [r["start"] for r in got[1:]] == [r["start"] + r["n_tokens"] for r in got[:-1]]


def test_very_long_texts(spark, plain_tokenizer):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9)))
    long = " ".join(word() for _ in range(250_000)) + ".\n" + "no blanks" * 2_000
    tail = long[-30_000:]
    rows = [(1, long), (2, "short one"), (3, tail), (4, long[600_000:601_000])]
    d = docs(spark, rows)
    path = common.scratch_path(spark, "t")
    token_files.write_token_files(d, path, BPE, segment_tokens=1000)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, path).collect()}
    for i, t in rows:
        ids = np.array(plain_tokenizer.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))
    out = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(d).collect()}
    assert out[3]["n_removed"] == 30_000 and out[4]["n_removed"] == 1000 and out[2]["n_removed"] == 0 and 31_000 <= out[1]["n_removed"]
    texts = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(d).collect()}
    assert texts[1] == long and texts[2] == "short one" and len(texts[3]) < 30_000
    assert {r["doc_id"]: r["score"] is not None for r in quality.score_quality(d, quality.RuleModel(0.3)).collect()} == dict.fromkeys((1, 2, 3, 4), True)
    bench = spark.createDataFrame([("a", long[1_000_000:1_000_400]), ("b", "nothing here")], "item_id string, text string")
    report = {r["doc_id"]: r for r in decontaminate.contamination_report(decontaminate.find_contamination(d, bench)).collect()}
    want = slow_contamination(long[999_000:1_002_000], [("a", long[1_000_000:1_000_400])])
    assert report[1]["contaminated"] and report[1]["n_hit"] >= want[1] > 50 and not report[2]["contaminated"]
    said = {r["doc_id"]: r["lang_pred"] for r in language.identify(d, language.learn_profiles(d.withColumn("lang", F.when(F.col("doc_id") == 1, "x").otherwise("y")))).collect()}
    assert said[1] == "x" and set(said) == {1, 2, 3, 4}


def test_empty_tables(spark):
    none = docs(spark, [])
    path = common.scratch_path(spark, "t")
    token_files.write_token_files(none, path, BPE)
    assert token_files.read_token_files(spark, path).count() == 0
    assert packing.pack_documents(none, BPE).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert sharding.assign(none, sharding.layout(24), sharding.layout(25)).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert language.learn_profiles(none) == {} and language.identify(none, {}).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(none, quality.learn_quality(none, labels)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert permutation_index.nearest(vectors, vectors).count() == 0


def test_packing_covers_every_id_once(spark, plain_tokenizer):
    rng = random.Random(2)
    rows = ODD + [(100 + i, " ".join(rng.choice(["alpha", "be", "gamma,", "d"]) for _ in range(rng.choice([1, 5, 300, 2500])))) for i in range(60)]
    out = packing.pack_documents(docs(spark, rows).coalesce(2), BPE, window_tokens=3000).collect()
    total = sum(len(plain_tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r["length"] for r in out) == total
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in rows:
        if i not in (5,):
            ids = np.array(plain_tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4").tobytes()
            mine = sorted(by_doc[i, len(ids) // 4], key=lambda r: r["start"])
            assert b"".join(bytes(r["ids"]) for r in mine) == ids and mine[0]["start"] == 0
    padding = 0
    for rows_ in by_seq.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def test_vector_limits_hold_at_once(spark):
    rng = random.Random(3)
    items = [(i, rng.randrange(1, 500), 0) for i in range(500)]
    items = [(i, n, rng.randrange(min(n, 400) + 1)) for i, n, _ in items]
    odd = [(900, 5000, 0), (901, 600, 500), (902, None, None)]
    df = spark.createDataFrame(items + odd, "item_id long, tokens int, loss_tokens int").coalesce(1)
    out = packing.pack_items(df, packing.Limits(1024, 4, 400), window_items=200).collect()
    assert {r["item_id"]: r["sequence_id"] is None for r in out if r["item_id"] >= 900} == {900: True, 901: True, 902: False}
    out = [r for r in out if r["item_id"] < 900]
    assert sorted(r["item_id"] for r in out) == list(range(500))
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert all(sum(r["tokens"] for r in s) <= 1024 and sum(r["loss_tokens"] for r in s) <= 400 and len(s) <= 4 for s in seqs.values())
    assert len(seqs) <= 1.35 * max(sum(i[1] for i in items) / 1024, 125, sum(i[2] for i in items) / 400)


def test_conversations_are_packed_whole(spark, plain_tokenizer):
    out = packing.conversation_packing(spark, SF).collect()
    want = {}
    for r in common.table(spark, SF, "conversations").collect():
        n = len(plain_tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        t, loss = want.get(r["conv_id"], (0, 0))
        want[r["conv_id"]] = t + n, loss + n * (r["role"] == "assistant")
    assert {r["item_id"]: (r["tokens"], r["loss_tokens"]) for r in out} == want and len(out) == len(want)
    assert all((r["sequence_id"] is None) == (r["tokens"] > 1024 or r["loss_tokens"] > 640) for r in out)
    seqs = {}
    for r in out:
        if r["sequence_id"] is not None:
            seqs.setdefault(r["sequence_id"], []).append(r)
    for s in seqs.values():
        assert sum(r["tokens"] for r in s) <= 1024 and sum(r["loss_tokens"] for r in s) <= 640 and len(s) <= 16
        assert [r["offset"] for r in sorted(s, key=lambda r: r["segment"])] == [sum(x["tokens"] for x in sorted(s, key=lambda r: r["segment"])[:i]) for i in range(len(s))]
    packed = [r for s in seqs.values() for r in s]
    assert len(seqs) <= 1.3 * max(sum(r["tokens"] for r in packed) / 1024, len(packed) / 16, sum(r["loss_tokens"] for r in packed) / 640) + 1
    odd = spark.createDataFrame([(None, "assistant", None), (None, None, "x"), (5, "user", "")], "conv_id long, role string, text string")
    assert sorted(map(tuple, packing.conversation_items(odd, BPE).collect()), key=str) == [(5, 1, 0), (None, 3, 1)]


def test_substring_dedup_cases(spark):
    line = "one two three four five six seven eight nine"
    rows = [(1, f"{line}\nown words of the first text stay here now."), (2, f"start {line}. And this is another sentence of more than eight words."), (3, f"{line.upper()}\nkept"), (4, None), (5, ""), (None, line), (6, "short line\nshort line"), (7, "x\n" + line), (7, "x\n" + line)]
    got = sorted((str(r["doc_id"]), r["text"]) for r in substring_dedup.substring_dedup(docs(spark, rows)).collect())
    assert got == sorted([("1", rows[0][1]), ("2", rows[1][1]), ("3", "kept"), ("4", None), ("5", ""), ("None", ""), ("6", "short line\nshort line"), ("7", "x"), ("7", "x")], key=lambda x: (x[0], x[1] or ""))


def test_units_without_blanks_and_clashing_columns(spark):
    line = "这是一个没有空格的很长的句子" * 3
    d = spark.createDataFrame([(1, line, "a", "k"), (2, f"{line}\nrest", "b", "l"), (3, "short", "c", "m"), (4, "short", "d", "n")], "doc_id int, text string, removed string, id_key string")
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(d).collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: line, 2: "rest", 3: "short", 4: "short"}
    assert [(x["start"], x["stop"]) for x in got[2]["removed"]] == [(0, len(line) + 1)] and got[2]["id_key"] == "l"


def test_substring_dedup_is_its_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = substring_dedup.op1_substring_dedup(spark, SF)
    want = c.execute(substring_dedup.ORACLE)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())


def slow_fingerprint(text, k=3):
    low = (text or "").translate({65 + i: 97 + i for i in range(26)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    units = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_pairs_are_all_pairs(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for _ in range(6):
            q = p
            for _ in range(rng.randrange(1, 6)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
    prints = sorted(prints)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    got = {frozenset((r["a"], r["b"])) for r in simhash.near_pairs(df).collect()}
    want = {frozenset((signed[a], signed[b])) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3}
    assert got == want


def test_simhash_of_the_small_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()] + ODD[:6]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    root = components(prints)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((str(i), p - (1 << 64) if p >> 63 else p, least.get(r)) for (i, _), p, r in zip(rows, prints, root, strict=True))
    assert sorted((str(r["doc_id"]), r["fp"], r["component_id"]) for r in got) == want


def test_long_runs_of_hashes_do_not_overflow():
    h = np.full(200_000, 0xFFFF0000FFFF0001, dtype=np.uint64)
    h[:99_999] = 0
    assert simhash_bits.fingerprint_bits(h, np.array([0, 200_000])).tolist() == [0, 0xFFFF0000FFFF0001]


def test_sharding_laws(spark):
    rows = [(i, "x" * (i % 7)) for i in range(3000)] + [(None, "n"), (None, None), (5, "again")] + [(77, "hot")] * 500
    out = sharding.assign(docs(spark, rows), sharding.layout(24), sharding.layout(25), part_rows=20).collect()
    assert len(out) == len(rows) and all(r["grown_shard"] in (r["shard"], 24) for r in out) and 60 < sum(r["grown_shard"] == 24 for r in out if r["doc_id"] != 77) < 200
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    assert sorted(len({r["doc_id"] for r in out if r["shard"] == s}) for s in slots)[-1] < 190
    by_key = {}
    for r in out:
        by_key.setdefault(r["doc_id"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_key.values())


@pytest.mark.parametrize("n", [1, 5, 24, 25, 31])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    keys = spark.range(3000).select(F.col("id").alias("k"))
    got = sharding.place(sharding.place(keys, F.col("k"), sharding.layout(n, base=min(n, 24)), "a"), F.col("k"), sharding.layout(n + 1, base=min(n, 24)), "b").collect()
    assert all(r["b"] in (r["a"], n) for r in got) and 0.5 < Counter(r["b"] for r in got)[n] / (3000 / (n + 1)) < 1.5


def slow_shard(spark, keys, tree):
    """By descent, child by child, with hashes from single rows."""
    regions = sorted({s.region for s in tree})

    def draws(children):  # (name, weight, what follows the key in the hash)
        frame = spark.createDataFrame([(k,) for k in keys], "k long")
        cols = [F.shiftrightunsigned(F.xxhash64("k", *(F.lit(x) for x in path)), 11).alias(f"c{i}") for i, (_, _, path) in enumerate(children)]
        rows = {r["k"]: r for r in frame.select("k", *cols).collect()}
        return {k: min((-math.log((rows[k][f"c{i}"] + 0.5) / 2.0**53) / w, name) for i, (name, w, _) in enumerate(children) if w > 0)[1] for k in keys} if any(w > 0 for _, w, _ in children) else {}

    weight = lambda test: sum(s.weight for s in tree if test(s))
    region = draws([(r, weight(lambda s, r=r: s.region == r), ["region", r]) for r in regions])
    out = {}
    for r in regions:
        rack = draws([(q, weight(lambda s, q=q, r=r: (s.region, s.rack) == (r, q)), ["rack", r, q]) for q in sorted({s.rack for s in tree if s.region == r})])
        for q in {s.rack for s in tree if s.region == r}:
            leaf = draws([(i, s.weight, ["shard", i]) for i, s in enumerate(tree) if (s.region, s.rack) == (r, q)])
            out |= {k: leaf[k] for k in keys if region[k] == r and rack[k] == q and leaf}
    return out


TREE = [sharding.Shard(3, 0), sharding.Shard(3, 0, 2.0), sharding.Shard(3, 5, 0.5), sharding.Shard(8, 1, 4.0), sharding.Shard(8, 1), sharding.Shard(8, 2, 0.0), sharding.Shard(9, 0, 3.0)]


def test_place_descends(spark):
    keys = list(range(400))
    got = dict(map(tuple, sharding.place(spark.createDataFrame([(k,) for k in keys], "k long"), F.col("k"), TREE, "shard").collect()))
    assert got == slow_shard(spark, keys, TREE) and 5 not in got.values()


def test_weights_move_rows_only_into_what_grew(spark):
    keys = spark.range(6000).select(F.col("id").alias("k"))
    tree = sharding.layout(16)
    heavy = [sharding.Shard(s.region, s.rack, 3.0 if i == 5 else 1.0) for i, s in enumerate(tree)]
    got = sharding.place(sharding.place(keys, F.col("k"), tree, "a"), F.col("k"), heavy, "b").collect()
    at = lambda i: (tree[i].region, tree[i].rack)
    for r in got:
        a, b, changed = at(r["a"]), at(r["b"]), at(5)
        assert a[0] == b[0] or b[0] == changed[0]  # other regions only give rows
        assert a[0] != b[0] or a[1] == b[1] or b[1] == changed[1]  # and in a region other racks
        assert a != b or r["a"] == r["b"] or r["b"] == 5  # and in a rack other shards
    share = Counter(r["b"] for r in got)
    assert 0.13 < share[5] / 6000 < 0.21 and all(0.04 < share[i] / 6000 < 0.075 for i in range(16) if i != 5)


def slow_contamination(text, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({65 + i: 97 + i for i in range(26)}))
    words, hit, found = find(text), set(), set()
    for item, body in items:
        w = find(body)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_contamination(spark, block_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice("ab cd ef gh".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 14, 30])))) for i in range(25)] + [(3, "AB cd!ef"), (99, None), (100, "ümlaut Öl x y z")]
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 8, 40])))) for i in range(40)] + ODD + [(50, "so Ümlaut"), (51, "ümlaut Öl x, y-z and on")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    report = decontaminate.contamination_report(decontaminate.find_contamination(docs(spark, rows), bench, block_bytes=block_bytes))
    want = sorted((str(i), *slow_contamination(t, items)) for i, t in rows)
    assert sorted((str(r["doc_id"]), *r[1:]) for r in report.collect()) == want
    clean = decontaminate.drop_contaminated(docs(spark, rows), bench, block_bytes=block_bytes)
    assert clean.columns == docs(spark, rows).columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in clean.collect()) == sorted([(str(i), t) for i, t in rows if not slow_contamination(t, items)[-1]], key=lambda x: (x[0], x[1] or ""))


def test_a_block_is_small(spark):
    rng = random.Random(13)
    items = [(str(i), " ".join(f"{rng.randrange(10**6):06d}" for _ in range(500))) for i in range(100)]
    block = decontaminate.Block(items, 10, 5)
    held = len(block.words) + block.starts.nbytes + sum(x.nbytes for part in (block.prints, block.keys, block.at, block.item) for x in part.values())
    assert held < 50 * 50_000
    bench = spark.createDataFrame(items, "item_id string, text string")
    sizes = [sum(len(t) for _, t in b) for b in decontaminate._blocks(bench, 40_000)]
    assert sum(sizes) == sum(len(t) for _, t in items) and max(sizes) <= 80_000


def test_winnowing_keeps_one_in_every_window():
    rng = np.random.default_rng(6)
    for _ in range(50):
        g = rng.integers(0, 5, rng.integers(0, 40)).astype(np.uint64)
        at = decontaminate.winnow(g, 6)
        want = sorted({i + max(j for j in range(6) if g[i + j] == min(g[i : i + 6])) for i in range(len(g) - 5)})
        assert at.tolist() == want


def test_loser_tree():
    rng = random.Random(7)
    for _ in range(200):
        runs, every = [], []
        for r in range(rng.randrange(7)):
            items = [(bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))), (r, i)) for i in range(rng.randrange(10))]
            every += items
            run = lcp_merge.sorted_run(items)
            runs.append(lcp_merge.front_decode(*lcp_merge.front_code(run), [x for _, _, x in run]))
        before = b""
        out = list(lcp_merge.merge(runs))
        assert [t for _, t, _ in out] == sorted(t for t, _ in every) and sorted(x for _, _, x in out) == sorted(x for _, x in every)
        for n, t, _ in out:
            assert before[:n] == t[:n] and (n in (len(before), len(t)) or before[n] != t[n])
            before = t


@pytest.mark.parametrize("group", [200, 3])
def test_suffix_dedup(spark, group):
    rng = random.Random(8)
    own = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [own(rng.randrange(380, 900)) for _ in range(4)]
    texts = []
    for _ in range(40):
        t = own(rng.randrange(500))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            t += p[rng.randrange(50) : len(p) - rng.randrange(50)] + own(rng.randrange(200))
        texts.append(t)
    base = max(texts, key=len)
    for _ in range(12):
        c = list(base)
        c[rng.randrange(len(c))] = "Z"
        texts.append("".join(c))
    texts += [texts[5], "ab " * 300, "x" * 700, None, ""] + ["line of a hot passage " * 25] * 300
    out = suffix_dedup.suffix_dedup(docs(spark, list(enumerate(texts))).repartition(4), group=group)
    got = sorted(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()))
    want = [(i, *x) for i, x in enumerate(suffix_dedup.brute_force([(t or "").encode() for t in texts], 400))]
    assert got == want and sum(x[2] > 0 for x in want) > 20


def test_language_counts_and_split(spark):
    texts = ["Hello, wörld  a", "", "  ", "123 éa é", "x"]
    group, gram, n = language.gram_counts(texts, np.arange(len(texts)))
    for i, t in enumerate(texts):
        want = Counter()
        for w in "".join(c.lower() if c.isalpha() else " " for c in t).split():
            for k, s in ((1, w), (2, f" {w} "), (3, f" {w} ")):
                for j in range(len(s) - k + 1):
                    want[sum(ord(c) << 21 * (k - 1 - m) for m, c in enumerate(s[j : j + k]))] += 1
        assert dict(zip(gram[group == i].tolist(), n[group == i].tolist(), strict=True)) == dict(want)


def test_language_on_held_out_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()]
    lang = {r["doc_id"]: r["lang"] for r in common.table(spark, SF, "documents").collect()}
    out = language.op10_language(spark, SF).collect()
    assert len(out) == len(rows) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    odd = language.identify(docs(spark, ODD), language.learn_profiles(common.table(spark, SF, "documents"))).collect()
    assert {str(r["doc_id"]): r["lang_pred"] == "und" for r in odd if r["doc_id"] in (1, 2, 3, 4)} == {"1": False, "2": True, "3": True, "4": True}
    assert all(0 <= r["score"] <= 1 for r in odd) and "source" in odd[0].asDict()
    untaught = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(docs(spark, ODD), {}).collect()]
    assert sorted(map(str, untaught)) == sorted(str((i, None if any(c.isalpha() for c in t or "") else "und", 0.0)) for i, t in ODD)


def slow_language(text, ranked, size):
    """The out-of-place choice and score, n-gram by n-gram."""
    count = Counter()
    for w in "".join(c.lower() if c.isalpha() else " " for c in text or "").split():
        for k, s in ((1, w), (2, f" {w} "), (3, f" {w} ")):
            count.update(sum(ord(c) << 21 * (k - 1 - m) for m, c in enumerate(s[j : j + k])) for j in range(len(s) - k + 1))
    if not count:
        return "und", 0.0
    own = sorted(count, key=lambda g: (-count[g], g))[:size]
    sums = {name: sum(abs(grams.index(g) - i) if g in grams else size for i, g in enumerate(own)) for name, grams in ranked.items()}
    best = min(sorted(sums), key=sums.get)
    return best, 1 - sums[best] / (size * len(own))


@pytest.mark.parametrize("most", [1 << 18, 50])
def test_language_is_its_slow_form(spark, most, monkeypatch):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in common.table(spark, SF, "documents").limit(60).collect()]
    rows += [(1000 + i, t, None if i % 2 else "odd") for i, (_, t) in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counted = language._count
    monkeypatch.setattr(language, "_count", lambda: counted(most))
    ranked = language.learn_profiles(df, size=80)
    by = {}
    for _, text, lang in rows:
        if lang is not None and text is not None:
            for w in "".join(c.lower() if c.isalpha() else " " for c in text).split():
                for k, s in ((1, w), (2, f" {w} "), (3, f" {w} ")):
                    by.setdefault(lang, Counter()).update(sum(ord(c) << 21 * (k - 1 - m) for m, c in enumerate(s[j : j + k])) for j in range(len(s) - k + 1))
    assert ranked == {name: sorted(n, key=lambda g: (-n[g], g))[:80] for name, n in by.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df, ranked, size=80).collect()}
    for i, text, _ in rows:
        name, score = slow_language(text, ranked, 80)
        assert got[i][0] == name and abs(got[i][1] - score) < 1e-12


def test_quality_on_held_out_labels(spark):
    out = {r["doc_id"]: r for r in quality.op4_quality(spark, "/root/testdata/sf0.01").collect()}
    held = [(out[r["doc_id"]], r["quality"]) for r in common.table(spark, "/root/testdata/sf0.01", "labels").collect() if out[r["doc_id"]]["held_out"]]
    assert sum(r["predicted"] == q for r, q in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())


def test_rules_as_a_column_are_the_rules_row_by_row(spark):
    texts = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()] + ODD
    d = docs(spark, texts)
    labels = common.table(spark, SF, "labels")
    model = quality.learn_quality(d, labels)
    assert model.rules and len(model.rules) == len(model.weights)
    got = sorted(r["score"] for r in quality.score_quality(d, model).collect())
    want = []
    for _, text in texts:
        x = quality.statistics((text or "").encode())
        total = model.base + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((x[at] > bound) == above for at, above, bound in rule))
        want.append(1 / (1 + math.exp(-total)))
    assert np.allclose(got, sorted(want), atol=1e-9)


def test_quality_without_both_labels_and_odd_texts(spark):
    d = docs(spark, ODD)
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, None), (77, 0), (None, 0), (6, 9)], "doc_id long, quality int")
    out = quality.score_quality(d, quality.learn_quality(d, labels)).collect()
    assert len(out) == len(ODD) and all(r["score"] > 0.99 for r in out)
    assert quality.score_quality(d, quality.RuleModel(0.0)).first()["score"] == 0.5


def test_repeated_ids_count_once_in_the_fit(spark):
    texts = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()]
    labels = common.table(spark, SF, "labels")
    hot = labels.first()["doc_id"]
    repeated = texts + [t for t in texts if t[0] == hot] * 300
    assert quality.learn_quality(docs(spark, repeated), labels) == quality.learn_quality(docs(spark, texts), labels.union(labels))


def test_lasso_leaves_out_what_says_nothing():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2, (800, 20)).astype(float)
    y = (rng.random(800) < 1 / (1 + np.exp(-(3 * x[:, 0] - 1.5)))).astype(float)
    _, w = quality.lasso_logistic(x, y, 0.02)
    assert w[0] > 0.5 and (np.abs(w[1:]) < 1e-6).sum() >= 17


def test_nearest_by_permutation_index(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(1500, 16))
    v[40:90] = v[40]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] + [1.0] * 15), (9300, [None] + [1.0] * 15), (200, v[200].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = permutation_index.nearest(df, df.filter("vec_id % 100 = 0")).collect()
    found = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        want = sorted((d[i], i) for i in range(1500) if i != q)[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(s - d[i]) < 1e-12 for _, i, s in mine)
        found += len({i for _, i in want} & {m[1] for m in mine})
        total += 10
    assert found >= 0.9 * total and {r["query_id"] for r in out} == set(range(0, 1500, 100))
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert permutation_index.nearest(few, few.filter("vec_id = 0")).count() == 3


def test_index_cases(spark):
    rng = np.random.default_rng(14)
    rows = [(i, rng.normal(size=4).tolist(), 1.0, "x") for i in range(300)] + [(1000 + i, rng.normal(size=n).tolist(), 2.0, "y") for i, n in enumerate((0, 3, 3, 5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, query_id string")
    small = permutation_index.Settings(pivots=40, prefix=10, share=1.0, segment=64, block=7)
    path = common.scratch_path(spark, "index")
    pivots = permutation_index.write_index(df, path, 3, small)
    assert spark.read.parquet(path).agg(F.sum("n")).first()[0] == 300 and spark.read.parquet(path).count() >= 4
    got = permutation_index.search_index(spark, path, pivots, df.filter("vec_id % 10 = 0"), 3, small).collect()
    v = {r[0]: np.array(r[1]) for r in rows[:300]}
    for q in range(0, 300, 10):
        want = sorted((float(np.sqrt(((v[i] - v[q]) ** 2).sum())), i) for i in v if i != q)[:3]
        assert [(r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert {r["query_id"] for r in got} == set(range(0, 300, 10))


def test_footrule():
    order = np.array([[0, 1, 2], [2, 1, 0], [3, 4, 5]])
    files = permutation_index.InvertedFiles.of(order, 6)
    assert files.footrule(np.array([0, 1, 2])).tolist() == [0, 4, 12]
