"""Packing, sharding, exact dedup and mixing: round trips, brute force, odd inputs."""

import hashlib
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from math import ceil, floor

import numpy as np
import pytest

from tapewright.llm import entries, exact_dedup, mixing, packing, sharding
from tapewright.llm.common import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, block long, kept int"
ODD = [
    (1, "same", "en", "a", 4, 7, 7, 7), (2, "same", None, "a", 4, 7, 7, 7), (3, None, "en", None, 0, 7, 7, 7),
    (4, "", "en", "b", 0, 7, 7, 7), (5, "word " * 20000, "en", "b", 1, 7, 7, 7), (5, "word " * 20000, "en", "b", 1, 7, 7, 7),
    (6, "<|endoftext|> x", "en", "b", 1, 7, 7, 7), (None, "other　text", "en", "b", 1, 7, 7, 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@lru_cache(1)
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(entries.tokenizer_path())


def whole_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def check_packing(rows, texts, capacity=4096):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for doc, text in texts.items():
        ids, at = np.array(whole_ids(text), "<u4"), 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return sum(r["length"] for r in rows) / (capacity * len(by_seq))


def test_packing_keeps_every_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = entries.op1_harmonic_packing(spark, SF).collect()
    assert check_packing(rows, texts) > 0.97


def test_token_ids_equal_the_tokenizer():
    rng = np.random.default_rng(7)
    letters = list("abzABZ019.,;'-_é\u0301\u0308ß İıﬁ\x1c\x1d\x1e\x1f\x85\xa0\u2028\u3000\t\n\x0b\x0c\r中文한½²Ⅷ😀<|>")
    texts = ["".join(rng.choice(letters, rng.integers(0, 24))) for _ in range(4000)]
    flat, counts = packing.encode_texts(texts, entries.tokenizer_path())
    at = 0
    for text, n, want in zip(texts, counts.tolist(), tokenizer().encode_batch(texts, add_special_tokens=False)):
        assert flat[at : at + n].tolist() == want.ids, repr(text)
        at += n


def test_packing_odd_inputs(spark, odd, empty):
    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack_documents(unique, entries.tokenizer_path()).collect()
    check_packing(rows, {r["doc_id"]: r["text"] for r in unique.collect()})
    assert len({(r["sequence_id"], r["offset"]) for r in packing.pack_documents(odd, entries.tokenizer_path()).collect()}) >= len(ODD)
    assert packing.pack_documents(empty, entries.tokenizer_path()).collect() == []


def test_packing_returns_ids(spark, odd):
    for r in packing.pack_documents(odd.where("doc_id < 5"), entries.tokenizer_path(), with_ids=True).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())


def test_cut_lengths_fill_their_slots():
    for n in [1, 2, 63, 64, 65, 100, 1000, 2047, 2048, 2049, 4095, 4096, 4097, 20000]:
        cuts = packing.cut_lengths(n)
        assert sum(cuts) == n
        for c in cuts:
            slot = 4096 // (4096 // c)
            assert slot - c <= max(c, 64) / 64


def test_sharding_balances_bytes(spark):
    rows = entries.op4_histogram_sharding(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes[i] for i in range(24)) <= 2 * most


def test_sharding_divides_a_hot_group(spark, odd, empty):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot text', concat('text ', id)) as text", "0 as shard")
    sizes = Counter()
    for r in sharding.shard_documents(docs, shards=8).collect():
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 0.03 * sum(sizes.values()) / 8
    small = [i for i in range(60)]
    pairs = spark.createDataFrame([(i, f"pair {i // 2}" + " x" * 20) for i in small], "doc_id long, text string")
    together = defaultdict(set)
    for r in sharding.shard_documents(pairs, shards=2, tolerance=0.1).collect():
        together[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in together.values())
    assert sharding.shard_documents(odd, shards=3).count() == len(ODD)
    assert sharding.shard_documents(empty, shards=3).collect() == []


def test_exact_dedup_odd_inputs(odd, empty):
    rows = {r["doc_id"]: r for r in exact_dedup.exact_dedup(odd, keep="max").collect()}
    assert len(rows) == 7  # the repeated row comes back once
    assert rows[1]["keep_id"] == 2 and not rows[1]["kept"] and rows[2]["kept"] and rows[1]["group_size"] == 2
    assert rows[3]["keep_id"] == 4 and rows[4]["kept"] and rows[4]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[5]["group_size"] == 2 and rows[None]["kept"]
    assert exact_dedup.exact_dedup(odd).where("doc_id = 1").first()["kept"]
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_exact_dedup_returns_repeated_rows(odd):
    want = Counter((i, len(t or "")) for i, t, *_ in ODD)
    lengths = {hashlib.sha256((t or "").encode()).hexdigest(): len(t or "") for _, t, *_ in ODD}
    got = Counter((r["doc_id"], lengths[r["text_sha256"]]) for r in exact_dedup.exact_dedup(odd, keep="max").collect())
    assert got == want and max(want.values()) == 2


def pfair_by_hand(weights, slots):
    q, served, out = sum(weights), [0] * len(weights), []
    for t in range(slots):
        ready = [(ceil((n + 1) * q / w), i) for i, (n, w) in enumerate(zip(served, weights)) if floor(n * q / w) <= t]
        i = min(ready)[1]
        served[i] += 1
        out.append(i)
    return out


def test_mixing_stays_within_a_block(spark, odd, empty):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('s', id % 4) as source", "1 as slot")
    weights = {"s0": 7, "s1": 3, "s2": 2, "s3": 1}
    rows = sorted(mixing.pfair_mix(docs, weights, block_rows=5).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(3000))
    served = Counter()
    last = None
    for r in rows:
        if not r["in_mix"]:
            break
        if r["slot"] != last:
            last = r["slot"]
            assert r["release"] <= last < r["deadline"]
            assert r["source"] == f"s{pfair_by_hand([7, 3, 2, 1], 13)[last % 13]}"
            served[r["source"]] += 1
            for s, w in weights.items():
                assert abs(served[s] - w * (last + 1) / 13) < 1
    assert sum(served.values()) == (750 // 5) * 13 // 7
    got = mixing.pfair_mix(odd, {"a": 2, None: 1}, block_rows=2).collect()
    assert sorted(r["position"] for r in got) == list(range(len(ODD)))
    assert mixing.pfair_mix(empty, {}).collect() == []
    with pytest.raises(ValueError):
        mixing.pfair_mix(odd, {"a": 0})


def test_mixing_of_many_sources_and_large_weights(spark, monkeypatch):
    """Over 4096 sources, with and without the broadcasts: every slot is served as by hand."""
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('s', if(id < 5000, id, id % 3)) as source")
    weights = {"s0": 700, "s1": 90, "s2": 90}
    names = sorted((f"s{i}" for i in range(5000)), key=lambda s: (-weights.get(s, 1), s))
    want = pfair_by_hand([weights.get(s, 1) for s in names], 400)
    for limit in (mixing.BROADCAST, 10):
        monkeypatch.setattr(mixing, "BROADCAST", limit)
        rows = mixing.pfair_mix(docs, weights, block_rows=1).collect()
        assert sorted(r["position"] for r in rows) == list(range(6000))
        at = {r["slot"]: r for r in rows}
        assert len(at) == len(rows) and all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
        served = Counter()
        for t, i in enumerate(want):
            n = served[i]
            served[i] += 1
            if names[i] in weights and n < 334:
                assert at[t]["source"] == names[i] and at[t]["block"] == n
        order = sorted(rows, key=lambda r: r["slot"])
        assert [r["position"] for r in order] == list(range(6000))


def test_null_ids_are_spread(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'a' as source", "concat('t', id) as text")
    rows = mixing.pfair_mix(docs, {}, block_rows=4).collect()
    assert sorted(r["position"] for r in rows) == list(range(3000))
    made = sharding.shard_documents(docs, shards=4).collect()
    assert sorted((r["shard"], r["slot"]) for r in made) == [(s, i) for s in range(4) for i in range(sum(r["shard"] == s for r in made))]


def test_components(spark):
    rng = np.random.default_rng(1)
    for n, m in [(1, 0), (40, 30), (200, 150), (60, 59)]:
        edges = [(i, i + 1) for i in range(n - 1)] if m == 59 else [tuple(map(int, rng.integers(0, n, 2))) for _ in range(m)]
        best = list(range(n))
        for _ in range(n):
            for a, b in edges:
                best[a] = best[b] = min(best[a], best[b])
        frame = spark.createDataFrame(edges, "a long, b long")
        for r in connected_components(frame).collect():
            assert best[r["node"]] == r["comp"]
