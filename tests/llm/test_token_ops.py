"""Resampling, alignment and vector packing: brute force, round trips, odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from tapewright.llm import alignment, entries, resample, tokens, vector_packing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n long, weight string, bucket int, _row int, piece string, _group int"
EXTRA = ("x", 7, "w", 7, 7, "p", 7)
ODD = [
    (1, "same words here", *EXTRA), (2, "same words here", *EXTRA), (3, None, *EXTRA), (4, "", *EXTRA), (5, "word " * 20000, *EXTRA),
    (5, "word " * 20000, *EXTRA), (6, "<|endoftext|> <s> x</s>", *EXTRA), (None, "other　text ▁ here", *EXTRA), (None, "\0 \n\t é①😀 ﬁ", *EXTRA), (7, " .,; ", *EXTRA),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def path(name):
    return entries.tokenizer_path(name)


@lru_cache(1)
def tokenizer():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def random_texts(n, seed=3):
    rng = random.Random(seed)
    letters = ["ab", "Zé", " ", "  ", "\n", ".", "1", "'s", "ß", "①", "😀", "\0", "　", "-", "word", "Ａ", "the ", "▁"]
    return ["".join(rng.choices(letters, k=rng.randrange(0, 80))) for _ in range(n)]


# resampling


def words_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features_by_hand(text, low, high):
    ws = words_by_hand(text)
    return [" ".join(ws[i : i + n]) for n in range(low, high + 1) for i in range(len(ws) - n + 1)]


def test_substring_crcs_equal_the_library():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 200_000).astype(np.uint8)
    running = resample.running_crcs(data)
    raw = data.tobytes()
    starts = rng.integers(0, len(data), 300)
    ends = np.minimum(starts + rng.choice([0, 1, 5, 255, 256, 257, 70_000, 131_072], 300), len(data))
    assert resample.substring_crcs(running, starts, ends).tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(starts, ends)]
    assert resample.running_crcs(np.zeros(0, np.uint8)).tolist() == [0]


@pytest.mark.parametrize("low, high", [(1, 1), (1, 3), (2, 4)])
def test_features_equal_brute_force(low, high):
    texts = [None, "", "...", "One", *random_texts(60), "x" * 1000 + " " + "y" * 70_000]
    crcs, docs, words = resample.features(texts, low, high)
    for k, t in enumerate(texts):
        assert Counter(crcs[docs == k].tolist()) == Counter(zlib.crc32(f.encode()) for f in features_by_hand(t, low, high))
        assert words[k] == len(words_by_hand(t))


def resampled_by_hand(rows, target, low=1, high=1, buckets=10_000, percent=10, least=20, seed=2024):
    source = {k: [zlib.crc32(f.encode()) % buckets for f in features_by_hand(t, low, high)] for k, (_, t) in enumerate(rows)}
    s = Counter(b for x in source.values() for b in x)
    t = Counter(zlib.crc32(f.encode()) % buckets for x in target for f in features_by_hand(x, low, high))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for k, (doc, text) in enumerate(rows):
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in source[k]]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(gains), weight, score, None, len(words_by_hand(text)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for n, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = n + 1
    return [tuple(r[:5]) for r in out]


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def ranked(rows):
    """In order; which of the rows without id that tie has a rank is left open."""
    return in_order((r[0], r[1], *r[2:]) if r[0] is not None else (None, *tuple(r)[2:]) for r in rows)


def test_resampling_query_against_brute_force(spark):
    rows = [tuple(r) for r in entries.read(spark, SF, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in entries.read(spark, SF, "benchmark").select("text").collect()]
    found = entries.op11_prefix_crc_resampling(spark, SF).select(*COLUMNS).collect()
    assert in_order(found) == in_order(resampled_by_hand(rows, target))


@pytest.mark.parametrize("low, high, percent, least", [(1, 2, 50, 1), (2, 3, 100, 0), (1, 1, 0, 1)])
def test_resampling_odd_inputs(spark, odd, empty, low, high, percent, least):
    target = spark.createDataFrame([("same text here",), (None,)], "text string")
    options = {"low": low, "high": high, "percent": percent, "min_words": least}
    found = resample.resampled(odd, target, **options).select(*COLUMNS).collect()
    assert ranked(found) == ranked(resampled_by_hand([r[:2] for r in ODD], ["same text here"], low, high, percent=percent, least=least))
    assert resample.resampled(empty, target, **options).collect() == []
    alone = resample.resampled(odd, empty, **options).select(*COLUMNS).collect()
    assert ranked(alone) == ranked(resampled_by_hand([r[:2] for r in ODD], [], low, high, percent=percent, least=least))


def test_resampling_ranks_repeated_rows(spark):
    docs = spark.createDataFrame([(9, "a b")] * 300 + [(None, "a b")] * 200 + [(k, "c d") for k in range(50)], "doc_id long, text string").repartition(7)
    found = resample.resampled(docs, docs.where("doc_id < 5"), percent=60, min_words=1).collect()
    ranked = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 331))
    keys = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked]
    assert keys == sorted(keys) and len(found) == 550


# alignment


def aligned_by_hand(texts):
    """Per text: (ids of A, ids of B, groups, links) by comparing all byte ranges."""
    import sentencepiece

    byte_of = {c: b for b, c in tokens.byte_letters().items()}
    a_bytes = {i: bytes(byte_of[c] for c in w) for w, i in tokenizer().get_vocab().items() if i < 50256}
    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    out = []
    for text in texts:
        a, b, groups, links = [], [], [], []
        if text:
            raw = (" " + text).encode()
            a, b = tokenizer().encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            pieces = [model.id_to_piece(i) for i in b]
            own = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(a_bytes[i] for i in a) != raw or b"".join(own) != raw:
                a, b = [], []
            else:
                ends = [np.cumsum([len(x) for x in xs]).tolist() for xs in ([a_bytes[i] for i in a], own)]
                starts = [[0, *e[:-1]] for e in ends]
                links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
                low = 0
                for cut in sorted({*ends[0]} & {*ends[1]}):
                    groups.append(tuple(",".join(str(x) for x, e in zip(xs, es) if low < e <= cut) for xs, es in ((a, ends[0]), (b, ends[1]))))
                    low = cut
        out.append((a, b, groups, links))
    return out


def alignment_rows(rows):
    found = aligned_by_hand([t for _, t in rows])
    counts = Counter(p for *_, links in found for p in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [
        (doc, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
         hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if a else "")
        for (doc, _), (a, b, groups, links) in zip(rows, found)
    ]


FIGURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_against_brute_force(spark):
    short = [r for r in entries.read(spark, SF, "documents").select("doc_id", "text").collect() if len(r["text"] or "") < 500]
    rows = [tuple(r) for r in short] + [(-k - 1, t) for k, t in enumerate(random_texts(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = in_order(alignment_rows(rows))
    paths = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
    assert in_order(alignment.align_corpus(docs, *paths).select(*FIGURES).collect()) == expected
    assert in_order(alignment.align_corpus(docs, *paths, most_pairs=0).select(*FIGURES).collect()) == expected


def test_alignment_odd_inputs(spark, odd, empty):
    paths = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
    short = odd.where("doc_id IS NULL OR doc_id <> 5")
    expected = alignment_rows([r[:2] for r in ODD if r[0] != 5])
    assert in_order(alignment.align_corpus(short, *paths).select(*FIGURES).collect()) == in_order(expected)
    assert [r[1] for r in expected if r[0] == 3] == [0] and all(r[-1] == "" for r in expected if r[1] == 0)
    both = alignment.align_corpus(odd, *paths).where("doc_id = 5").collect()
    assert both[0] == both[1] and both[0]["n_a"] >= 20000 and both[0]["n_links"] == both[0]["n_best"]
    assert alignment.align_corpus(empty, *paths).collect() == []


@pytest.mark.parametrize("lane", [1, 3, 64, 10_000])
def test_lanes_lose_and_repeat_no_link(lane):
    rng = np.random.default_rng(lane)
    borders = np.concatenate([[0], np.cumsum(rng.integers(1, 400, 50))])
    ends = []
    for share in (0.3, 0.2):
        inner = np.flatnonzero(rng.random(borders[-1]) < share) + 1
        ends.append(np.union1d(inner, borders[1:]))
    a, b, doc, cut = alignment.lockstep(*ends, borders, lane)
    union = np.union1d(*ends)
    assert np.array_equal(np.minimum(ends[0][a], ends[1][b]), union)
    assert np.array_equal(a, np.searchsorted(ends[0], union)) and np.array_equal(b, np.searchsorted(ends[1], union))
    assert np.array_equal(cut, np.isin(union, ends[0]) & np.isin(union, ends[1]))
    assert np.array_equal(doc, np.searchsorted(borders[1:], union))


# vector packing


def test_byte_bpe_equals_the_tokenizer():
    coder = tokens.byte_bpe(path("byte_bpe_50k.json"))
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000][::37]
    texts = [f"a{c}b {c}{c}1{c} !{c}?  {c}z{c}  " for c in marks] + random_texts(500) + ["<|endoftext|>x", "a" * 30_000]
    for text, e in zip(texts, tokenizer().encode_batch_fast(texts, add_special_tokens=False)):
        assert coder.encode(text).tolist() == e.ids


def check_vector_packing(rows, docs, capacity=1024, max_documents=None, max_cost=None):
    """Every id is in exactly one piece; only what is longer than a sequence is cut; no constraint is broken."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["piece"], r["ids_crc32"]].append(r)
        sequences[r["sequence_id"]].append(r)
    expected = Counter()
    for doc, text in docs:
        ids = np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            expected[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and len(own) <= (max_documents or capacity)
        assert sum(r["length"] ** 2 for r in own) <= (max_cost or capacity**2)
    return len(sequences)


def test_vector_packing_query(spark):
    docs = [tuple(r) for r in entries.read(spark, SF, "documents").select("doc_id", "text").collect()]
    rows = entries.op13_vector_best_fit(spark, SF).collect()
    made = check_vector_packing(rows, docs)
    small = [r["length"] for r in rows if r["length"] <= 512]
    least = max(math.ceil(sum(r["length"] for r in rows) / 1024), len(rows) - len(small))
    assert made <= least * 1.02 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_packing_odd_inputs_and_constraints(spark, odd, empty, rule):
    tokenizer_path = path("byte_bpe_50k.json")
    rows = [r[:2] for r in ODD]
    check_vector_packing(vector_packing.pack_documents(odd, tokenizer_path, rule=rule).collect(), rows)
    tight = vector_packing.pack_documents(odd, tokenizer_path, rule=rule, max_documents=2, capacity=64, group=3)
    check_vector_packing(tight.collect(), rows, capacity=64, max_documents=2)
    assert vector_packing.pack_documents(empty, tokenizer_path, rule=rule).collect() == []
    with pytest.raises(ValueError):
        vector_packing.pack(odd, 64, max_cost=10)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_against_a_loop(rule):
    rng = np.random.default_rng(4)
    capacities, weights = np.array([100.0, 6.0, 4000.0]), np.array([1.0, 0.5, 0.25])
    n = np.sort(rng.integers(1, 60, 700))[::-1].astype(float)
    demands = np.stack([n, np.ones(len(n)), n * n], axis=1)
    room, bins = [], []
    for d in demands:
        best = None
        for k, r in enumerate(room):
            if all(r >= d):
                score = float(((r - d) / capacities) ** 2 @ weights) if rule == "norm" else -float((r / capacities) @ (weights * d / capacities))
                if best is None or score < best[0] - 1e-15:
                    best = score, k
        if best is None:
            room.append(capacities.copy())
            best = 0, len(room) - 1
        room[best[1]] -= d
        bins.append(best[1])
    found = vector_packing.vector_best_fit(demands, capacities, weights, rule)
    used = np.zeros((found.max() + 1, 3))
    np.add.at(used, found, demands)
    assert (used <= capacities).all()
    assert len(used) == len(room) and np.mean(found == bins) > 0.99
    with pytest.raises(ValueError):
        vector_packing.vector_best_fit(np.array([[101.0, 1.0, 1.0]]), capacities, weights, rule)
