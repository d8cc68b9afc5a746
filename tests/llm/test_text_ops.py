"""N-gram join, vector search, chat, quality, language, HTML and the pipeline."""

import hashlib
import html
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tapewright.llm import ann, chat, entries, html_text, language, ngram_join, packing, quality
from tapewright.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, score double"


def sets_by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components_by_hand(texts, percent=80):
    sets = {i: sets_by_hand(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    top = {i: i for i in texts}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def odd_texts():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    texts = ["", None, " \t\n", "one", "ONE", "one  two", "one two\x0bthree", "four\xa0x y z", "a b c d e", "a b c d e f", "a " * 30000]
    for size in (12, 40, 160):
        base = [words[i] for i in rng.integers(0, 400, size)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            own = list(base)
            for _ in range(edits):
                own[rng.integers(0, size)] = f"x{rng.integers(0, 1000)}"
            texts.append("\n".join(own) if edits == 1 else " ".join(own).upper())
    passage = " ".join(words[:55])
    texts += [f"{passage} " + " ".join(f"y{k}_{i}" for i in range(12)) for k in range(40)]
    return dict(enumerate(texts))


def test_ngram_join_is_exact(spark):
    texts = odd_texts()
    frame = spark.createDataFrame([(i, t, None, None, 0, 5, 0.5) for i, t in texts.items()], DOCS)
    want = components_by_hand(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(frame).collect()}
    assert got == want
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in entries.op2_ngram_join(spark, SF).collect()}
    assert got == components_by_hand(docs)


def test_ngram_join_dense_group_and_nulls(spark):
    rng = np.random.default_rng(6)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(int(rng.integers(0, 3))):
            own[int(rng.integers(0, 120))] = f"z{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(own)))
    texts = dict(rows)
    frame = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    got = ngram_join.similar_components(frame).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {i: c for i, (_, c) in components_by_hand(texts).items()}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert ngram_join.similar_components(frame.where("false")).collect() == []


def test_prefix_tree_equals_sets():
    rng = np.random.default_rng(8)
    for _ in range(60):
        own = np.unique(rng.integers(0, 400, rng.integers(1, 300)))
        sets = []
        for _ in range(12):
            keep = own[rng.random(len(own)) > rng.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 400, rng.integers(0, 30))])))
        for s, linked in zip(sets, ngram_join.tree_links(own, sets, 80, segment=7)):
            both = len(np.intersect1d(own, s))
            assert linked == (100 * both >= 80 * (len(own) + len(s) - both))


def near_sets(rng, count, values=300):
    """Random sets, some of them edits of others."""
    sets = []
    for _ in range(count):
        base = sets[rng.integers(0, len(sets))] if sets and rng.random() < 0.7 else rng.integers(0, values, rng.integers(1, 80))
        keep = base[rng.random(len(base)) > rng.choice([0, 0.03, 0.1])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, values, rng.integers(0, 5))])) if len(keep) else np.unique(base))
    return sets


def test_tree_pairs_lose_no_similar_pair():
    rng = np.random.default_rng(12)
    met = 0
    for trial in range(40):
        sets = near_sets(rng, 50)
        n = np.array([len(s) for s in sets])
        p = np.array([ngram_join.prefix_length(int(x), 80) for x in n])
        tokens = [s[:k] for s, k in zip(sets, p)]
        comp = rng.integers(0, 20, len(sets))
        guest, block = rng.random(len(sets)) < 0.3, rng.integers(0, 2, len(sets))
        last = np.array([t[-1] for t in tokens])
        options = {} if trial % 2 else {"guest": guest, "block": block}
        us, vs, overlaps = ngram_join.tree_pairs(tokens, n, n - p, last, comp, 80, **options)
        assert overlaps == [len(np.intersect1d(tokens[u], tokens[v])) for u, v in zip(us, vs)]
        got = {frozenset(q) for q in zip(us, vs)}
        assert all(len(q) == 2 for q in got)
        for i in range(len(sets)):
            for j in range(i):
                allowed = comp[i] != comp[j] and (trial % 2 or (not (guest[i] and guest[j]) and block[i] != block[j]))
                both = len(np.intersect1d(sets[i], sets[j]))
                if allowed and 100 * both >= 80 * (n[i] + n[j] - both):
                    met += 1
                    assert frozenset((i, j)) in got
                assert allowed or frozenset((i, j)) not in got
    assert met > 100


def test_ngram_join_past_its_switches(spark, monkeypatch):
    """Small groups (bands and blocks), blocks of one set and texts joined by id give the same components."""
    monkeypatch.setattr(ngram_join, "GROUP", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "BITMAP", 64)
    monkeypatch.setattr(ngram_join, "LEAD_SHARE", 1)
    texts = odd_texts()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    for heavy in (ngram_join.HEAVY, 3):
        monkeypatch.setattr(ngram_join, "HEAVY", heavy)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(frame).collect()}
        assert got == components_by_hand(texts)


def test_shingles_over_windows(monkeypatch):
    from tapewright.llm import shingles

    texts = ["ab cd " * 50, "x" * 500, "", None, "q w e r t y" * 9]
    whole = shingle_sets(texts)
    monkeypatch.setattr(shingles, "WINDOW", 64)
    assert all((a == b).all() for a, b in zip(whole, shingle_sets(texts)))
    assert [len(s) for s in whole] == [len(sets_by_hand(t)) for t in texts]


def nearest_by_hand(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        ok = ids != q
        order = np.lexsort((ids[ok], d[ok]))[:k]
        out[q] = [(int(ids[ok][i]), float(d[ok][i])) for i in order]
    return out


def test_vector_search_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 24)) * 2
    rows = [(i, (centres[i % 6] + rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(3000)]
    rows[:200] = [(i, rows[7][1]) for i in range(200)]  # a group of equal vectors
    odd = [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [1.0, None] * 12), (5400, [1.0]), (None, rows[9][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(frame, frame.where("vec_id % 100 = 0"), k=10).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = nearest_by_hand(rows, range(0, 3000, 100), 10)
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.97
    assert [i for i, _ in got[0]] == list(range(1, 11)) and all(s == 0 for _, s in got[0])
    few = frame.where("vec_id < 4")
    assert ann.nearest_neighbours(few, few.where("vec_id = 0")).count() == 3
    assert ann.nearest_neighbours(frame.where("false"), frame.where("false")).collect() == []


def test_vector_search_of_many_lists(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((8000, 64))
    rows = [(i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(set)  # 250 lists, of which any may hold a neighbour
    for r in ann.nearest_neighbours(frame, frame.where("vec_id % 200 = 0"), k=10, rows_per_list=32).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = nearest_by_hand(rows, range(0, 8000, 200), 10)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.97


def test_vector_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    got = defaultdict(list)
    for r in entries.op3_rotated_code_search(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = nearest_by_hand(rows, [i for i, _ in rows if i % 100 == 0], 10)
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.99


def test_vector_bounds_hold():
    rng = np.random.default_rng(3)
    x, q, c = rng.standard_normal((500, 64)), rng.standard_normal((20, 64)), rng.standard_normal(64) * 0.1
    rotate = ann.rotation(64)
    bits, norm, inner = ann.encode(x, np.tile(c, (500, 1)), rotate)
    low, high = ann.bounds(bits, norm, inner, q, c, rotate)
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    assert ((low <= d) & (d <= high)).mean() > 0.99


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be <|end|>\n nice \\ <|role|>"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST] ok [/INST]\\"),
        (1, 3, "assistant", "a\\<|b"), (2, 5, None, "x"), (2, 5, None, "x"), (2, 5, "odd\nrole", "<"), (None, 0, "user", "lost"),
        *((3, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(150)),
    ]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "conv_id long, turn long, role string, text string, score double")
    tree = chat.linear_tree(frame)
    made = chat.format_paths(tree, chat.best_paths(tree))
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert set(got) == {1, 2, 3}
    for conv, r in got.items():
        turns = sorted(((t, role, text) for c, t, role, text in rows if c == conv), key=lambda x: (x[0], x[1] or "", x[2] or ""))
        whole = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for r in made.collect():
        assert r["formatted"].count("<|role|>") == r["formatted"].count("<|end|>") == got[r["conv_id"]]["n_turns"]
        assert "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]


def test_chat_ranks_branches(spark):
    tree = spark.createDataFrame(
        [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9),
         (1, 4, 3, "user", "more", 0.0), (1, 5, 2, "user", "long", 0.2), (1, 6, 99, "user", "orphan", -1.0)],
        "conv_id long, node long, parent long, role string, text string, score double",
    )
    paths = chat.best_paths(tree, branches=3)
    found = defaultdict(list)
    for r in paths.orderBy("branch", "depth").collect():
        found[r["branch"]].append(r["node"])
    assert dict(found) == {1: [1, 3, 4], 2: [1, 2, 5], 3: [6]}
    assert chat.best_paths(tree.where("false")).collect() == []


def paths_by_hand(rows):
    """Every conversation's root-to-leaf paths by score, then by the first node of the leaf's run."""
    parent, score = {}, {}
    for conv, node, up, s in rows:
        parent[conv, node], score[conv, node] = up, s
    kids = defaultdict(list)
    for (conv, node), up in parent.items():
        kids[conv, up].append(node)
    out = defaultdict(list)
    for conv, node in parent:
        if kids[conv, node]:
            continue
        path = [node]
        while parent.get((conv, path[-1])) is not None and (conv, parent[conv, path[-1]]) in parent and len(path) < 10_000:
            path.append(parent[conv, path[-1]])
        if len(path) < 10_000:
            out[conv].append((round(sum(score[conv, n] for n in path), 6), path[::-1]))
    return {c: sorted(ps, key=lambda p: -p[0]) for c, ps in out.items()}


def test_chat_trees_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for conv in range(40):
        ids = rng.permutation(np.arange(1, 60))[: int(rng.integers(1, 50))].tolist()
        for i, node in enumerate(ids):
            up = None if not i or rng.random() < 0.05 else int(ids[max(0, i - int(rng.integers(1, 4)))]) if rng.random() < 0.9 else 777
            rows.append((conv, node, up, float(rng.random())))
    rows += [(100, 1, 3, 0.5), (100, 2, 1, 0.5), (100, 3, 2, 0.5), (100, 4, 3, 0.5), (100, 9, None, 0.1)]  # a cycle, a node below it, a root
    frame = spark.createDataFrame([(*r, "user", "t") for r in rows], "conv_id long, node long, parent long, score double, role string, text string")
    found = defaultdict(lambda: defaultdict(list))
    for r in chat.best_paths(frame, branches=3).orderBy("conv_id", "branch", "depth").collect():
        found[r["conv_id"]][r["branch"]].append(r["node"])
    want = paths_by_hand(rows)
    assert set(found) == set(want) and dict(found[100]) == {1: [9]}
    for conv, ps in want.items():
        assert [found[conv][b] for b in sorted(found[conv])] == [p for _, p in ps[:3]]


def test_chat_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + entries.CONTROL_CASE
    got = {r["conv_id"]: r for r in entries.op6_reply_tree_chat(spark, SF).collect()}
    turns = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        turns[conv].append((role or "", text or ""))
    assert set(got) == set(turns) and -1 in got
    for conv, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(loss)) and r["loss_sha256"] == digest(loss)
        assert r["turns_sha256"] == digest("".join(f"{r}\n{t}\n" for r, t in own)) and r["formatted_chars"] > sum(len(t) for _, t in own)


def test_quality_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in entries.op7_rule_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(got[i]["predicted"], y) for i, y in labels.items() if got[i]["held_out"]]
    assert len(got) == docs.count() and len(held) > 50
    assert np.mean([p == y for p, y in held]) > 0.95


def test_quality_odd_inputs(spark):
    rows = [(1, None, "en", "a", 0, 1, 9.0), (2, "", "en", "a", 0, 1, 9.0), (3, "x " * 50000, "en", "a", 0, 1, 9.0), (None, "y", "en", "a", 0, 1, 9.0)]
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    scores = [r["score"] for r in quality.scored(docs, quality.fit(docs, none)).collect()]
    assert scores == [0.5] * 4
    assert quality.scored(docs.where("false"), (0.0, [])).collect() == []
    one = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    assert 0.9 < quality.scored(docs, quality.fit(docs, one)).first()["score"] < 1


def test_scores_replace_columns_of_their_names(spark):
    """Other columns are carried as they are."""
    docs = spark.createDataFrame([(1, "the and of to", 9.0, "s", "zz", 7), (2, None, 9.0, "s", "zz", 7)], "doc_id long, text string, score double, _stats string, lang_pred string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.scored(docs, quality.fit(docs, none))
    assert scored.columns.count("score") == 1 and [r["score"] for r in scored.collect()] == [0.5, 0.5] and {r["kept"] for r in scored.collect()} == {7}
    found = language.predicted(docs, language.fit(docs.where("false").withColumnRenamed("lang_pred", "lang")))
    assert found.columns.count("score") == found.columns.count("lang_pred") == 1
    assert {(r["lang_pred"], r["score"], r["kept"]) for r in found.collect()} == {("und", 0.0, 7)}


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entries.op8_language_id(spark, sf).collect()
    held = [r["lang_pred"] == want[r["doc_id"]] for r in got if r["held_out"]]
    assert len(got) == len(want) and np.mean(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_inputs(spark):
    docs = spark.createDataFrame(
        [(1, "der die das und", "de", "a", 0, 1, 1.0), (2, "the and of to", "en", "a", 0, 1, 1.0), (3, None, "en", "a", 0, 1, 1.0),
         (4, "123 !!", None, "a", 0, 1, 1.0), (5, "", "de", "a", 0, 1, 1.0)], DOCS)
    got = {r["doc_id"]: r for r in language.predicted(docs, language.fit(docs)).collect()}
    assert got[1]["lang_pred"] == "de" and got[2]["lang_pred"] == "en"
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and got[3]["score"] == 0
    assert not any(map(language.has_letter, [None, "", "½", "²", "Ⅷ", "123_!"])) and language.has_letter("4ß")
    rare = spark.range(4000).selectExpr("id as doc_id", "if(id % 800 = 3, 'zik zak zok', 'the and of to') as text", "if(id % 800 = 3, 'zz', 'en') as lang")
    model = language.fit(rare, rows=40)
    assert model["langs"] == ["en", "zz"]
    assert {r["lang_pred"] for r in language.predicted(rare.where("lang = 'zz'"), model).collect()} == {"zz"}
    empty = language.fit(docs.where("false"))
    assert {r["lang_pred"] for r in language.predicted(docs, empty).collect()} == {"und"}


def text_by_hand(page):
    """The main text of the given pages, by regular expressions over their one layout."""
    article = re.search(r"<article>(.*?)</article>", page or "", re.DOTALL)
    parts = re.split(r"</?(?:h1|p|ul|li|div)\b[^>]*>", re.sub(r"<!--.*?-->", "", article[1], flags=re.DOTALL)) if article else []
    texts = [" ".join(html.unescape(re.sub(r"<br\s*/?>", " ", x)).split()) for x in (re.sub(r"</?(?:b|i|a|em)\b[^>]*>", "", p) for p in parts)]
    return "\n".join(t for t in texts if t)


def test_html_main_text(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = entries.op10_recurrent_html(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == text_by_hand(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])


def labelled(page):
    found = html_text.blocks(page)
    return list(zip(found.texts, found.labels()))


PROSE = "The of and to a in that is it for was on are as with his they at be this from have or by one had not but what all were when we there can. "
LAYOUTS = [  # (page, main blocks): hand-labelled pages of other layouts than the given ones
    (f"<body><header><a href=/>Site</a></header><main><article><header><h1>Title here</h1></header><p>{PROSE}</p><figure><figcaption>A caption.</figcaption></figure>"
     f"<p>{PROSE}</p></article></main><aside><p>Read more</p></aside><footer>&copy; site</footer></body>", ["Title here", PROSE, "A caption.", PROSE]),
    (f"<body><div id=menu><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></div><div class='post content'><h1>T</h1><p>{PROSE}<p>{PROSE}"
     f"<div class=comments><p>Nice one!</p><p>{PROSE}</p></div></div><div class=footer>&copy; x</div>", ["T", PROSE, PROSE]),
    (f"<body><div class='cookie notice'>We use cookies.</div><div class=sidebar><p>Popular</p></div><section class=story><h2>Head</h2><p>{PROSE}</p><div class=ad>Buy now</div>"
     f"<p>{PROSE}</p></section><form><p>Your mail</p></form>", ["Head", PROSE, PROSE]),
    (f"<body><nav><a href=/>Home</a></nav><main><h1>Long read</h1><p>{PROSE}</p><blockquote>{PROSE}</blockquote><p>{PROSE}</p></main><div class='newsletter signup'>"
     "<p>Join us</p></div><footer><p>&copy; y</p><p>Imprint</p></footer>", ["Long read", PROSE, PROSE, PROSE]),
    ("<body><nav>" + "<ul><li><a href=/x>X</a></li></ul>" * 3 + "</nav><article>" + "<div>" * 30 + f"<h1>Deep</h1><p>{PROSE}</p>" + "</div>" * 30 + "</article><footer>&copy; z</footer>", ["Deep", PROSE]),
    (f"<body><div><ul><li><a href=/a>One</a><li><a href=/b>Two</a><li><a href=/c>Six</a></ul></div><div><h1>{PROSE[:40]}</h1><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>"
     "<div>&copy; nobody</div>", [PROSE[:40], PROSE, PROSE, PROSE]),
]


def test_html_other_layouts(spark):
    """Hand-labelled layouts that the training pages don't have: at most one block in ten is labelled otherwise."""
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    frame = spark.createDataFrame([(i, None, p) for i, (p, _) in enumerate(LAYOUTS)], "page_id long, url string, html string")
    got = {r["page_id"]: Counter(r["text"].split("\n")) for r in html_text.main_text(frame, html_text.fit(given)).collect()}
    wants = {i: Counter(w.strip() for w in want) for i, (_, want) in enumerate(LAYOUTS)}
    wrong = sum(sum((got[i] - wants[i]).values()) + sum((wants[i] - got[i]).values()) for i in wants)
    total = sum(len(html_text.blocks(p).texts) for p, _ in LAYOUTS)
    assert total >= 40 and wrong <= 4, (got, wrong, total)


def test_html_blocks():
    page = """<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>one <b>two</b>\n three<p>four&copy five
      <script>var t="</p>";</script><br>six<ul><li>a<li>b</ul></article><!-- no <p>x</p> --><div class='comments'>bad</div></body"""
    assert labelled(page)[:7] == [("Home", 0), ("T & U", 1), ("one two three", 1), ("four© five six", 1), ("a", 1), ("b", 1), ("bad", 0)]
    assert labelled(None) == labelled("") == []
    assert labelled("<p title=\"a > b\" class='x>y'>text</p>") == [("text", None)]
    assert labelled("AT&<b>amp;</b>T &lt;p&gt;") == [("AT&amp;T <p>", None)]
    assert labelled("<article><div class='article-header'><h1>t</h1></div><div class=related>r</div><div class='ad header'>x</div></article>") == [("t", 1), ("r", 1), ("x", 0)]
    assert labelled("<header><article>x</article></header><div class='page-header'>y</div>") == [("x", 0), ("y", 0)]


def test_html_blocks_keep_what_follows_raw_elements():
    for tag in ("<svg class='i'/>", "<svg/>", "<svg viewBox='0 0 1 1' />", "<svg><path d='M0'/></svg>", "<script>x</script>", "<title>x</title>"):
        assert html_text.blocks(f"<article><p>a{tag}b</p><p>c</p></article>").texts == ["ab", "c"]
    for tag in ("title-bar", "object-view", "template-x", "select-all", "svg-icon"):
        assert labelled(f"<article><{tag} class=x><p>in</p></{tag}><p>after</p></article>") == [("in", 1), ("after", 1)]
        assert html_text.blocks(f"<p>a</p><{tag}><p>rest of the page</p>").texts == ["a", "rest of the page"]
    found = labelled("<article><figure><img src=x><figcaption>Caption.</figcaption></figure></article><aside><figcaption>Ad</figcaption></aside>")
    assert found == [("Caption.", 1), ("Ad", 0)]


def test_html_keeps_the_page_after_empty_comments_and_unclosed_elements():
    rest = "<p>rest of page</p>"
    for gap in ("<!-->", "<!--->", "<!-- x -->", "<!-- x --!>", "<!doctype html>", "<?php x ?>", "<object data=x>", "<noscript>", "<svg viewBox='0'>", "<template>", "<select><option>one<option>two"):
        assert html_text.blocks(f"<p>a</p>{gap}{rest}").texts == ["a", "rest of page"], gap
    assert html_text.blocks(f"<p>a</p><select><option>one</select><b>b</b>{rest}").texts == ["a", "b", "rest of page"]
    assert html_text.blocks("<object><p>fallback</p></object><noscript><p>plain</p></noscript>").texts == ["fallback", "plain"]
    assert html_text.blocks(f"<p>a < b and c <3 d</p>{rest}").texts == ["a < b and c <3 d", "rest of page"]
    assert html_text.blocks("<p title='unclosed>text</p><p>more</p>").texts == ["text", "more"]
    assert html_text.blocks("<p>x</p><!-- never closed <p>y</p>").texts == ["x"]
    assert html_text.blocks("<SCRIPT>a</p></Script ><p>b</p>").texts == ["b"]


@pytest.mark.parametrize("piece", ["<a ", "<script ", "<svg ", '<p a="', "<p a='>", "<", "<!", "<!--", "</", "<svg>", "<script>", "<select>", "<p a=\">\" ", "&", "&amp", "<div class=\"", "= \"", "<p>x", "<template>"])
def test_html_reader_is_linear(piece):
    """A megabyte of anything unclosed is read in seconds."""
    began = time.process_time()
    html_text.blocks(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 4


def test_html_batches_by_blocks():
    pages = [html_text.blocks("<p>x</p>" * n) for n in (3, 0, 5, 30, 1, 1)]
    assert [len(p.texts) for part in html_text.by_blocks(pages, 12) for p in part] == [3, 0, 5, 30, 1, 1]
    assert all(len(part) == 1 or sum(len(p.texts) + 1 for p in part) <= 12 for part in html_text.by_blocks(pages, 12))


def test_html_odd_inputs(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" * 3000 + "x"), (None, "u", "plain text"), (4, "u", "<div>" * 50_000 + "deep"), (4, "u", "<nav>m</nav>" + "<p>t</p>" * 5000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_main int")
    got = html_text.main_text(pages, html_text.fit(pages)).collect()  # nothing to learn from
    assert [r["text"] for r in got] == ["", "", "x", "plain text", "deep", "\n".join(["t"] * 5000)]
    assert html_text.main_text(pages.where("false"), html_text.fit(pages.where("false"))).collect() == []


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    pages = []
    for _ in range(60):
        n = int(rng.integers(1, 12))
        x = rng.standard_normal((n, html_text.DIM)).astype(np.float32)
        x[:, 0] = rng.random(n) > 0.7
        y = np.array([float(x[: i + 1, 0].any() and x[i:, 0].any()) for i in range(n)], np.float32)  # between marks
        pages.append((x, y))
    model = html_text.BiLSTM()
    model.train(pages, epochs=60)
    right = np.concatenate([(p >= 0.5) == y for p, (_, y) in zip(model.label([x for x, _ in pages]), pages)])
    assert right.mean() > 0.95


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()}
    assert 0.5 * len(rows) < len(good) < len(rows)
    last = {}
    for i in sorted(good):
        last[rows[i]["text"] or ""] = i
    kept = set(last.values())
    found = components_by_hand({i: rows[i]["text"] for i in kept})
    kept = {i for i in kept if found[i][1] == i}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == kept
    ids = defaultdict(int)
    for r in pieces:
        ids[r["doc_id"]] += r["length"]
    texts = [rows[i]["text"] or "" for i in ids]
    assert [n + 1 for n in packing.encode_texts(texts, entries.tokenizer_path())[1].tolist()] == list(ids.values())
    mixed = corpus_pipeline.mix_stage(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count() == docs.count()


def test_pipeline_packs_in_the_order_of_the_mix(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = {}
    for name, weights in (("none", None), ("given", {"src0": 5}), ("other", {"src1": 7})):
        rows = docs
        if weights:
            monkeypatch.setattr(corpus_pipeline.mixing, "WEIGHTS", weights)
            corpus_pipeline.mix_stage(spark, docs, SF).write.parquet(str(tmp_path / name))
            rows = spark.read.parquet(str(tmp_path / name))
        pieces = corpus_pipeline.pack_stage(spark, rows, SF).collect()
        made[name] = {(r["doc_id"], r["start"]): (r["sequence_id"], r["offset"]) for r in pieces}
        assert len(made[name]) == len(pieces)
        if weights:
            mix = corpus_pipeline.mixing.pfair_mix(docs, weights, block_rows=corpus_pipeline.mixing.BLOCK_ROWS)
            position = {r["doc_id"]: r["position"] for r in mix.collect()}
            assert {r["doc_id"]: r["_position"] for r in corpus_pipeline.stored_positions(rows).collect()} == position
            first = defaultdict(lambda: 1 << 60)
            for r in pieces:
                first[r["sequence_id"]] = min(first[r["sequence_id"]], position[r["doc_id"]])
            assert sorted(first) == list(range(len(first)))
            assert [first[s] for s in sorted(first)] == sorted(first.values())
    assert made["none"].keys() == made["given"].keys() == made["other"].keys()
    assert made["none"] != made["given"] and made["given"] != made["other"] and made["none"] != made["other"]


@pytest.mark.parametrize("stage", ["quality", "exact_dedup", "near_dedup", "mix"])
def test_pipeline_stages_keep_columns(spark, stage):
    extra = spark.read.parquet(f"{SF}/documents.parquet").limit(20).withColumn("position", pytest.importorskip("pyspark.sql.functions").lit(1))
    made = dict(corpus_pipeline.STAGES)[stage](spark, extra, SF)
    assert made.columns == extra.columns
    assert dict(corpus_pipeline.STAGES)[stage](spark, extra.where("false"), SF).collect() == []
