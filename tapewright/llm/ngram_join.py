"""N-gram Jaccard join with prefix trees: components of documents with equal or similar word shingles.

Every text becomes the set of its 5-word shingles, hashed to 62 bits and put in
one global order: shingles found often come last (a flag bit), then by hash.
Sets of Jaccard similarity t or more share one of their first
n - ceil(t * n) + 1 shingles, so only sets that meet under such a shingle can
link, and only texts with equal sets need no test. In turn:

1. Sets. One pass writes (row, id, set key, size, prefix). Sets with equal keys
   (128 bits) and sizes are one node from here on, named by its first row; links
   are between nodes.
2. Leaders. The first node that holds a shingle leads it, the nodes that consist
   most of frequent shingles, as the centres of large groups of near copies do,
   coming first; each node is tested against the leader that it shares most prefix
   shingles with, if these are a good part of its prefix. A dense group of near
   copies thus costs one test a node, and becomes one component.
3. The rest. Shingles whose nodes are all in one component are done. The nodes
   under the others meet in the groups of those shingles' leaders, so that a
   node is sent to a few groups, not to one per shingle. In each group the
   open prefixes form a prefix tree, which is traversed once against all of them:
   the overlaps with every other set are counted along the path, shared by
   all that is below, and a subtree is left where the overlap plus what can
   still follow in either set can't reach the overlap that the similarity asks
   for. Pairs of different components that reach the bound leave the task. This is
   done twice: a first round tests only the best pairs of each component, so that
   what is left of a dense group joins it by a few tests; the second round, over
   what is open then, tests all pairs that are left. No link between different
   components is missed.
   Groups of over GROUP nodes are divided by bands of size (sets may differ by
   the similarity only, so a band meets the next one and no other), then by hash.
4. Tests. The whole sets that are tested against one set, in blocks of 256, form a
   prefix tree too: in lexicographic order each set continues the path that it
   shares with the one before, whose partial overlaps are kept; a path ends
   where the overlap plus the shorter remaining length can't reach the bound.
5. Components, by large-star and small-star rounds over the links.

The list of frequent shingles (at most HEAVY, by count) only orders the sets and
tells which shingles are counted before they are shuffled: any list gives the
same links. Texts without words are linked with nothing; rows without id get no
component; rows that repeat an id with another text take part each. Empty
tables give an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, join_hot
from .shingles import shingle_sets

HEAVY = 65_536  # entries of the list of frequent shingles
LOCAL = 4  # a batch reports shingles that so many of its sets hold
BLOCK = 256  # sets in a prefix tree that is tested against one set
GROUP = 4096  # nodes that one traversal holds against each other
BITMAP = 1 << 26  # bits of the bitmap of ids whose sets are read
LEAD_SHARE = 3  # a node is tested against its leader if they share 1 in so many of its prefix; the rest is left to step 3
FLAG = 1 << 62


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _halves(keys: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def needed_overlap(n: int, m: int, percent: int) -> int:
    """The smallest intersection of sets of n and m shingles whose similarity is enough."""
    return -(-percent * (n + m) // (100 + percent))


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _frequent(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, seen = [], set()
            for part in _batches([batch]):
                for s in shingle_sets(part.column(0).to_pylist(), k):
                    if (key := set_key(s)) not in seen:
                        seen.add(key)
                        held.append(s)
            values, counts = np.unique(np.concatenate(held or [np.zeros(0, np.int64)]), return_counts=True)
            often = counts >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(values[often]), pa.array(counts[often].astype(np.int64))], ["token", "n"])

    return count


def frequent_shingles(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """The shingles that most sets hold, at most HEAVY, ascending."""
    found = docs.select(text_col).mapInArrow(_frequent(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "token").limit(HEAVY).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64))


def _ordered(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The set in global order, as ascending numbers: frequent shingles get the flag bit."""
    if not len(heavy) or not len(s):
        return s
    often = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
    return np.concatenate([s[~often], s[often] | np.int64(FLAG)]) if often.any() else s


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.int64), *(a for a in arrays if a is not None)])
    ends = np.cumsum([0, *(0 if a is None else len(a) for a in arrays)]).astype(np.int32)
    mask = pa.array([a is None for a in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=mask)


SETS = "row long, id long, k1 long, k2 long, n long, prefix array<long>"


def _row_names(part: int, at: int, shares: list[float]) -> np.ndarray:
    """Distinct numbers of rows: 14 bits that fall with the share of frequent shingles, 22 of the partition, 27 of the row in it."""
    if part >= 1 << 22 or at + len(shares) > 1 << 27:
        raise ValueError("deal the documents to fewer than 2**22 partitions of at most 2**27 rows")
    rare = (16383 * (1 - np.array(shares, float))).astype(np.int64)
    return (rare << 49) + (part << 27) + np.arange(at, at + len(shares))


def _prefixes(k: int, percent: int, heavy: np.ndarray):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, row, own = set(), 0, TaskContext.get().partitionId()
        for part in _batches(batches):
            ids, keys, sizes, prefixes, shares = part.column(0), [], [], [], []
            for doc, s in zip(ids.to_pylist(), shingle_sets(part.column(1).to_pylist(), k)):
                key, ordered = set_key(s), _ordered(s, heavy)
                keys.append(key)
                sizes.append(len(s))
                shares.append(1 - np.searchsorted(ordered, FLAG) / len(s) if len(s) else 0.0)
                if doc is None or not len(s) or key in seen:
                    prefixes.append(None)  # a copy in the same partition has it
                else:
                    seen.add(key)
                    prefixes.append(ordered[: prefix_length(len(s), percent)])
            rows = pa.array(_row_names(own, row, shares))
            row += len(keys)
            yield pa.RecordBatch.from_arrays(
                [rows, ids, *_halves(keys), pa.array(sizes, pa.int64()), _lists(prefixes)], ["row", "id", "k1", "k2", "n", "prefix"]
            )

    return make


def tree_links(own: np.ndarray, sets: list[np.ndarray], percent: int, segment: int = 64) -> list[bool]:
    """Which of `sets` are similar enough to `own`, all ascending in the global order.

    The sets form a prefix tree, traversed depth first as sorted sequences:
    `path` holds the overlap with `own` at each depth of the current path.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
    linked = [False] * len(sets)
    last, path = np.zeros(0, np.int64), np.zeros(1, np.int64)  # path[d]: overlap of the first d tokens
    for i in order:
        s = sets[i]
        depth = min(_shared_depth(last, s), len(path) - 1)
        path, want, step = path[: depth + 1], needed_overlap(len(own), len(s), percent), segment
        while True:
            used = int(np.searchsorted(own, s[depth - 1], side="right")) if depth else 0
            if path[-1] + min(len(s) - depth, len(own) - used) < want:
                break  # nothing below this node of the tree can be long enough
            if depth == len(s):
                linked[i] = True
                break
            more = s[depth : depth + step]
            hit = own[np.minimum(np.searchsorted(own, more), len(own) - 1)] == more
            path = np.concatenate([path, path[-1] + np.cumsum(hit)])
            depth += len(more)
            step *= 2
        last = s
    return linked


def _shared_depth(x: np.ndarray, y: np.ndarray) -> int:
    """How many tokens two sequences have in common from their start."""
    short = min(len(x), len(y))
    differ = np.flatnonzero(x[:short] != y[:short])
    return int(differ[0]) if len(differ) else short


def tree_pairs(
    tokens: list[np.ndarray], n: np.ndarray, follow: np.ndarray, last: np.ndarray, comp: np.ndarray, percent: int,
    guest: np.ndarray | None = None, block: np.ndarray | None = None,
) -> tuple[list[int], list[int], list[int]]:
    """Pairs (u, v) of sets of different components whose prefixes let them be similar enough, and the overlaps of their prefixes.

    `tokens` are open prefixes in the global order, `n` the sizes of the whole
    sets, `follow` how many tokens come after the prefix and `last` its last
    token. Two guests make no pair, nor do two sets of one block, if these are given.

    Two sets share at most what their prefixes share and what follows the prefix
    that ends first. The prefix tree is traversed depth first; each branching
    keeps the overlaps of its path with all sets, so that a path that several
    sets share is counted once.
    """
    rows = len(tokens)
    flat = np.concatenate(tokens)
    owner = np.repeat(np.arange(rows), [len(t) for t in tokens])
    values, at = np.unique(flat, return_inverse=True)
    useful = np.bincount(at) > 1  # what one set holds alone joins nothing
    kept = useful[at]
    owner, at = owner[kept], (np.cumsum(useful) - 1)[at[kept]]
    ends = np.cumsum(np.bincount(owner, minlength=rows))
    paths = [at[e - c : e] for e, c in zip(ends.tolist(), np.bincount(owner, minlength=rows).tolist())]
    holders = owner[np.argsort(at, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=int(useful.sum())))]).tolist()

    def counted(path: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([holders[first[t] : first[t + 1]] for t in path.tolist()]), minlength=rows)

    order = sorted((i for i in range(rows) if len(paths[i])), key=lambda i: paths[i].astype(">i8").tobytes())
    lengths = np.array([len(paths[i]) for i in order], np.int64)
    depths = np.array([0, *(_shared_depth(paths[i], paths[j]) for i, j in zip(order, order[1:]))], np.int64)
    sizes, ending, place = n[order], follow[order], np.full(rows, -1, np.int64)
    place[order] = np.arange(len(order))
    us: list[int] = []
    vs: list[int] = []
    shared: list[int] = []
    stack = [(0, np.zeros(rows, np.int64))]  # depth of a branching and the overlaps of its path with all sets
    below = 0  # sets up to here are in a subtree that was left
    for k, i in enumerate(order):
        if k < below:
            continue
        path, depth = paths[i], int(depths[k]) if k else 0
        while stack[-1][0] > depth:
            stack.pop()
        if stack[-1][0] < depth:
            top, overlap = stack[-1]
            stack.append((depth, overlap + counted(path[top:depth])))
        # the path to the next branching, and all sets below that
        branch = int(depths[k + 1]) if k + 1 < len(order) else 0
        if branch > stack[-1][0]:
            top, overlap = stack[-1]
            overlap = overlap + counted(path[top:branch])
            stack.append((branch, overlap))
            out = np.flatnonzero(depths[k + 1 :] < branch)
            end = k + 1 + int(out[0]) if len(out) else len(order)
            least, most = int(sizes[k:end].min()), int(sizes[k:end].max())
            rest = int(lengths[k:end].max()) - branch
            best = overlap + rest + np.maximum(follow, int(ending[k:end].max()))
            near = (n * 100 >= least * percent) & (n * percent <= most * 100)
            if not (near & (best * (100 + percent) >= percent * (n + least))).any():
                below = end
                continue
        top, overlap = stack[-1]
        ends_first = np.where(last <= last[i], follow, follow[i])
        wanted = percent * (n + n[i]) - (100 + percent) * ends_first
        ok = (place > k) & (comp != comp[i]) & (n * 100 >= n[i] * percent) & (n[i] * 100 >= n * percent)
        if guest is not None and guest[i]:
            ok &= ~guest
        if block is not None:
            ok &= block != block[i]
        ok &= (overlap + (len(path) - top)) * (100 + percent) >= wanted
        if not ok.any():
            continue
        whole = overlap + counted(path[top:]) if len(path) > top else overlap
        found = np.flatnonzero(ok & (whole > 0) & (whole * (100 + percent) >= wanted))
        us += [i] * len(found)
        vs += found.tolist()
        shared += whole[found].tolist()
    return us, vs, shared


def best_of_components(u: np.ndarray, v: np.ndarray, overlap: np.ndarray, n: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Which pairs to test first: each component's best with any other, and its best with the largest component there is."""
    score = overlap * 1000 // np.maximum(np.minimum(n[u], n[v]), 1)
    names, sizes = np.unique(comp, return_counts=True)
    largest = names[sizes.argmax()]
    order = np.argsort(-score, kind="stable")
    keep = np.zeros(len(u), bool)
    for side, other in ((u, v), (v, u)):
        for within in (order, order[comp[other[order]] == largest]):
            _, first = np.unique(comp[side[within]], return_index=True)
            keep[within[first]] = True
    return keep


def _group_pairs(percent: int, best: bool):
    """Rows come sorted by (lead, band, i, j)."""

    def find(group: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        guest, block, node, comp, n, follow, last = (np.array(c, np.int64) for c in zip(*(r[:7] for r in rows)))
        if (comp == comp[0]).all():
            return []
        found = tree_pairs([r[7] for r in rows], n, follow, last, comp, percent, guest > 0, block if group[2] != group[3] else None)
        u, v, overlap = (np.array(c, np.int64) for c in found)
        if best and len(u):
            kept = best_of_components(u, v, overlap, n, comp)
            u, v = u[kept], v[kept]
        return [(min(p, q), max(p, q)) for p, q in zip(node[u].tolist(), node[v].tolist())]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(11)]
            tokens = batch.column(11)
            flat, ends = tokens.values.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()
            out = []
            for r, key in enumerate(zip(*cols[:4])):
                if key != group:
                    if group is not None:
                        out += find(group, rows)
                    group, rows = key, []
                rows.append((*(c[r] for c in cols[4:]), np.array(flat[ends[r] : ends[r + 1]], np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in out], pa.int64()) for c in (0, 1)], ["a", "b"])
        out = find(group, rows) if group is not None else []
        yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in out], pa.int64()) for c in (0, 1)], ["a", "b"])

    return pair


def candidate_pairs(met: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch, best: bool = False, group: int | None = None) -> DataFrame:
    """Pairs (a, b) of nodes of different components that can still be similar, as a written table; with `best` those of a group to test first.

    `met`: (lead, node, n); `nodes`: (node, comp, n, p, last, tokens), tokens being
    the open shingles of the node's prefix, ascending. Places in groups are dealt
    before the shingles are joined to them.
    """
    group = group or GROUP
    large = met.groupBy("lead").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group).select("lead", F.lit(True).alias("_large"))
    # bands a little wider than the similarity, so that rounding can't put a pair two bands apart
    band = F.floor(F.log("n") / F.log(F.lit(100.1 / percent))).cast("int")
    rows = join_hot(met, large, ["lead"], "node").withColumn("_own", F.when(F.col("_large"), band).otherwise(0))
    bands = F.when(F.col("_large"), F.array("_own", F.col("_own") - 1)).otherwise(F.array("_own"))
    rows = scratch.written(rows.select("lead", "node", "_own", F.explode(bands).alias("band")), "places")
    counts = rows.groupBy("lead", "band").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("_blocks")).where("_blocks > 1")
    places = join_hot(rows, counts, ["lead", "band"], "node").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    places = places.withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = places.join(nodes, "node").select(
        "lead", "band", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), (F.col("band") < F.col("_own")).cast("int").alias("guest"),
        "_b", "node", "comp", "n", (F.col("n") - F.col("p")).alias("follow"), "last", "tokens",
    )
    dealt = dealt.repartition("lead", "band", "i", "j").sortWithinPartitions("lead", "band", "i", "j")
    pairs = scratch.written(dealt.mapInArrow(_group_pairs(percent, best), "a long, b long").distinct(), "pairs")
    scratch.drop(rows)
    return pairs


def _test_blocks(percent: int, k: int, heavy: np.ndarray):
    """Rows (a, block, b, k1, k2, text) come sorted by (a, block, b); the row with a null b brings the text of a."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, others, names = None, None, [], []

        def flush():
            if own is None or not names:
                return [], []
            ok = tree_links(own, others, percent)
            good = [b for b, x in zip(names, ok) if x]
            return [group[0]] * len(good), good

        for batch in _batches(batches):
            a, block, b, k1, k2 = (batch.column(i).to_pylist() for i in range(5))
            keys = np.array([k1, k2], np.int64).T
            left, right = [], []
            for r, s in enumerate(shingle_sets(batch.column(5).to_pylist(), k)):
                if set_key(s) != keys[r].tobytes():
                    continue  # another text of the same id
                if (a[r], block[r]) != group:
                    x, y = flush()
                    left += x
                    right += y
                    group, own, others, names = (a[r], block[r]), None, [], []
                if b[r] is None:
                    own = _ordered(s, heavy)
                else:
                    others.append(_ordered(s, heavy))
                    names.append(b[r])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        left, right = flush()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return test


def _marked(bitmap):
    """(least, text) of the texts whose id's bit is set."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for part in _batches(batches):
            places = zip(part.column(2).to_pylist(), part.column(3).to_pylist())
            part = part.filter(pa.array([b in bits and bool(bits[b][i >> 3] >> (i & 7) & 1) for b, i in places], pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["least", "text"])

    return choose


def asked_texts(texts: DataFrame, asked: DataFrame, bits: int | None = None) -> DataFrame:
    """The rows of `asked` (least, ...) with `text`, the texts of the ids `least`.

    Up to `bits` / 16 rows a bitmap of fixed size tells the scan which texts to
    look at; beyond, all texts are joined with the ids that are asked for. An id
    that repeats gives a row for each of its texts.
    """
    bits = bits or BITMAP
    found = texts.where("_id IS NOT NULL").select(F.col("_id").alias("least"), F.col("_text").alias("text"))
    if asked.count() <= bits // 16:
        slot = F.pmod(F.xxhash64("least"), F.lit(bits))
        marks = asked.select("least").distinct().groupBy(F.bitmap_bucket_number(slot).alias("b"))
        parts = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
        bitmap = texts.sparkSession.sparkContext.broadcast({r["b"]: np.frombuffer(bytes(r["bits"]), np.uint8) for r in parts})
        places = found.select("least", "text", F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("i"))
        found = places.mapInArrow(_marked(bitmap), "least long, text string")
    return found.join(asked, "least")


def tested(pairs: DataFrame, groups: DataFrame, texts: DataFrame, percent: int, k: int, heavy: np.ndarray, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are similar enough, as a written table.

    Texts go to the tests that ask for them, and become sets there: a set of
    hashes takes more room than its text and can't be compressed in a shuffle.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = pairs.join(counts, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")))
    partners = dealt.select(F.col("b").alias("node"), "a", "block", "b")
    leaders = dealt.select(F.col("a").alias("node"), "a", "block", F.lit(None).cast("long").alias("b")).distinct()
    asked = partners.unionByName(leaders).join(groups.select("node", "least", "k1", "k2"), "node").drop("node")
    asked = scratch.written(asked, "asked")
    rows = asked_texts(texts, asked).select("a", "block", "b", "k1", "k2", "text")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))
    links = scratch.written(rows.mapInArrow(_test_blocks(percent, k, heavy), "a long, b long").distinct(), "links")
    scratch.drop(asked)
    return links


def _met_by(rows: DataFrame, what: str, first: str) -> DataFrame:
    """`rows` (token, ...) with `lead`, the least `first` of each token, for tokens that have two `what` or more.

    Frequent shingles, known by their flag bit, are at most HEAVY: their counts are
    aggregated before they are shuffled, and given back by a broadcast. The
    others are found in few enough sets to be sorted by token once.
    """
    facts = {"_lo": F.min(what), "_hi": F.max(what), "lead": F.min(first)}
    by_token = Window.partitionBy("token")
    light = rows.where(F.col("token") < FLAG).withColumns({name: c.over(by_token) for name, c in facts.items()}).where("_lo <> _hi")
    often = rows.where(F.col("token") >= FLAG)
    ends = often.groupBy("token").agg(*(c.alias(name) for name, c in facts.items())).where("_lo <> _hi")
    return light.unionByName(often.join(F.broadcast(ends), "token")).drop("_lo", "_hi")


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id, n_links): one row per document.

    Documents link when 100 * intersection >= percent * union; component_id is
    the smallest id reachable by links. n_links counts the tested links of the
    document's set to other sets.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    heavy = frequent_shingles(texts, "_text", k)

    # 1. one row per document, then one per distinct set
    table = scratch.written(texts.mapInArrow(_prefixes(k, percent, heavy), SETS), "prefixes")
    ids = scratch.written(table.drop("prefix"), "rows")
    grouped = ids.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2", "n")
    groups = scratch.written(grouped.agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "groups")
    with_sets = table.where("prefix IS NOT NULL")
    firsts = groups.where("copies > 1")
    copies = with_sets.select("row", "k1", "k2", "n").join(firsts, ["k1", "k2", "n"]).where("row <> node").select("row")
    copies = scratch.written(copies, "copies")
    # the first row that holds a shingle is always the first of its set, and so a node
    postings = _met_by(with_sets.select("row", F.explode("prefix").alias("token")), "row", "row")
    shared = scratch.written(postings.join(copies, "row", "left_anti").select("token", F.col("row").alias("node"), "lead"), "shared")
    facts = scratch.written(
        with_sets.select(F.col("row").alias("node"), "n", F.size("prefix").alias("p"), F.element_at("prefix", -1).alias("last")), "facts"
    )
    scratch.drop(table, copies)

    # 2. each node and the leader it shares most with
    star = (
        shared.where("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("node").agg(F.max(F.struct("c", "lead")).alias("best"))
        .join(facts.select("node", "p"), "node").where(F.col("best.c") * LEAD_SHARE >= F.col("p"))
        .select(F.col("best.lead").alias("a"), F.col("node").alias("b"))
    )
    star = scratch.written(star, "star")
    links = tested(star, groups, texts, percent, k, heavy, scratch)
    comps = connected_components(links, scratch=scratch)
    scratch.drop(star)

    # 3. pairs of different components: first the best of each component, then all that are left
    for best in (True, False):
        named = shared.select("token", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        still = scratch.written(_met_by(named, "comp", "node"), "open")
        scratch.drop(shared, comps)
        shared = still
        nodes = still.groupBy("node").agg(F.array_sort(F.collect_set("token")).alias("tokens"), F.first("comp").alias("comp"))
        nodes = scratch.written(nodes.join(facts, "node"), "nodes")
        met = scratch.written(still.select("lead", "node").distinct().join(nodes.select("node", "n"), "node"), "met")
        pairs = candidate_pairs(met, nodes, percent, scratch, best)
        scratch.drop(met, nodes)
        found, before = tested(pairs, groups, texts, percent, k, heavy, scratch), links
        links = scratch.written(before.unionByName(found).distinct(), "all_links")
        scratch.drop(pairs, found, before)
        comps = connected_components(links, scratch=scratch)
    scratch.drop(shared, facts)

    # 5. components of nodes, then of the sets that are linked or repeated
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    linked = groups.join(comps, "node", "left").join(degree, "node", "left").where("copies > 1 OR comp IS NOT NULL")
    linked = scratch.written(linked.withColumn("comp", F.coalesce("comp", "node")), "linked")
    least = linked.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = join_hot(linked.select("k1", "k2", "n", "node", "comp", "n_links"), least, ["comp"], "node")
    found = scratch.written(found.select("k1", "k2", "n", "component_id", "n_links"), "found")
    scratch.drop(groups, comps, links, linked)
    return join_hot(ids, found, ["k1", "k2", "n"], "row").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
    )


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s
), u AS (SELECT doc_id, unnest(sh) AS x FROM s
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT n.doc_id, cast(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
"""
