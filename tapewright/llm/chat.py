r"""Chat formatting of reply trees.

Nodes (conversation, node, parent, role, text, score) form trees. Stretches in
which each node is the only reply to the node numbered before it are first made
into one run by a window, so that conversations without branches need no join
at all. Iterative self-joins then double each run's jump (its 2^j-th ancestor)
together with the scores gained on the way, so a leaf's root-to-leaf path is
known after log2(depth) joins however long a chain is. The leaves of a
conversation are ranked by the summed score of their paths, the best `branches`
are chosen, and the runs of a chosen path are marked by joining the jumps again,
the longest first. Each chosen path becomes one formatted conversation.

Template: a turn is `<|role|>` + role + newline + text + `<|end|>` + newline.
Inside roles and texts a backslash is doubled and a backslash is put after the
first character of every control string of this and of other common templates
(CONTROL), so that none of them occurs in formatted text but as markup; taking
the backslashes away gives back the text, whatever it was. The loss mask covers
the texts of assistant turns, as (start, length) in code points.

Null texts and roles count as empty. Nodes whose parent is missing are roots;
of rows that repeat a node the first by parent and score places it, and all are
kept, in the order of role and text. Nodes on or below a cycle of parents have no
root and so no path. A conversation without rows has no result, nor have rows of
a null conversation. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Control strings of common chat templates (fixed values).
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>"]
#: A newline in a role; like all markup it can't occur in escaped text.
NEWLINE = "<|newline|>"
ROLE, END = "<|role|>", "<|end|>\n"
_PATTERN = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
TURN = re.compile(r"<\|role\|>(.*?)\n(.*?)<\|end\|>\n", re.DOTALL)


def escaped(c: Column) -> Column:
    doubled = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({_PATTERN})", "$1\\\\")


def escape(text: str) -> str:
    return re.sub(_PATTERN, lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def linear_tree(conversations: DataFrame) -> DataFrame:
    """Conversations of ordered turns as trees: each turn replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def runs(tree: DataFrame) -> DataFrame:
    """(conv_id, node, parent, score, head, offset): each node with the first node of its run and its place in it."""
    order = Window.partitionBy("conv_id").orderBy("node")
    first = F.min(F.struct("parent", "score"))
    ids = tree.where("conv_id IS NOT NULL AND node IS NOT NULL").groupBy("conv_id", "node").agg(first.alias("x")).select("conv_id", "node", "x.*")
    replies = F.when(F.col("parent").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("conv_id", "parent")))
    goes_on = F.coalesce((F.lag("node").over(order) == F.col("parent")) & (F.col("_replies") == 1), F.lit(False))
    found = ids.withColumn("_replies", replies).withColumn("_n", F.row_number().over(order)).withColumn("_head", ~goes_on)
    head = F.max(F.when(F.col("_head"), F.struct("_n", "node"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("_h", head).select(
        "conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("_h.node").alias("head"),
        (F.col("_n") - F.col("_h._n")).cast("long").alias("offset"),
    )


def best_paths(tree: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, branch, node, depth): the nodes of the best-scored root-to-leaf paths.

    Equal scores: the path whose last run has the smaller first node comes first.
    """
    scratch = Scratch(tree.sparkSession)
    nodes = scratch.written(runs(tree), "nodes")
    whole = nodes.groupBy("conv_id", "head").agg(F.sum("score").alias("gain"), F.count(F.lit(1)).alias("steps"))
    # runs that reply to a node that exists; a run's last node is the only one that other runs can reply to
    replies = nodes.where("node = head AND parent IS NOT NULL").select("conv_id", F.col("node").alias("_from"), F.col("parent").alias("node"))
    above = replies.join(nodes.select("conv_id", "node", F.col("head").alias("up")), ["conv_id", "node"]).select("conv_id", F.col("_from").alias("head"), "up")
    base = scratch.written(whole.join(above, ["conv_id", "head"], "left"), "runs")
    most = base.groupBy("conv_id").agg(F.count("up").alias("n")).agg(F.max("n")).first()[0] or 0
    # jumps[j]: runs with their 2^j-th ancestor; gain and steps: of the runs passed, this one included.
    # A run whose root is reached is finished; only the others are joined again.
    jumps: list[DataFrame] = []
    finished, active = base.where("up IS NULL"), base.where("up IS NOT NULL")
    for _ in range(most.bit_length()):
        jumps.append(active)
        further = active.join(
            active.unionByName(finished).select(
                "conv_id", F.col("head").alias("up"), F.col("up").alias("up2"), F.col("gain").alias("g2"), F.col("steps").alias("s2")
            ),
            ["conv_id", "up"],
        )
        further = scratch.written(
            further.select(
                "conv_id", "head", F.col("up2").alias("up"), (F.col("gain") + F.col("g2")).alias("gain"), (F.col("steps") + F.col("s2")).alias("steps")
            ),
            "jumps",
        )
        finished, active = finished.unionByName(further.where("up IS NULL")), further.where("up IS NOT NULL")
        if not active.limit(1).count():
            break
    leaves = finished
    if most:
        leaves = finished.join(base.where("up IS NOT NULL").select("conv_id", F.col("up").alias("head")).distinct(), ["conv_id", "head"], "left_anti")
    order = Window.partitionBy("conv_id").orderBy(F.desc("gain"), "head")
    marked = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches).select("conv_id", "branch", "head")
    for level in reversed(jumps):
        reached = marked.join(level.select("conv_id", "head", "up"), ["conv_id", "head"]).select("conv_id", "branch", F.col("up").alias("head"))
        marked = scratch.written(marked.unionByName(reached), "marked")
    # a run's first node comes after all steps of the runs above it
    begin = finished.join(whole.select("conv_id", "head", F.col("steps").alias("_own")), ["conv_id", "head"]).select(
        "conv_id", "head", (F.col("steps") - F.col("_own") + 1).alias("_begin")
    )
    return (
        marked.distinct().join(begin, ["conv_id", "head"]).join(nodes.select("conv_id", "head", "node", "offset"), ["conv_id", "head"])
        .select("conv_id", "branch", "node", (F.col("_begin") + F.col("offset")).alias("depth"))
    )


def format_paths(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, branch, formatted, loss): one conversation per chosen path."""
    role, text = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), escaped(F.col("text"))
    turns = paths.join(tree.select("conv_id", "node", "role", "text"), ["conv_id", "node"]).select(
        "conv_id", "branch", F.struct(
            "depth", "node", F.concat(F.lit(ROLE), role, F.lit("\n")).alias("head"), text.alias("body"),
            (F.coalesce("role", F.lit("")) == "assistant").alias("scored"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    spans = F.expr(
        f"""aggregate(ts, named_struct('at', 0L, 'spans', cast(array() AS array<struct<start: bigint, length: bigint>>)),
        (x, t) -> named_struct('at', x.at + length(t.head) + length(t.body) + {len(END)},
            'spans', if(t.scored, concat(x.spans, array(named_struct('start', x.at + length(t.head), 'length', cast(length(t.body) AS bigint)))), x.spans)),
        x -> x.spans)"""
    )
    body = F.concat_ws("", F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    return whole.select("conv_id", "branch", body.alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations and their loss masks say."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = [(unescape(r.replace(NEWLINE, "\n")), unescape(t)) for r, t in TURN.findall(text)]
                masked = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in loss)
                digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
                values = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(masked), digest(masked), len(text))
                for c, v in zip(out, values):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        parse, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
