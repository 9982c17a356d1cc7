"""Operator 2, chat formatting: root-to-leaf paths of reply trees.

Nodes point to their parents. Pointers are doubled by iterative self-joins: after round k a node points 2**k steps up and knows
the sum and the number of the scores on the way, until it points beyond a root. The deepest path needs log2(depth) rounds; nodes
that a round brings no nearer to a root hang on a cycle and are left out. A branch's score is the mean of its nodes' scores; the
``branches`` best leaves of each tree (all: None; of equals, the smaller leaf) become a conversation each. Only then are paths
made, and only those of the chosen leaves: the pointer tables, longest steps first, give every ancestor of a leaf exactly once
with its distance.

Template: each turn is ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts each control string, and the escape mark
itself, is escaped reversibly: ``<|`` becomes ``<\\|`` and ``<\\`` becomes ``<\\\\``, so no text, whatever it says, can open or close a
turn. The loss mask is the list of code point spans of the assistants' texts in the formatted string.

Nulls: a null text, role or id of a turn is empty (a null turn sorts first); a null conversation id is a tree of its own; a
parent that does not exist, or is the node itself, makes the node a root; a null score counts as 0; rows without a node are no
nodes. Nodes on a cycle, and all that hang on one, reach no root and are not returned. Of rows that repeat a node, the smallest
by parent and score, and by role and text, counts (repeated turns of linear conversations are nodes of their own, in the order of
turn, role, text). An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, text_slices, tidy_shuffles

#: The template's control strings.
TURN, TEXT, STOP = "<|turn|>", "<|text|>", "<|end|>"
LEARNED_ROLE = "assistant"
_PARSED = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
_ESCAPED = re.compile(r"<\\([|\\])")


def escape(text: str) -> str:
    return text.replace("<\\", "<\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LEARNED_ROLE:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, STOP]
        at += len(head) + len(body) + len(STOP)
    return "".join(parts), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _PARSED.findall(formatted)]


def chains(turns: DataFrame) -> DataFrame:
    """Nodes of linear conversations: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    number = F.row_number().over(order).cast("long")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = rows.select("conv_id", number.alias("node"), "role", "text")
    return numbered.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _tree() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("tree")


def measured(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``tree, conv_id, node, total, depth`` of each node that reaches a root, and the tables ``tree, node, up`` of 1, 2, 4, ... steps."""
    links = nodes.filter("node is not null").groupBy(_tree(), "conv_id", "node").agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("own"))
    known = links.select("tree", "node").alias("p")
    there = (F.col("l.tree") == F.col("p.tree")) & (F.col("l.own.parent") == F.col("p.node")) & (F.col("l.own.parent") != F.col("l.node"))
    joined = links.alias("l").join(known, there, "left")
    state = cut(joined.select("l.tree", "l.conv_id", "l.node", F.col("p.node").alias("up"), F.col("l.own.score").alias("total"), F.lit(1).cast("long").alias("depth")))
    steps, before = [], -1
    # A round that ends no path will never end one: the deepest open node has ancestors at every smaller depth.
    while (left := (open_ := state.filter("up is not null")).count()) and left != before:
        steps.append(open_.select("tree", "node", "up"))
        before = left
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("further"))
        moved = open_.join(above, ["tree", "up"]).select("tree", "conv_id", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("further")).alias("depth"))
        state = cut(state.filter("up is null").union(moved))
    return state.filter("up is null"), steps


def root_paths(nodes: DataFrame, branches: int | None) -> DataFrame:
    """``tree, conv_id, leaf, node, distance, rank``: the nodes of the best branches, ``distance`` steps above the leaf."""
    rooted, steps = measured(nodes)
    leaves = rooted.select("tree", "conv_id", F.col("node").alias("leaf"), (F.col("total") / F.col("depth")).alias("mean"))
    if steps:
        leaves = leaves.join(steps[0].select("tree", F.col("up").alias("leaf")).distinct(), ["tree", "leaf"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    paths = cut(ranked.select("tree", "conv_id", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("distance"), "rank"))
    for k in reversed(range(len(steps))):
        higher = paths.join(steps[k], ["tree", "node"]).select("tree", "conv_id", "leaf", F.col("up").alias("node"), (F.col("distance") + (1 << k)).alias("distance"), "rank")
        paths = cut(paths.union(higher))  # uncut, the plan would double with each round
    return paths


def format_trees(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """``conv_id, rank, leaf, n_turns, formatted, loss_mask`` (an array of start, end) for each chosen branch.

    ``nodes``: ``conv_id, node, parent, role, text, score``.
    """
    with tidy_shuffles(nodes.sparkSession):
        paths = root_paths(nodes, branches)
    empty = F.lit("")
    keyed = nodes.select(_tree(), "node", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    turns = paths.join(keyed, ["tree", "node"])
    gathered = turns.groupBy("tree", "conv_id", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("place"), "role", "text"))).alias("turns"))
    fields = ("place", "role", "text")
    rows = gathered.select("conv_id", "rank", "leaf", *[F.expr(f"transform(turns, t -> t.{c})").alias(c) for c in fields])

    def turns_of(part: pa.RecordBatch) -> Iterator[list[tuple[str, str]]]:
        """Of a node's rows, which follow each other, the first one."""
        for places, roles, texts in zip(*(part.column(c).to_pylist() for c in fields), strict=True):
            yield [(r, t) for before, place, r, t in zip([None, *places], places, roles, texts) if place != before]  # noqa: B905

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                made = [(len(turns), *format_turns(turns)) for turns in turns_of(part)]
                masks = pa.array([[{"start": s, "end": e} for s, e in mask] for _, _, mask in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                columns = [part.column(c) for c in ("conv_id", "rank", "leaf")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _, _ in made], pa.int64()), pa.array([f for _, f, _ in made], pa.string()), masks], ["conv_id", "rank", "leaf", "n_turns", "formatted", "loss_mask"])

    return rows.mapInArrow(work, "conv_id long, rank int, leaf long, n_turns long, formatted string, loss_mask array<struct<start: bigint, end: bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "formatted"):
            rows = []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_mask").mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
