"""Chat formatting of reply trees: root-to-leaf paths, ranked by score, each chosen one a conversation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonspark.llm.scratch import Scratch

#: The template: ``### Role: text</turn>\n``. Fixed values.
LABELS = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"

_ROLES = {v: k for k, v in LABELS.items()}
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_TURN = re.compile(r"### ([^:\n]*): ((?:[^\\]|\\\\|\\###|\\</turn>)*?)</turn>\n")


def escape(text: str) -> str:
    """Put a backslash before every backslash and control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the code-point spans of the (escaped) texts of role ``learn``."""
    out, spans, at = [], [], 0
    for role, text in turns:
        label = LABELS.get(role) or "=" + quote(role, safe=" ")
        body, head = escape(text), f"{OPEN}{label}{BETWEEN}"
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + CLOSE)
        at += len(out[-1])
    return "".join(out), spans


def parse(conversation: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(conversation):
        m = _TURN.match(conversation, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        turns.append((_ROLES.get(m[1]) or unquote(m[1][1:]), unescape(m[2])))
        at = m.end()
    return turns


def branches(nodes: DataFrame, scratch: Scratch, *, best: int | None) -> DataFrame:
    """``(tree, leaf, node, back, rank)`` of the ``best`` root-to-leaf paths of every tree by mean score.

    ``nodes(tree, node, parent, score)``. Jumps of 1, 2, 4 ... steps are joined with themselves until none
    is left, then the paths with each of them, so depth d takes log2(d) rounds, whatever d is. A node whose
    parent is missing is a root. A jump of as many steps as the largest tree has nodes ends in a cycle:
    rows in or below one have no root and give no path. Of a repeated node's parents the least counts.
    """
    here = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent")).distinct()
    jumps = scratch.table(here.where("parent is not null").join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")), "jumps")
    parents = jumps.select("tree", F.col("up").alias("node")).distinct()
    paths = here.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")).distinct()
    most, levels = here.groupBy("tree").count().agg(F.max("count")).first()[0] or 0, []
    while 1 << len(levels) < most and not jumps.isEmpty():
        levels.append(jumps)
        upper = jumps.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        jumps = scratch.table(jumps.join(upper, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")), "jumps")
    if not jumps.isEmpty():
        paths = paths.join(jumps.select("tree", "node"), ["tree", "node"], "left_anti")
    for level, jumps in enumerate(levels):
        more = paths.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << level)).alias("back"))
        paths = scratch.table(paths.unionByName(more), "paths")
    scores = paths.join(here.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    ranked = ranked.where(F.col("rank") <= best) if best else ranked
    return paths.join(ranked.select("tree", "leaf", "rank"), ["tree", "leaf"])


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [render([(t["role"] or "", t["text"] or "") for t in turns]) for turns in batch.column(2).to_pylist()]
        spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in made], pa.string()), spans], names=["tree", "rank", "conversation", "loss_spans"])


def format_trees(messages: DataFrame, *, tree: Column, node: Column, parent: Column, role: Column, text: Column, score: Column | None = None, best: int | None = 1) -> DataFrame:
    """``(tree, rank, conversation, loss_spans)`` of the best branches of every reply tree.

    Null role and text are empty. Trees are named by strings, a null name is the tree ``null``. Repeated
    rows of one node are repeated turns, ordered by role and text. A conversation is one row, as its result is: it is
    collected in one task, and memory is bounded by the longest branch, whatever its texts' lengths. Ties in score go to the
    smaller leaf. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    rows = messages.select(
        F.coalesce(tree.cast("string"), F.lit("null")).alias("tree"), node.cast("long").alias("node"), parent.cast("long").alias("parent"),
        (score if score is not None else F.lit(0.0)).cast("double").alias("score"), role.alias("role"), text.alias("text"),
    )
    rows = scratch.table(rows, "messages")
    chosen = branches(rows.select("tree", "node", "parent", "score"), scratch, best=best).select("tree", "node", "leaf", "rank", "back")
    turns = chosen.join(rows.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = turns.groupBy("tree", "rank", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))).alias("turns"))
    return turns.select("tree", "rank", "turns").mapInArrow(_rendered, "tree string, rank int, conversation string, loss_spans array<struct<start:long,end:long>>")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        turns = [[{"role": r, "text": t} for r, t in parse(c)] for c in texts]
        loss = ["".join(unescape(c[s["start"] : s["end"]]) for s in spans) for c, spans in zip(texts, batch.column(3).to_pylist(), strict=True)]
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        chars = pa.array([len(c) for c in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(turns, kind), pa.array(loss, pa.string()), chars], names=["tree", "rank", "turns", "loss", "chars"])


def read_back(conversations: DataFrame) -> DataFrame:
    """``(tree, rank, turns, loss, chars)``: what formatted conversations hold."""
    return conversations.mapInArrow(_parsed, "tree string, rank int, turns array<struct<role:string,text:string>>, loss string, chars long")
