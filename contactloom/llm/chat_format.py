"""Chat formatting of reply trees.

Messages form trees by (tree, node, parent).  Iterative self-joins enumerate the root-to-leaf paths:
jump tables of 1, 2, 4, ... replies up are built by joining a table with itself, and the
leaves then walk up through them from the longest jump to the shortest, so a branch of d turns takes
about 2 log2(d) joins.  Branches are ranked by mean score and each chosen path becomes one
conversation.

The template is ``<|turn|>role<|text|>text<|end|>\\n`` for each turn.  Control strings inside roles
and texts get one backslash after their first character, and those that already have backslashes
there one more, so that reading back is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, persist, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and other widespread templates.
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>"]
_INSIDE = regex.compile("|".join(rf"(?<={regex.escape(c[0])})\\*(?={regex.escape(c[1:])})" for c in CONTROL))
_ESCAPED = regex.compile("|".join(rf"(?<={regex.escape(c[0])})\\+(?={regex.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    """``text`` without any control string, reversibly."""
    return _INSIDE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _ESCAPED.sub(lambda m: m[0][1:], text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss mask: spans (start, length) of ``learn``'s texts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == learn:
            spans.append((at + len(head), len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(f"{END}\n")[:-1]:
        role, _, text = part.removeprefix(TURN).partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def branch_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, up, node) for each message on each chosen root-to-leaf path.

    ``messages``: tree, node (one row each), parent (null or unknown for roots), score.  ``up``
    counts replies from the leaf.  Branches of a tree rank by mean score, then by leaf; ``branches``
    keeps the first so many of each tree.  Messages on a parent cycle, and replies below one, hang
    under no root and are left out.
    """
    keyed = messages.select(F.struct("tree", "node").alias("node"), F.struct("tree", "parent").alias("parent"), F.col("parent").isNull().alias("top"), F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    keyed = persist(keyed, "chat-nodes")
    there = keyed.select(F.col("node").alias("parent")).distinct()
    links = keyed.where(~F.col("top")).join(there, "parent", "left_semi")
    jumps = [persist(links.select("node", F.col("parent").alias("to"), F.lit(1).cast("long").alias("up")), "chat-jump")]
    n = keyed.count()
    while True:
        now = jumps[-1]
        on = now.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("up").alias("more"))
        further = persist(now.join(on, "to").select("node", F.col("far").alias("to"), (F.col("up") + F.col("more")).alias("up")), "chat-jump")
        if further.isEmpty():
            discard(further)
            break
        if 1 << len(jumps) >= n:  # no path is so long: these nodes lead into a cycle
            keyed, *jumps = (persist(x.join(further.select("node"), "node", "left_anti"), "chat-acyclic") for x in (keyed, *jumps))
            break
        jumps.append(further)
    return _walk(keyed, jumps, branches)


def _walk(keyed: DataFrame, jumps: list[DataFrame], branches: int | None) -> DataFrame:
    """Paths from the leaves of acyclic nodes up through the jumps, longest first, and their ranks."""
    replied = keyed.where(~F.col("top")).select(F.col("parent").alias("node")).distinct()
    path = keyed.select("node").join(replied, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for jump in reversed(jumps):
        step = jump.select("node", "to", F.col("up").alias("more"))
        further = path.join(step, "node").select("leaf", F.col("to").alias("node"), (F.col("up") + F.col("more")).alias("up"))
        path = persist(path.union(further), "chat-path")
    scored = path.join(keyed.select("node", "score"), "node").groupBy("leaf").agg(F.avg("score").alias("score"))
    # With a bound, each task first keeps its own best branches of a tree; without one a tree's
    # leaves (not their texts) are sorted together.
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("leaf.tree").orderBy(F.desc("score"), "leaf.node")))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    path = path.join(persist(ranked.select("leaf", "rank"), "chat-ranks"), "leaf")
    return path.select(F.col("leaf.tree").alias("tree"), F.col("leaf.node").alias("leaf"), "rank", "up", F.col("node.node").alias("node"))


def format_trees(messages: DataFrame, branches: int | None = None, learn: str = "assistant") -> DataFrame:
    """One row per chosen branch: tree, leaf, rank, formatted, loss (spans of the loss mask).

    ``messages``: tree, node, parent, role, text, score.  Null roles and texts are empty.  Trees
    may have null ids.  Of rows with equal tree and node the least (by parent, role, text, score)
    counts; extra columns are not touched.  A conversation is one output row, so one task must hold
    one branch.
    """
    rest = ("parent", "role", "text", "score")
    messages = messages.groupBy("tree", "node").agg(F.min(F.struct(*rest)).alias("x")).select("tree", "node", *(f"x.{c}" for c in rest))
    messages = persist(messages, "chat-messages")
    path = branch_paths(messages, branches)
    said = messages.select(F.struct("tree", "node").alias("key"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = path.withColumn("key", F.struct("tree", "node")).join(said, "key")
    grouped = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct(F.negative("up").alias("at"), "role", "text"))).alias("turns"))

    @F.pandas_udf("formatted string, loss array<struct<start:long,length:long>>")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in turns], learn) for turns in batch]
            yield pd.DataFrame({"formatted": [m[0] for m in made], "loss": [[{"start": a, "length": n} for a, n in m[1]] for m in made]})

    return grouped.select("tree", "leaf", "rank", make("turns").alias("x")).select("tree", "leaf", "rank", "x.formatted", "x.loss")


def threads(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) as reply trees of one branch: rows of one
    conversation in the order of turn, role and text, each a reply to the one before it, scored by
    its length in characters.  Repeated rows and null turns (first) count as turns of their own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"))


def read_formatted(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns and digests, all read back from the formatted text and its loss mask."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def digest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, masks in batches:
            rows = []
            for text, mask in zip(texts, masks, strict=True):
                turns = read_back(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in mask)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(F.col("tree").alias("conv_id"), digest("formatted", "loss").alias("x")).select("conv_id", "x.*")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``conversations`` table and one conversation of control strings, formatted."""
    tricky = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    formatted = persist(format_trees(threads(rows.union(more)), branches=1), "chat-formatted")
    return read_formatted(formatted)
