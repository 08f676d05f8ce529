"""Chat formatting of reply trees.

Messages name the message they reply to. Root-to-leaf paths are enumerated by self joins that double: each message
knows its ancestor 1, 2, 4, ... steps up, so a tree of depth d takes log2(d) joins, not d. The leaves of a tree are
ranked by the mean score of their path (ties: the longer path, then the lesser leaf); the best ``branches`` are
formatted, each as one conversation.

A formatted conversation is a sequence of turns. A turn reads ``<|role|>``, its text, ``<|end|>``; the role and text are
escaped so that no control string stands inside: the escape character U+241B becomes ``U+241B 0``, and ``<|`` becomes
``<U+241B 1|``; decoding reverses that exactly. The loss mask covers the texts of assistant turns.

Paths are rows (one per turn) sorted within a conversation, never one array per tree; digests are built as the
rows stream by, so a conversation of any length takes bounded memory.

Null text is empty text; a null role is the role "". Messages without a tree form one tree; messages without an id
cannot be replied to or told apart and take no part. Messages with a missing parent are roots; a cycle raises an
error. Repeated (tree, id) rows count once (the least text stays). Other columns are ignored.
"""

import hashlib
import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from revloom.llm.words import text_of
from revloom.plans.runtime import Scratch

ESCAPE = "␛"
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
ASSISTANT = "assistant"
MAX_DOUBLINGS = 40


def escape(text: str) -> str:
    return text.replace(ESCAPE, ESCAPE + "0").replace(OPEN, f"<{ESCAPE}1|")


def unescape(text: str) -> str:
    return text.replace(f"<{ESCAPE}1|", OPEN).replace(ESCAPE + "0", ESCAPE)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The formatted turn, and start and end of the loss within it (equal: none)."""
    # the role ends at the first "|>", so that is escaped there as well
    name = escape(role or "").replace("|", ESCAPE + "2")
    head, body = f"{OPEN}{name}{CLOSE}", escape(text or "")
    stop = len(head) + len(body)
    return head + body + END, (len(head) if role == ASSISTANT else stop), stop


_TURN = re.compile(r"<\|(.*?)\|>(.*?)<\|end\|>", re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, or of any whole number of its turns."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1].replace(ESCAPE + "2", "|")), unescape(m[2])))
        at = m.end()
    return turns


def ancestors(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, id, depth, total): distance from the root and sum of scores on the path, by doubling."""
    known = messages.select("tree", F.col("id").alias("parent"), F.lit(True).alias("_known"))
    state = scratch.settle(messages.select("tree", "id", "parent", "score").join(
        known, ["tree", "parent"], "left").select(
        "tree", "id", F.when(F.col("_known"), F.col("parent")).alias("up"),
        F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("depth"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("total")))
    finished: list[DataFrame] = []
    for _ in range(MAX_DOUBLINGS):
        every = state
        for part in finished:
            every = every.unionByName(part)
        # only messages that are still under way are joined again
        open_ = state.filter(F.col("up").isNotNull())
        if open_.isEmpty():
            return every.select("tree", "id", "depth", "total")
        above = every.select("tree", F.col("id").alias("up"), F.col("up").alias("_up"),
                             F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        # the sum covers the steps walked so far, the far end not included while it has ancestors
        finished.append(state.filter(F.col("up").isNull()))
        state = scratch.settle(open_.join(above, ["tree", "up"]).select(
            "tree", "id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"),
            (F.col("total") + F.col("_total")).alias("total")))
    raise ValueError("messages reply to each other in a circle")


def path_members(messages: DataFrame, leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, leaf, id) for every message on the path of each leaf: jumps of 1, 2, 4, ... replies, largest
    first, double the found part of a path in every join."""
    parent = messages.select("tree", "id", F.col("parent").alias("up")).filter(F.col("up").isNotNull())
    jumps = [scratch.settle(parent.join(messages.select("tree", F.col("id").alias("up")), ["tree", "up"]).select(
        "tree", "id", "up"))]
    while len(jumps) < MAX_DOUBLINGS and not jumps[-1].isEmpty():
        far = jumps[-1].select("tree", F.col("id").alias("up"), F.col("up").alias("_far"))
        jumps.append(scratch.settle(jumps[-1].join(far, ["tree", "up"]).select(
            "tree", "id", F.col("_far").alias("up"))))
    found = leaves.select("tree", F.col("id").alias("leaf"), "id")
    for jump in reversed(jumps[:-1]):
        # settled, since every step reads the one before twice
        found = scratch.settle(found)
        found = found.union(found.join(jump, ["tree", "id"]).select(
            "tree", "leaf", F.col("up").alias("id")))
    return found


def ranked_paths(messages: DataFrame, scratch: Scratch, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, position, role, text) of the chosen paths.

    ``messages``: (tree, id, parent, role, text, score).
    """
    # inside a struct a null tree joins like any other
    named = messages.filter(F.col("id").isNotNull()).withColumn("tree", F.struct(F.col("tree").alias("name")))
    once = scratch.settle(named.groupBy("tree", "id").agg(
        F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "id", "m.*"))
    placed = scratch.settle(ancestors(once, scratch))
    parents = once.select("tree", F.col("parent").alias("id")).filter(F.col("id").isNotNull()).distinct()
    leaves = placed.join(parents, ["tree", "id"], "left_anti")
    best = W.partitionBy("tree").orderBy((F.col("total") / (F.col("depth") + 1)).desc(),
                                         F.col("depth").desc(), "id")
    chosen = scratch.settle(leaves.withColumn("branch", F.row_number().over(best)).filter(
        F.col("branch") <= branches))
    members = path_members(once, chosen, scratch)
    return (members.join(placed.select("tree", "id", F.col("depth").alias("position")), ["tree", "id"])
            .join(once.select("tree", "id", "role", "text"), ["tree", "id"])
            .join(chosen.select("tree", F.col("id").alias("leaf"), "branch"), ["tree", "leaf"])
            .select(F.col("tree.name").alias("tree"), "leaf", "branch", "position", "role", "text"))


def _format(batches):
    for batch in batches:
        turns = [format_turn(r, t) for r, t in zip(text_of(batch, "role"), text_of(batch, "text"))]
        columns = [batch.column(c) for c in ("tree", "leaf", "branch", "position")]
        texts, starts, ends = (list(c) for c in zip(*turns)) if turns else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(texts, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
            names=["tree", "leaf", "branch", "position", "formatted", "loss_start", "loss_end"])


def format_paths(paths: DataFrame) -> DataFrame:
    """The turns of each chosen path as formatted text; a conversation is their concatenation by position.

    ``loss_start`` and ``loss_end`` mark the code points of the turn that are learnt.
    """
    kinds = ", ".join(f"{c} {paths.schema[c].dataType.simpleString()}"
                      for c in ("tree", "leaf", "branch", "position"))
    return paths.select("tree", "leaf", "branch", "position", "role", "text").mapInArrow(
        _format, f"{kinds}, formatted string, loss_start long, loss_end long")


def formatted_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Formatted turns of the best ``branches`` paths of every tree; settled."""
    with Scratch(messages.sparkSession) as scratch:
        return scratch.settle(format_paths(ranked_paths(messages, scratch, branches)), keep=True)


class _Digest:
    """What is read back from one conversation, turn by turn."""

    def __init__(self):
        self.turns, self.all, self.loss = 0, hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.chars = 0

    def add(self, formatted: str, start: int, end: int):
        for role, text in read_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        learnt = unescape(formatted[start:end])
        self.loss.update(learnt.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(learnt)
        self.chars += len(formatted)


def _read_back(batches, kind: pa.DataType):
    """Rows come sorted by conversation and position; one digest is open at a time."""
    key, open_ = None, None
    names = ["tree", "branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [kind, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def row():
        return (*key, open_.turns, open_.all.hexdigest(), open_.loss_chars, open_.loss.hexdigest(), open_.chars)

    for batch in batches:
        done = []
        for tree, branch, text, start, end in zip(*(text_of(batch, c) for c in (
                "tree", "branch", "formatted", "loss_start", "loss_end"))):
            if (tree, branch) != key:
                if open_ is not None:
                    done.append(row())
                key, open_ = (tree, branch), _Digest()
            open_.add(text, start, end)
        columns = list(zip(*done)) if done else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row(), kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, parsed from their text."""
    kind = formatted.schema["tree"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    rows = formatted.repartition("tree", "branch").sortWithinPartitions("tree", "branch", "position")
    return rows.mapInArrow(
        partial(_read_back, kind=arrow),
        f"tree {kind.simpleString()}, branch int, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long")
