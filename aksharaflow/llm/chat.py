"""Chat formatting over reply trees."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Fixed control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Where a control string of this or another common template begins: a backslash goes behind its first character.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(c: Column) -> Column:
    """Doubles backslashes, then breaks every control string; unescape() gives the text back."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), CONTROL, r"$0\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _escape_role(c: Column) -> Column:
    """escape(), and a backslash and an n for a line break, which would end the role."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def linear_tree(turns: DataFrame) -> DataFrame:
    """Conversations given as rows by turn, as trees in which each turn replies to the one before.

    Rows that share a turn follow each other by role and text; null roles are empty, null texts are empty."""
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("msg", F.row_number().over(w)).select("conv_id", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _key(c: str = "conv_id") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (k, msg, to), the i-th with the 2 ** i-th message above each, and (k, msg, n, score) of every message that has
    a root: the number of messages of its path and their score. A self-join of the last table makes each next one."""
    ids = nodes.select("k", F.col("msg").alias("parent"), F.lit(True).alias("there"))
    up = staged(nodes.join(ids, ["k", "parent"], "left").select("k", "msg", F.when(F.col("there"), F.col("parent")).alias("to"), F.lit(1).cast("long").alias("n"), "score"), "branches")
    longest, jumps = nodes.groupBy("k").count().agg(F.max("count")).head()[0] or 0, []
    for _ in range((longest - 1).bit_length()):
        open_ = up.where(F.col("to").isNotNull())
        if open_.isEmpty():
            break
        jumps.append(open_.select("k", "msg", "to"))
        over = up.select("k", F.col("msg").alias("to"), F.col("to").alias("on"), F.col("n").alias("more"), F.col("score").alias("plus"))
        further = open_.join(over, ["k", "to"]).select("k", "msg", F.col("on").alias("to"), (F.col("n") + F.col("more")).alias("n"), (F.col("score") + F.col("plus")).alias("score"))
        up = staged(up.where(F.col("to").isNull()).unionByName(further), "branches")
    return jumps, up.where(F.col("to").isNull()).select("k", "msg", "n", "score")


def branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Root-to-leaf paths of messages (conv_id, msg, parent, role, text, score), a row for each message on each path: k,
    conv_id, leaf, score, rank, pos, msg.

    Self-joins double the known part of every path upward without keeping it, so that a path of d messages takes about
    log2(d) of them and a row a message. A branch scores the sum over its messages; rank 1 is the best of its
    conversation, ties go to the smaller leaf; only branches ranked up to best (all, if None) are then spelt out, by the
    same jumps. A parent that isn't there makes its reply a root; null scores count as 0; replies that lead into a cycle
    give no path. Rows with a null conv_id are one conversation. msg must be unique in its conversation; an empty table
    gives no rows."""
    nodes = messages.select(_key().alias("k"), "conv_id", "msg", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    jumps, rooted = _jumps(nodes.drop("conv_id"))
    leaf = nodes.select("k", "conv_id", "msg").join(nodes.select("k", F.col("parent").alias("msg")).distinct(), ["k", "msg"], "left_anti")
    ends = leaf.join(rooted, ["k", "msg"]).withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), "msg")))
    ends = ends if best is None else ends.where(F.col("rank") <= best)
    rows = ends.select("k", "conv_id", F.col("msg").alias("leaf"), "score", "rank", (F.col("n") - 1).alias("pos"), "msg")
    for i, jump in enumerate(jumps):
        rows = staged(rows, "paths")
        rows = rows.unionByName(rows.join(jump, ["k", "msg"]).select("k", "conv_id", "leaf", "score", "rank", (F.col("pos") - (1 << i)).alias("pos"), F.col("to").alias("msg")))
    return rows


def format_chats(messages: DataFrame, best: int = 1, loss_role: str = "assistant") -> DataFrame:
    """The best branches of each reply tree, a conversation each: conv_id, leaf, rank, formatted, loss_spans.

    A turn is START, role, newline, text, END, newline, with escaped role and text, line breaks of roles too, so that any
    string survives.
    loss_spans are (start, length) in code points of formatted: the escaped text of each turn by loss_role. Null roles
    and texts are empty; texts may be of any length. Other columns are ignored, whatever their names."""
    at = branches(messages, best)
    role, text = _escape_role(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")
    turns = at.join(messages.select(_key().alias("k"), "msg", F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("on"), role, text), ["k", "msg"])
    before, size = F.concat(F.lit(START), "role", F.lit("\n")), F.char_length("text").cast("long")
    whole = F.concat(before, "text", F.lit(END + "\n"))
    w = Window.partitionBy("k", "leaf", "rank").orderBy("pos")
    turns = turns.select("k", "conv_id", "leaf", "rank", "pos", whole.alias("whole"), "on", size.alias("length"), (F.sum(F.char_length(whole)).over(w) - len(END) - 1 - size).alias("start"))
    row = F.array_sort(F.collect_list(F.struct("pos", "whole", "on", "start", "length"))).alias("turns")
    spans = F.transform(F.filter("turns", lambda t: t["on"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return turns.groupBy("k", "leaf", "rank").agg(F.first("conv_id").alias("conv_id"), row).select("conv_id", "leaf", "rank", F.array_join("turns.whole", "").alias("formatted"), spans.alias("loss_spans"))


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(_unescape_role(r), unescape(t)) for r, t in TURN.findall(formatted)]


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_chats(chats: DataFrame) -> DataFrame:
    """Reads formatted conversations back; digests of their turns and of the text under the loss mask."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(batch["conv_id"], batch["formatted"], batch["loss_spans"], strict=True):
                turns = parse_chat(text)
                loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")]).astype({"conv_id": "Int64"})

    return chats.select("conv_id", "formatted", "loss_spans").mapInPandas(read, DIGEST)
