"""Conversation structure repair: turns stream in order through a dynamic program over four states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS

#: What the edits cost; CUT comes on top for a truncated turn that stays.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: What a repaired prefix ends with: nothing yet, a system, user or assistant turn. Whose turn is next, in each case.
STATES, DUE = "-sua", {"-": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")
#: Edits in the order that settles ties; two bits of a turn's backpointers name one for each state.
EDITS = "DIKR"
#: What is left to pay after the last turn: a conversation may be empty or end with an assistant turn.
END = (0, 2 * INSERT, INSERT, 0)


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of turns with known faults, by crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its text,
    2 removes its [.!?], 3 repeats it, 4 makes its role user. Nulls count as one space, but ids and turns stay null."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), h.alias("h")).where("h <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))).drop("col")


def _fault(nth: Column) -> Column:
    """Index into FAULTS of the first fault of a turn that is the nth of its role and text."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", 1).when(nth > 1, 2).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)


class Steps(dict):
    """(costs to go after a turn, its initial, its fault) -> (costs to go before it, choices). Costs are relative to the
    smallest, so that few cases ever occur, however long a conversation is."""

    def __missing__(self, key: tuple) -> tuple[tuple, int]:
        after, initial, fault = key
        to_go = dict(zip(STATES, after, strict=True))
        stays = fault not in (1, 2)
        extra = CUT if fault == 3 else 0
        ways: dict[str, dict[str, int]] = {}
        for s in STATES:
            ways[s] = {"D": DELETE + to_go[s]}
            if stays and (initial == DUE[s] or (s, initial) == ("-", "s")):
                ways[s]["K"] = extra + to_go[initial]
            if stays:
                ways[s]["R"] = REROLE + extra + to_go[DUE[s]]
        best = {s: min(w.values()) for s, w in ways.items()}
        for _ in STATES:  # an insertion leads to another state in front of the same turn
            best = {s: min(best[s], INSERT + best[DUE[s]]) for s in STATES}
        choices = 0
        for i, s in enumerate(STATES):
            ways[s]["I"] = INSERT + best[DUE[s]]
            choices |= EDITS.index(min(e for e, cost in ways[s].items() if cost == best[s])) << 2 * i
        least = min(best.values())
        self[key] = found = tuple(best[s] - least for s in STATES), choices
        return found


def _point_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds choices to turns that come last turn first; what is carried from batch to batch is four costs."""
    steps, at, costs = Steps(), None, END
    for batch in batches:
        choices = []
        for conv, initial, fault in zip(zip(batch["no_conv"], batch["conv"]), batch["initial"], batch["fault"], strict=True):
            if conv != at:
                at, costs = conv, END
            costs, found = steps[costs, initial, fault]
            choices.append(found)
        yield batch.assign(choices=choices)


EDIT = "no_conv boolean, conv long, step long, edit string, no_turn boolean, turn long, role string, text string, was string, fault int, cost int"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits of turns that come first turn first, by their choices. A conversation's last insertions come before the next's first turn."""
    at, state, step, rows = None, "-", 0, []

    def put(edit: str, turn: tuple, role: str, text: str, was: str | None, fault: int, cost: int) -> None:
        nonlocal step
        rows.append((*at, step, edit, *turn, role, text, was, fault, cost))
        step += 1

    def insert() -> None:
        nonlocal state
        state = DUE[state]
        put("I", (True, 0), ROLES[state], "", None, 0, INSERT)

    names = [c.split()[0] for c in EDIT.split(", ")]
    for batch in batches:
        for no_conv, conv, no_turn, turn, role, text, initial, fault, choices in zip(*(batch[c] for c in ("no_conv", "conv", "no_turn", "turn", "role", "text", "initial", "fault", "choices")), strict=True):
            if at != (no_conv, conv):
                while at and state in "su":
                    insert()
                at, state, step = (no_conv, conv), "-", 0
            while (edit := EDITS[choices >> 2 * STATES.index(state) & 3]) == "I":
                insert()
            if edit == "D":
                put("D", (no_turn, turn), role, text, role, fault, DELETE)
                continue
            state = initial if edit == "K" else DUE[state]
            put(edit, (no_turn, turn), role if edit == "K" else ROLES[state], text, role, fault, REROLE * (edit == "R") + CUT * (fault == 3))
        yield pd.DataFrame(rows, columns=names)
        rows.clear()
    while at and state in "su":
        insert()
    yield pd.DataFrame(rows, columns=names)


def _ordered_edits(turns: DataFrame) -> DataFrame:
    """EDIT rows; each conversation's lie in one partition, in order."""
    some = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv"), F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"),
    )
    rows = rows.repartition("no_conv", "conv")
    same = Window.partitionBy("no_conv", "conv", "role", "text").orderBy("has_turn", "turn")  # needs no further shuffle
    rows = rows.withColumn("nth", F.row_number().over(same)).withColumns({"initial": F.substring("role", 1, 1), "fault": _fault(F.col("nth")), "no_turn": ~F.col("has_turn")})
    order = ["has_turn", "turn", "role", "text", "nth"]
    rows = rows.sortWithinPartitions("no_conv", "conv", *(F.desc(c) for c in order))
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(_point_back, f"{schema}, choices int").sortWithinPartitions("no_conv", "conv", *order).mapInPandas(_walk, EDIT)


def _shown(edits: DataFrame) -> DataFrame:
    null = lambda flag, c: F.when(~F.col(flag), F.col(c))
    fault = F.element_at(F.array(*map(F.lit, FAULTS)), F.col("fault") + 1)
    return edits.select(null("no_conv", "conv").alias("conv_id"), "step", "edit", null("no_turn", "turn").alias("turn"), "role", "text", "was", F.when(F.col("fault") > 0, fault).alias("fault"), "cost")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The cheapest edits that turn each conversation (conv_id long, turn long, role, text) into one optional system turn and
    pairs of a user and an assistant turn, or nothing: conv_id, step, edit (K keep, R rerole, D delete, I insert), turn, role,
    text, was (the role before), fault, cost. Rows whose edit isn't D, by step, are the repaired conversation.

    Turns are taken by turn (nulls first), then role, then text. The first fault of each counts: blank, duplicate (role and text
    seen before in the conversation), truncated (doesn't end in . ! or ?). Blank and duplicate turns are deleted. Of edits that
    cost the same, those whose initials sort first are taken. A role counts by its first character, as s, u or a. Null roles and
    texts count as one space; null conv_ids are one conversation. Repeated rows are duplicates. An empty table gives no rows;
    other columns are ignored.

    The one shuffle deals conversations out. In a task turns are sorted last first, and a stream over Arrow batches adds a byte of
    backpointers to each, with four costs as its whole state; a second local sort, which Spark spills, brings them back in
    order, and a second stream follows the backpointers. So a conversation of any length takes constant memory, though one task."""
    return _shown(_ordered_edits(turns))


DIGEST = "no_conv boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Sums:
    """What is counted of one conversation."""

    def __init__(self, conv: tuple):
        self.conv, self.counts, self.illegal, self.cost, self.audit, self.last = conv, [0, 0, 0, 0], 0, 0, [], None
        self.first_turn, self.last_turn, self.turns, self.hash, self.kept = None, None, 0, hashlib.sha256(), False

    def add(self, edit: str, no_turn: bool, turn: int, role: str, text: str, was: str | None, fault: int, cost: int) -> None:
        self.audit.append(edit)
        self.cost += cost
        if edit != "I":
            self.counts[fault] += 1
            self.illegal += self.last is not None and self.last + was[:1] not in ("su", "ua", "au")
            self.last = was[:1]
            if not no_turn and turn != self.last_turn:
                self.first_turn = turn if self.first_turn is None else self.first_turn
                self.last_turn, self.turns = turn, self.turns + 1
        if edit != "D":
            self.hash.update(f"{chr(10) * self.kept}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.kept = True

    def row(self) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return (*self.conv, gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, sums = [c.split()[0] for c in DIGEST.split(", ")], None
    for batch in batches:
        done = []
        for no_conv, conv, _, *edit in batch.itertuples(index=False, name=None):
            if sums is None or sums.conv != (no_conv, conv):
                done += [sums.row()] if sums else []
                sums = _Sums((no_conv, conv))
            sums.add(*edit)
        yield pd.DataFrame(done, columns=names)
    yield pd.DataFrame([sums.row()] if sums else [], columns=names)


def audit_conversations(turns: DataFrame) -> DataFrame:
    """A row per conversation of turns that has rows: conv_id, gaps (turn numbers left out), blank, duplicate and truncated turns,
    illegal (neighbours whose roles can't follow each other), cost and audit (initials of the edits) of the cheapest repair,
    and repaired_sha256 (of its role:text, joined by line breaks). Streams over the edits of repair_conversations, where they lie."""
    found = _ordered_edits(turns).mapInPandas(_digest, DIGEST)
    return found.select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), *found.columns[2:])
