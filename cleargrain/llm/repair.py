"""Conversation structure repair: the cheapest edits that make the roles alternate.

A repaired conversation is empty, or an optional system turn and then pairs of a user and an
assistant turn. A row is kept (0), given the role user or assistant (2) or deleted (3); a turn
without text can be inserted anywhere (2). Faulty rows: a blank one (no character but separators)
or a duplicate one (role and text seen earlier in the conversation) must be deleted; a truncated
one (last such character is no ``.``, ``!`` or ``?``) costs 1 more unless it is deleted. Of the
cheapest edits the one whose audit string, a letter per edit (D, I, K, R), comes first in ASCII is taken.

Rows are dealt by conversation and sorted by turn once; the sort by role and text that finds
duplicates uses the same exchange. A stream over the sorted Arrow batches carries, for each of
four states (nothing, system, user, assistant said last), the least cost, the order of its audit
string among the others' and the running print of its repaired text. So a conversation of any length
needs no memory but four bytes per turn to trace the edits back, and every ``BLOCK`` turns these
leave the task as a row of their own: they are traced from the last block to the first in a second,
narrow stream. A conversation is one stream, because the print of its text is.

Results for odd input: rows with null ``conv_id`` are one conversation; a null turn comes first and
is no turn for the gaps; rows of one turn are taken by role, then text; a null role or text is one
space; a role that begins with none of s, u, a fits nowhere and is given another or deleted; repeated
rows are duplicates; texts may be of any length; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .texts import small_batches

# The costs of the edits, what ends a sentence and what separates words.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
SENTENCE_ENDS, BLANKS = ".!?", " \t\n\x0b\x0c\r"
# Turns whose traces leave a task as one row.
BLOCK = 1 << 16

SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
SAID = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
# The state after a user or assistant turn that is inserted or given its role; it depends on the state alone.
FORCED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, **{(state, SAID[after][0]): after for state, after in FORCED.items()}}
NEVER = 1 << 30
NO_MOVE = 0xFF
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
FOUND = "key string, block int, moves binary, at int, audit string, " + "".join(f"{c} long, " for c in COUNTS) + "repaired_sha256 string"


def _forced(state: int, times: int) -> tuple[int, bytes]:
    """The state after so many inserted turns, and what they say."""
    said = b""
    for _ in range(times):
        said += (b"\n" if state else b"") + SAID[FORCED[state]].encode() + b":"
        state = FORCED[state]
    return state, said


@cache
def _step(costs: tuple, order: tuple, initial: str, fault: int) -> tuple:
    """From the costs of the four states and the order of their audits to those after one more row.

    Costs are differences to the least one, so few arguments ever occur. Returns them with what was
    taken off, the moves, and how the prints go on. Two audits that end with the same row never
    begin each other, so the order of the longer ones follows from the order of the shorter ones.
    """
    best: dict[int, tuple] = {}
    for state in STATES:
        for inserts in range(3) if costs[state] < NEVER else ():
            at, said = _forced(state, inserts)
            ways = [("D", at, DELETE)]
            if fault not in (BLANK, DUPLICATE):
                extra = CUT_SHORT * (fault == TRUNCATED)
                ways.append(("R", FORCED[at], REROLE + extra))
                if (at, initial) in KEPT:
                    ways.append(("K", KEPT[at, initial], KEEP + extra))
            for letter, after, cost in ways:
                line = b"" if letter == "D" else b"\n" if at else b""
                line = said + line + (SAID[after].encode() if letter == "R" else b"")
                rank = (costs[state] + INSERT * inserts + cost, order[state], "I" * inserts + letter)
                if after not in best or rank < best[after][0]:
                    best[after] = (rank, state, inserts, letter, line)
    least = min(rank[0] for rank, *_ in best.values())
    places = sorted(best, key=lambda s: best[s][0][1:])
    moves = bytes(NO_MOVE if s not in best else best[s][1] | best[s][2] << 2 | "DRK".index(best[s][3]) << 4 for s in STATES)
    last_use = {best[s][1]: s for s in best}
    plan = tuple((s, best[s][1], last_use[best[s][1]] != s, best[s][4], best[s][3]) for s in best)
    after = tuple(best[s][0][0] - least if s in best else NEVER for s in STATES)
    return after, tuple(places.index(s) if s in best else NEVER for s in STATES), least, moves, plan


def _traced(moves: bytes, state: int) -> tuple[str, int]:
    """The audit of a block of rows that ends in a state, and the state before it."""
    letters = []
    for at in range(len(moves) - 4, -4, -4):
        move = moves[at + state]
        letters.append("I" * (move >> 2 & 3) + "DRK"[move >> 4])
        state = move & 3
    return "".join(reversed(letters)), state


class _Conversation:
    """What is carried from row to row, and from batch to batch."""

    def __init__(self, key: str | None):
        self.key, self.block, self.moves = key, 0, bytearray()
        self.costs, self.order, self.cost = (0, NEVER, NEVER, NEVER), (0, NEVER, NEVER, NEVER), 0
        self.prints: list = [hashlib.sha256(), None, None, None]
        self.faults = [0, 0, 0, 0]
        self.illegal, self.initial = 0, None
        self.least = self.turn = None
        self.turns = 0

    def row(self, turn: str | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.costs, self.order, least, moves, plan = _step(self.costs, self.order, initial if initial in ("s", "u", "a") else "", fault)
        self.cost += least
        self.moves += moves
        own, said = role.encode(), b":" + (text or "").encode()
        prints: list = [None] * 4
        for after, state, again, line, letter in plan:
            prints[after] = into = self.prints[state].copy() if again else self.prints[state]
            if letter != "D":
                into.update(line + own + said if letter == "K" else line + said)
            elif line:
                into.update(line)
        self.prints = prints
        self.faults[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.least, self.turn, self.turns = self.least if self.turns else turn, turn, self.turns + 1

    def spilled(self) -> tuple:
        done = (self.key, self.block, bytes(self.moves), *[None] * 9)
        self.block, self.moves = self.block + 1, bytearray()
        return done

    def finished(self) -> tuple:
        """Totals, and the audit if it needs no earlier block."""
        closing = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
        end = min((s for s in STATES if self.costs[s] < NEVER), key=lambda s: (self.costs[s] + INSERT * closing[s], self.order[s]))
        self.prints[end].update(_forced(end, closing[end])[1])
        gaps = int(self.turn) - int(self.least) + 1 - self.turns if self.turns else 0
        totals = (gaps, *self.faults[1:], self.illegal, self.cost + self.costs[end] + INSERT * closing[end], self.prints[end].hexdigest())
        if self.block:
            return (self.key, self.block, bytes(self.moves), end, None, *totals)
        return (self.key, 0, None, end, _traced(bytes(self.moves), end)[0] + "I" * closing[end], *totals)


_COLUMNS = [part.split()[0] for part in FOUND.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
    return out.astype({c: "Int64" for c in COUNTS} | {"block": "Int32", "at": "Int32"})


def _followed(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    now: _Conversation | None = None
    for batch in batches:
        out = []
        for key, turn, role, text, fault in zip(*(batch[c].tolist() for c in ("key", "turn", "role", "text", "fault")), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    out.append(now.finished())
                now = _Conversation(key)
            if fault < 0:
                continue
            if len(now.moves) >= 4 * block:
                out.append(now.spilled())
            now.row(turn, role, text, fault)
        if out:
            yield _frame(out)
    if now is not None:
        yield _frame([now.finished()])


def _traced_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of a conversation from the last to the first, to pieces of its audit."""
    state = None
    for batch in batches:
        pieces = []
        for moves, at in zip(batch["moves"].tolist(), batch["at"].tolist(), strict=True):
            closing = ""
            if at == at and at is not None:
                state = int(at)
                closing = "I" * {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
            piece, state = _traced(moves, state)
            pieces.append(piece + closing)
        yield batch.drop(columns=["moves", "at", "audit"]).assign(audit=pieces)


def _order() -> list[Column]:
    """By turn, then role and text, by which copies stand together; the first of them is the one not seen."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("seen")]


def _faults(conversations: DataFrame, absent: str | None, numbered: bool = False) -> DataFrame:
    """Rows by conversation in order, with the first fault of each (-1: the row only names its conversation)."""
    gone = F.col(absent) if absent else F.lit(False)
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("key"),
        F.when(~gone, F.col("turn").cast("long")).alias("turn"),
        F.when(~gone, F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(~gone, F.coalesce("text", F.lit(" "))).alias("text"),
        gone.alias("gone"),
    )
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    # Dealt by conversation, rows of one role and text are together already: this window needs no exchange of its own.
    seen = F.row_number().over(Window.partitionBy("key", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault: Column = (
        F.when(F.col("gone"), F.lit(-1))
        .when(end == "", BLANK)
        .when(F.col("seen"), DUPLICATE)
        .when(~end.isin(*SENTENCE_ENDS), TRUNCATED)
        .otherwise(SOUND)
    )
    dealt = rows.repartition("key").withColumn("seen", seen).withColumn("fault", fault)
    text = F.when(F.col("fault").isin(SOUND, TRUNCATED), F.col("text"))
    number = [F.row_number().over(Window.partitionBy("key").orderBy(*_order())).alias("n")] if numbered else []
    return dealt.sortWithinPartitions("key", *_order()).select("key", "turn", "role", text.alias("text"), "fault", *number)


def repair(conversations: DataFrame, *, absent: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per ``conv_id`` of ``conv_id, turn, role, text``: faults, cheapest edits and print of the repaired turns.

    ``absent`` may name a boolean column of rows that are not there and only name their conversation.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    path = f"{scratch_path(spark, 'repair')}/found"
    rows = _faults(conversations, absent).withColumn("turn", F.col("turn").cast("string"))
    rows.mapInPandas(lambda batches: _followed(batches, block), FOUND).write.parquet(path)
    found = spark.read.parquet(path)
    whole = found.filter("audit IS NOT NULL")
    spilled = found.filter("audit IS NULL").repartition("key").sortWithinPartitions("key", F.desc("block"))
    columns = [c for c in _COLUMNS if c not in ("moves", "at")]
    schema = ", ".join(p for p in FOUND.split(", ") if p.split()[0] not in ("moves", "at", "audit")) + ", audit string"
    pieces = F.array_sort(F.collect_list(F.struct("block", "audit")))
    joined = (
        spilled.mapInPandas(_traced_back, schema)
        .groupBy("key")
        .agg(
            F.max("block").alias("block"),
            # As long as the column that is asked for.
            F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"),
            *[F.max(c).alias(c) for c in (*COUNTS, "repaired_sha256")],
        )
    )
    kind = conversations.schema["conv_id"].dataType
    return whole.select(*columns).unionByName(joined).select(F.col("key").cast(kind).alias("conv_id"), *COUNTS, "audit", "repaired_sha256")


def repaired_turns(conversations: DataFrame, repairs: DataFrame) -> DataFrame:
    """The turns that the edits of :func:`repair` leave: ``conv_id, place, edit, role, text``, places from 1.

    Edits meet rows by their number in the conversation. Numbers are counted in one window per
    conversation, over rows that are spilled if they are many.
    """
    numbered = _faults(conversations, None, numbered=True)
    edits = repairs.select(F.col("conv_id").cast("string").alias("key_"), F.posexplode(F.split("audit", "")).alias("at", "edit")).filter("edit <> ''")
    so_far = Window.partitionBy("key_").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edits = edits.withColumns({"n_": F.sum((F.col("edit") != "I").cast("long")).over(so_far), "place": F.sum((F.col("edit") != "D").cast("long")).over(so_far)})
    matched = (F.col("edit") != "I") & F.col("key_").eqNullSafe(F.col("key")) & (F.col("n_") == F.col("n"))
    # Only the first turn can be one of system, and then user and assistant change places.
    first = edits.join(numbered, matched, "left").filter("edit <> 'D'")
    opened = F.max(F.when((F.col("place") == 1) & (F.col("edit") == "K"), F.left("role", F.lit(1)) == "s")).over(Window.partitionBy("key_"))
    given = F.when((F.col("place") + F.coalesce(opened, F.lit(False)).cast("int")) % 2 == 1, SAID[USER]).otherwise(SAID[ASSISTANT])
    kind = conversations.schema["conv_id"].dataType
    return first.withColumn("role", F.when(F.col("edit") == "K", F.col("role")).otherwise(given)).select(
        F.col("key_").cast(kind).alias("conv_id"), "place", "edit", "role", F.coalesce("text", F.lit("")).alias("text")
    )


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with a twentieth of the turns dropped (``gone``), emptied, stripped, repeated or given to the user."""
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    how = F.col("how")
    return (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1])) % 20).alias("how"))
        .select("*", F.explode(F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id",
            "turn",
            F.when(how == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(how == 1, "").when(how == 2, F.translate("text", SENTENCE_ENDS, "")).otherwise(F.col("text")).alias("text"),
            (how == 0).alias("gone"),
        )
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), absent="gone")
