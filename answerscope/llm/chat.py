"""Operator 10: chat formatting with minimum-cost role repair.

A legal chat is an optional system message, then user and assistant in turn, beginning with the
user and ending with the assistant.  A dynamic program over that automaton chooses for every
turn whether it keeps its role, is relabelled, is merged into the message before it, or has
empty messages put before it.  Conversations are cut into blocks of turn numbers: each block is
reduced to its 4 x 4 matrix of least costs between states, the matrices of a conversation are
chained, and every block is then solved between its two known states.  So one endless
conversation is shared by many tasks, and none holds more than a block of texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm import common

KEEP, MERGE, INSERT, RELABEL_UNKNOWN, RELABEL = 0, 1, 2, 1, 3
FAR = 1 << 40
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: other names of the three roles, taken as those at no cost
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: (state, label) -> [(next state, cost, merged, roles of empty messages put before)]
MOVES = {
    (BEGIN, SYSTEM): [(SYSTEM, KEEP, False, ())], (BEGIN, USER): [(USER, KEEP, False, ())], (BEGIN, ASSISTANT): [(ASSISTANT, INSERT, False, (USER,))],
    (SYSTEM, SYSTEM): [(SYSTEM, MERGE, True, ())], (SYSTEM, USER): [(USER, KEEP, False, ())], (SYSTEM, ASSISTANT): [(ASSISTANT, INSERT, False, (USER,))],
    (USER, USER): [(USER, MERGE, True, ()), (USER, INSERT, False, (ASSISTANT,))], (USER, ASSISTANT): [(ASSISTANT, KEEP, False, ())],
    (ASSISTANT, ASSISTANT): [(ASSISTANT, MERGE, True, ()), (ASSISTANT, INSERT, False, (USER,))], (ASSISTANT, USER): [(USER, KEEP, False, ())],
}
#: what ends a chat in each state
ENDINGS = {BEGIN: (2 * INSERT, (USER, ASSISTANT)), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}


def label_of(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return ROLES.get(ALIASES.get(name, name))


def choices(state: int, label: int | None) -> Iterator[tuple[int, int, int, bool, tuple]]:
    """Every way to take a turn: next state, cost, the label given, merged, empty messages before."""
    for given in (label, *(r for r in (USER, ASSISTANT, SYSTEM) if r != label)):
        if given is not None:
            changed = 0 if given == label else RELABEL_UNKNOWN if label is None else RELABEL
            for nxt, cost, merged, empty in MOVES.get((state, given), ()):
                yield nxt, cost + changed, given, merged, empty


#: for each label (None: unknown) and pair of states the cheapest move, the first of equals
STEPS = {label: {} for label in (None, SYSTEM, USER, ASSISTANT)}
for _label, _state in itertools.product(STEPS, range(4)):
    for _next, *_move in choices(_state, _label):
        if _move[0] < STEPS[_label].get((_state, _next), (FAR,))[0]:
            STEPS[_label][_state, _next] = tuple(_move)


def advance(costs: list[int], label: int | None) -> tuple[list[int], list[int]]:
    """Least costs after one more turn, and the state each came from."""
    now, came = [FAR] * 4, [-1] * 4
    for (state, nxt), move in STEPS[label].items():
        if costs[state] + move[0] < now[nxt]:
            now[nxt], came[nxt] = costs[state] + move[0], state
    return now, came


def path(labels: list[int | None], entry: int, leave: int) -> list[tuple[int, tuple]]:
    """The cheapest way through a block between two states: per turn the state after it and its move."""
    costs = [FAR] * 4
    costs[entry] = 0
    back = []
    for label in labels:
        costs, came = advance(costs, label)
        back.append(came)
    out, state = [], leave
    for label, came in zip(reversed(labels), reversed(back)):
        out.append((state, STEPS[label][came[state], state]))
        state = came[state]
    return out[::-1]


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``keys`` columns, over the borders of batches."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, run in itertools.groupby(rows, key=lambda r: r[:keys]):
        yield key, list(run)


def _matrices(batches):
    def flush(key, m):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([[c for row in m for c in row]], pa.list_(pa.int64()))],
                                          names=["conv_id", "block", "costs"])

    key, m = None, None
    for batch in batches:
        for conv, block, role in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "role"))):
            if (conv, block) != key:
                if key:
                    yield flush(key, m)
                key, m = (conv, block), [[0 if a == b else FAR for b in range(4)] for a in range(4)]
            m = [advance(row, label_of(role))[0] for row in m]
    if key:
        yield flush(key, m)


def _chain(batches):
    """Entry and leaving state of every block of a conversation, its least cost and which block is last."""
    for (conv,), rows in groups(batches, 1):
        costs, back = [0, FAR, FAR, FAR], []
        for _, _, m in rows:
            came = [min(range(4), key=lambda a: (costs[a] + m[4 * a + b], a)) for b in range(4)]  # noqa: B023
            costs = [min(FAR, costs[came[b]] + m[4 * came[b] + b]) for b in range(4)]
            back.append(came)
        state = min(range(4), key=lambda a: (costs[a] + ENDINGS[a][0], -a))
        total, out = costs[state] + ENDINGS[state][0], []
        for k in range(len(rows) - 1, -1, -1):
            out.append((conv, rows[k][1], back[k][state], state, total, k == len(rows) - 1))
            state = back[k][state]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()))],
                                         names=["conv_id", "block", "entry", "leave", "cost", "last"])


OPEN, CLOSE, JOINT = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"
REPAIRED = "conv_id long, turn long, role string, new_role string, action string, empty_before array<string>, cost long, last boolean, fragment string"


def _render(batches):
    """One row per turn; the fragments of a conversation, in order, are the rendered chat."""
    for (conv, _, entry, leave, cost, last), rows in groups(batches, 6):
        out, state = [], entry
        moves = path([label_of(r[7]) for r in rows], entry, leave)
        for k, ((*_, turn, role, text), (after, (_, given, merged, empty))) in enumerate(zip(rows, moves)):
            text = (text or "").replace("<|", "< |")  # a text cannot forge the marks
            before = "" if state == BEGIN else CLOSE
            fragment = JOINT + text if merged else before + "".join(OPEN.format(NAMES[e]) + CLOSE for e in empty) + OPEN.format(NAMES[given]) + text
            ends = last and k == len(rows) - 1
            if ends:
                fragment += CLOSE + "".join(OPEN.format(NAMES[e]) + CLOSE for e in ENDINGS[after][1])
            action = "+".join((["relabel"] if given != label_of(role) else []) + (["merge"] if merged else [])) or "keep"
            out.append((conv, turn, role, NAMES[given], action, [NAMES[e] for e in empty], cost, ends, fragment))
            state = after
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                         names=["conv_id", "turn", "role", "new_role", "action", "empty_before", "cost", "last", "fragment"])


def repair(conversations: DataFrame, block: int = 512) -> DataFrame:
    """One row per turn: its role after repair, what was done, the conversation's least cost, its fragment.

    Turns are ordered by number, role and text (nulls first), so ties and repeated rows have a
    defined place; rows without a ``conv_id`` form one conversation, rows without a turn number
    come first.  Null and unknown roles are relabelled at less cost; null texts are empty.  An
    empty table gives no row.  Rows that share conversation and turn number share a block.
    """
    common.importable(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.floor(F.col("turn").cast("long") / block), F.lit(-2**62)).cast("long").alias("block"),
                                F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "block", "turn", "role", F.coalesce("text", F.lit("")), "text"]
    narrow = rows.select("conv_id", "block", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    costs = narrow.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text").mapInArrow(_matrices, "conv_id long, block long, costs array<long>")
    ways = costs.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_chain, "conv_id long, block long, entry int, leave int, cost long, last boolean")
    ways = ways.withColumnsRenamed({"conv_id": "way_id", "block": "way_block"})
    held = rows.join(ways, rows["conv_id"].eqNullSafe(ways["way_id"]) & (rows["block"] == ways["way_block"]))
    held = held.repartition("conv_id", "block").sortWithinPartitions(*order)
    return held.select("conv_id", "block", "entry", "leave", "cost", "last", "turn", "role", "text").mapInArrow(_render, REPAIRED)


def rendered(repaired: DataFrame) -> DataFrame:
    """``conv_id``, ``chat``: whole chats as one text each, for conversations that fit a row."""
    turns = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-2**62)).alias("turn"), "last", "fragment")))
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["fragment"]), "").alias("chat"))
