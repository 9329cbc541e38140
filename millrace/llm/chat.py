"""Chat formatting: repair of the order of roles at least cost, then rendering.

A legal conversation is an optional system message, then user and assistant in turn, and ends with the assistant. Every turn of the
input may be kept, merged into the message before it, relabelled, or preceded by one empty message; dynamic programming over
the automaton of the last message's role picks the cheapest legal sequence. Ties go to keeping, then merging, then relabelling.

Turns are dealt out by range of (conversation, turn, role, text), so a conversation of any length is spread over partitions.
A partition's part of a cut conversation is a matrix of least costs from state to state; the chain of these matrices (at most two a
partition) fixes the states at the cuts, and every partition then traces its own turns.

The result has a row per turn, and one per inserted message, with its piece of the rendered text: the pieces of a conversation joined
by ``place``, ``part_of_place`` are its text. Unknown and null roles must be relabelled. Null texts are empty messages.
Turns are ordered by turn (null first), role, text; repeated turns are turns of their own. Null conversation ids
are one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import bounded_batches
from millrace.session import cut_lineage

MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
#: Which messages may follow the last one.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _steps() -> dict[str, list[list[tuple[float, int, str, tuple[int, ...]]]]]:
    """For each role of a turn and each state before it: the ways (cost, state after, action, roles inserted), best first."""
    out = {}
    for role in [*ROLES[1:], "other"]:
        rows = []
        for before in range(4):
            ways = []
            for after in (SYSTEM, USER, ASSISTANT):
                extra, name = (0.0, "keep") if ROLES[after] == role else (RELABEL, "relabel")
                if before == after:
                    ways.append((MERGE + extra, after, "merge" if not extra else "relabel+merge", ()))
                if after in NEXT[before]:
                    ways.append((extra, after, name, ()))
                for between in NEXT[before]:
                    if after in NEXT[between]:
                        ways.append((INSERT + extra, after, f"insert+{name}", (between,)))
            rank = ["keep", "merge", "relabel", "relabel+merge", "insert+keep", "insert+relabel"]
            rows.append(sorted(ways, key=lambda w: (w[0], rank.index(w[2]), w[1], w[3])))
        out[role] = rows
    return out


STEPS = _steps()


def _endings() -> list[tuple[float, tuple[int, ...]]]:
    """Cost and roles of the empty messages that end a conversation in each state."""
    return [(2 * INSERT, (USER, ASSISTANT)), (2 * INSERT, (USER, ASSISTANT)), (INSERT, (ASSISTANT,)), (0.0, ())]


ENDINGS = _endings()


def _kind(role: str | None) -> str:
    return role if role in ROLES[1:] else "other"


def _matrix(role: str | None) -> np.ndarray:
    out = np.full((4, 4), math.inf)
    for before, ways in enumerate(STEPS[_kind(role)]):
        for cost, after, _, _ in ways:
            out[before, after] = min(out[before, after], cost)
    return out


MATRICES = {role: _matrix(role) for role in [*ROLES[1:], "other"]}


def span_costs(roles: list[str | None]) -> np.ndarray:
    """Least cost from each state before these turns to each state after them."""
    out = np.where(np.eye(4) == 1, 0.0, math.inf)
    for role in roles:
        out = (out[:, :, None] + MATRICES[_kind(role)][None]).min(axis=1)
    return out


def trace(roles: list[str | None], entry: int, leave: int | None) -> list[tuple[float, int, str, tuple[int, ...]]]:
    """The cheapest way of each turn from state ``entry``, to state ``leave`` or (None) to the end of the conversation."""
    costs = [0.0 if s == entry else math.inf for s in range(4)]
    back = []
    for role in roles:
        new, came = [math.inf] * 4, [None] * 4
        for before in range(4):
            if costs[before] < math.inf:
                for way in STEPS[_kind(role)][before]:
                    if costs[before] + way[0] < new[way[1]]:
                        new[way[1]], came[way[1]] = costs[before] + way[0], (before, way)
        costs = new
        back.append(came)
    state = leave if leave is not None else min(range(4), key=lambda s: (costs[s] + ENDINGS[s][0], -s))
    ways = []
    for came in reversed(back):
        state, way = came[state]
        ways.append(way)
    return ways[::-1]


def chained(spans: list[np.ndarray]) -> list[tuple[int, int | None]]:
    """States before and after each of the consecutive spans of one conversation."""
    costs = [np.array([0.0, math.inf, math.inf, math.inf])]
    for m in spans:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    state = min(range(4), key=lambda s: (costs[-1][s] + ENDINGS[s][0], -s))
    out = []
    for i in range(len(spans) - 1, -1, -1):
        before = int(np.argmin(costs[i] + spans[i][:, state]))
        out.append((before, None if i == len(spans) - 1 else state))
        state = before
    return out[::-1]


def _plain(text: str | None) -> str:
    """Text that cannot be taken for a delimiter."""
    return (text or "").replace("<|im_", "<| im_")


def _runs(conversation: list) -> list[tuple[int, int]]:
    edges = [i for i in range(len(conversation)) if i == 0 or conversation[i] != conversation[i - 1]] + [len(conversation)]
    return list(zip(edges, edges[1:]))


def formatted(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, place, part_of_place, role, action, cost, text): the repaired turns with their rendered pieces."""
    spark = turns.sparkSession
    bounded_batches(spark)
    order = ["conv", "turn", "role", "text"]
    named = turns.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    table = cut_lineage(dealt.withColumn("part", F.shiftright("place", 33)))
    kinds = [named.schema[c].dataType.simpleString() for c in ("conv", "turn")]

    def border(data: pa.Table) -> pa.Table:
        data = data.sort_by("place")
        convs, roles = data["conv"].to_pylist(), data["role"].to_pylist()
        runs = _runs(convs)
        ends = runs if len(runs) == 1 else [runs[0], runs[-1]]
        return pa.table([
            data["part"].take(pa.array([a for a, _ in ends])), data["conv"].take(pa.array([a for a, _ in ends])),
            pa.array([span_costs(roles[a:b]).ravel().tolist() for a, b in ends], pa.list_(pa.float64()))], ["part", "conv", "costs"])

    # At most two rows of 16 numbers for each partition.
    ends = table.select("part", "place", "conv", "role").groupBy("part").applyInArrow(border, f"part long, conv {kinds[0]}, costs array<double>").collect()
    spans: dict[object, list[tuple[int, np.ndarray]]] = {}
    for part, conv, costs in ends:
        spans.setdefault(conv, []).append((part, np.array(costs).reshape(4, 4)))
    states = {}
    for conv, found in spans.items():
        found.sort(key=lambda f: f[0])
        for (part, _), state in zip(found, chained([m for _, m in found])):
            states[part, conv] = state
    sent = spark.sparkContext.broadcast(states)

    def repaired(data: pa.Table) -> pa.Table:
        data = data.sort_by("place")
        part, convs, roles, texts = data["part"][0].as_py(), *(data[c].to_pylist() for c in ("conv", "role", "text"))
        at, sub, out_role, action, cost, piece = [], [], [], [], [], []

        def row(i, number, state, name, price, written):
            for column, value in zip((at, sub, out_role, action, cost, piece), (i, number, ROLES[state], name, price, written)):
                column.append(value)

        for a, b in _runs(convs):
            entry, leave = sent.value.get((part, convs[a]), (START, None))
            state = entry
            for i, (price, after, name, inserted) in enumerate(trace(roles[a:b], entry, leave), a):
                number = 0
                for between in inserted:
                    row(i, number, between, "insert", INSERT, (CLOSE if state != START else "") + f"{OPEN}{ROLES[between]}\n")
                    state, number = between, number + 1
                price -= INSERT * len(inserted)
                if "merge" in name:
                    written = "\n" + _plain(texts[i])
                else:
                    written = (CLOSE if state != START else "") + f"{OPEN}{ROLES[after]}\n" + _plain(texts[i])
                row(i, number, after, name.removeprefix("insert+"), price, written)
                state = after
            if leave is None:
                for k, ending in enumerate(ENDINGS[state][1]):
                    row(b - 1, 9 + k, ending, "insert", INSERT, f"{CLOSE}{OPEN}{ROLES[ending]}\n")
                piece[-1] += CLOSE
        where = pa.array(at, pa.int64())
        return pa.table([
            data["conv"].take(where), data["turn"].take(where), data["place"].take(where), pa.array(sub, pa.int64()),
            pa.array(out_role, pa.string()), pa.array(action, pa.string()), pa.array(cost, pa.float64()), pa.array(piece, pa.string())], names)

    names = ["conv", "turn", "place", "part_of_place", "role", "action", "cost", "text"]
    out = table.groupBy("part").applyInArrow(
        repaired, f"conv {kinds[0]}, turn {kinds[1]}, place long, part_of_place long, role string, action string, cost double, text string")
    return out.withColumnsRenamed({"conv": conversation, **({"turn": turn} if turn != "turn" else {})})


def rendered(pieces: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, text, cost): whole conversations, for those whose text fits a row."""
    rows = F.array_sort(F.collect_list(F.struct("place", "part_of_place", "text")))
    return pieces.groupBy(conversation).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("text"), F.sum("cost").alias("cost"))
