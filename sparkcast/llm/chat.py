"""Chats of one form: an optional system turn, then user and assistant in turn, ending with the assistant.

The cheapest repair of a conversation is a shortest path: each turn keeps its role or is relabelled, opens a turn or is merged into
the one before, and empty turns are inserted where one is missing. Conversations are cut into pieces by ranges of their order, so
that a long one is many tasks' work; the costs of a piece from state to state join as min-plus matrices. Equal costs are
settled from the end, by the order of the roles, whatever the pieces are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.session import cut_lineage

ROLES = ("start", "system", "user", "assistant")
MERGE, RELABEL, INSERT = 1, 2, 3
# Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
_END = 3
_FAR = 1 << 40


def _ways() -> dict[tuple[int, int], tuple[int, ...]]:
    """The empty turns to insert between a turn (or the start) and the next opened one; where there is no way, no entry."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for a in range(4):
        reached = [(a, ())]
        for _ in range(3):
            onward = []
            for at, path in reached:
                for b in _NEXT[at]:
                    if (a, b) not in found:
                        found[a, b] = path
                        onward.append((b, (*path, b)))
            reached = onward
    return found


WAYS = _ways()


def _costs() -> list[list[list[int]]]:
    """``[role][from][to]`` for a turn of each role; role 0 is an unknown one."""
    table = []
    for role in range(4):
        rows = []
        for a in range(4):
            row = [_FAR] * 4
            for b in (1, 2, 3):
                label = 0 if b == role else RELABEL
                if (a, b) in WAYS:
                    row[b] = label + INSERT * len(WAYS[a, b])
                if a == b:
                    row[b] = min(row[b], label + MERGE)
            rows.append(row)
        table.append(rows)
    return table


COSTS = _costs()
CLOSING = [INSERT * (1 + len(WAYS[a, _END])) if a != _END else 0 for a in range(4)]


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES[1:] else 0


def forward(start: list[int], roles: list[int]) -> list[list[int]]:
    """Least costs of each state before and after every turn."""
    out = [start]
    for role in roles:
        table, now = COSTS[role], out[-1]
        out.append([min(now[a] + table[a][b] for a in range(4)) for b in range(4)])
    return out


def backward(costs: list[list[int]], roles: list[int], state: int) -> list[int]:
    """The states along the cheapest path that ends in ``state``; of equal ones the first in the order of the roles."""
    path = [state]
    for t in range(len(roles) - 1, -1, -1):
        table, b = COSTS[roles[t]], path[-1]
        path.append(min(range(4), key=lambda a: (costs[t][a] + table[a][b], a)))
    return path[::-1]


def final_state(costs: list[int]) -> int:
    return min(range(4), key=lambda a: (costs[a] + CLOSING[a], a))


START = [0, _FAR, _FAR, _FAR]
OUT = "part int, pos long, step int, turn long, action string, role string, text string, rendered string, cost int"


def render(role: int, text: str, opens: bool, first: bool) -> str:
    """What a turn adds to the chat. Marks inside a text lose their form."""
    safe = text.replace("<|", "< |")
    return ("" if first else "<|im_end|>\n") + f"<|im_start|>{ROLES[role]}\n{safe}" if opens else "\n" + safe


def repaired(rows: list[tuple], costs: list[int], exit_state: int | None) -> Iterator[tuple]:
    """Output turns of one piece: ``rows`` have part, pos, turn, role and text. Without ``exit_state`` the conversation ends here."""
    roles = [role_number(r[3]) for r in rows]
    along = forward(costs, roles)
    ends = exit_state is None
    path = backward(along, roles, final_state(along[-1]) if ends else exit_state)
    out: list[list] = []

    def add(part: int, pos: int, step: int, turn: int | None, action: str, role: int, text: str, opens: bool, first: bool, cost: int) -> None:
        out.append([part, pos, step, turn, action, ROLES[role], text, render(role, text, opens, first), cost])

    for (part, pos, turn, _, text), role, a, b in zip(rows, roles, path, path[1:]):
        label = 0 if b == role else RELABEL
        merged = a == b and MERGE <= INSERT * len(WAYS.get((a, b), (0,) * 9))
        if merged:
            add(part, pos, 0, turn, "merge" if not label else "relabel+merge", b, text, False, False, label + MERGE)
            continue
        for step, x in enumerate(WAYS[a, b]):
            add(part, pos, step, turn, "insert", x, "", True, a == 0 and step == 0, INSERT)
        add(part, pos, len(WAYS[a, b]), turn, "relabel" if label else "keep", b, text, True, a == 0 and not WAYS[a, b], label)
    if ends:
        part, pos, turn = rows[-1][:3]
        if path[-1] != _END:
            for step, x in enumerate((*WAYS[path[-1], _END], _END)):
                add(part, pos, 10 + step, turn, "insert", x, "", True, False, INSERT)
        out[-1][7] += "<|im_end|>\n"
    yield from map(tuple, out)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of equal (conv_id, part) of a sorted partition."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, run in groupby(rows, lambda r: (r["conv_id"], r["part"])):
        yield key, list(run)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * size, pa.int32()), pa.array(range(n, n + size), pa.int64())],
            [*batch.schema.names, "part", "pos"])
        n += size


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (conv, part), rows in _pieces(batches):
        roles = [role_number(r["role"]) for r in rows]
        m = [forward([0 if a == b else _FAR for b in range(4)], roles)[-1] for a in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([sum(m, [])], pa.list_(pa.int64()))],
                                         ["conv_id", "part", "matrix"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (conv, part), rows in _pieces(batches):
        roles = [role_number(r["role"]) for r in rows]
        along = forward(rows[0]["costs"], roles)
        entry = [backward(along, roles, b)[0] for b in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([rows[0]["costs"]], pa.list_(pa.int64())),
                                          pa.array([along[-1]], pa.list_(pa.int64())), pa.array([entry], pa.list_(pa.int32()))],
                                         ["conv_id", "part", "costs", "after", "entry"])


def _chain_costs(pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("part")
    now, out = START, []
    for m in pieces["matrix"]:
        out.append(now)
        now = [int(min(now[a] + m[4 * a + b] for a in range(4))) for b in range(4)]
    return pd.DataFrame({"conv_id": pieces["conv_id"], "part": pieces["part"], "costs": out})


def _chain_exits(pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("part", ascending=False)
    exits: list[int | None] = []
    state: int | None = None
    for after, entry in zip(pieces["after"], pieces["entry"]):
        exits.append(state)
        state = int(entry[final_state(list(after)) if state is None else state])
    return pd.DataFrame({"conv_id": pieces["conv_id"], "part": pieces["part"], "costs": pieces["costs"], "exit": pd.array(exits, "Int32")})


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.string()] * 4, pa.int32()]
    names = ["conv_id", "part", "pos", "step", "turn", "action", "role", "text", "rendered", "cost"]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    for (conv, _), rows in _pieces(batches):
        turns = [(r["part"], r["pos"], r["turn"], r["role"], r["text"] or "") for r in rows]
        for out in repaired(turns, rows[0]["costs"] or START, rows[0]["exit"]):
            held.append((conv, *out))
            if len(held) >= 4096:
                yield batch()
                held = []
    if held:
        yield batch()


def _by_piece(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")


def repair(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, part, pos, step, turn, action, role, text, rendered, cost)``: the turns of the repaired conversations.

    In the order of ``part, pos, step`` the ``rendered`` strings of a conversation make up the whole chat, and the costs its least
    repair. Turns go by number (NULL first), equal ones by role and text; an inserted turn has the number of the one it stands
    beside. Rows with a NULL id form one conversation; a NULL or unknown role is relabelled; a NULL text is empty; repeated
    rows are turns of their own; other columns are not read; an empty table gives an empty result. Runs jobs when called.
    """
    rows = chats.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.col(role).alias("role"), F.col(text).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.mapInArrow(_placed, "conv_id long, turn long, role string, text string, part int, pos long"))
    pieces = placed.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    cut = cut_lineage(pieces.where("low < high").select("conv_id"))
    key = placed["conv_id"].eqNullSafe(cut["conv_id"])
    roles = cut_lineage(placed.join(cut, key, "left_semi").select("conv_id", "part", "pos", "role"))
    matrices = _by_piece(roles).mapInArrow(_matrix, "conv_id long, part int, matrix array<long>")
    costs = matrices.groupBy("conv_id").applyInPandas(_chain_costs, "conv_id long, part int, costs array<long>")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["part"] == b["part"])
    begun = roles.join(costs, same(roles, costs)).select(roles["*"], costs["costs"])
    entries = _by_piece(begun).mapInArrow(_entries, "conv_id long, part int, costs array<long>, after array<long>, entry array<int>")
    exits = cut_lineage(entries.groupBy("conv_id").applyInPandas(_chain_exits, "conv_id long, part int, costs array<long>, exit int"))
    whole = placed.join(exits, same(placed, exits), "left").select(placed["*"], exits["costs"], exits["exit"])
    return _by_piece(whole).mapInArrow(_solved, f"conv_id long, {OUT}")
