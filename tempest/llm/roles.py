"""Role repair of conversations at minimum cost, and rendering.

A legal conversation has at most one system turn, at its start, then user and assistant in turn, the
user first and the assistant last.  Every turn of a conversation is kept, given another role or merged
into the turn before it; empty turns may be put in.  Dynamic programming over the automaton of legal
turns finds the cheapest repair: ``MERGE``, ``RELABEL`` and ``INSERT`` each cost what they cost per use
(a turn whose role is unknown is relabelled for ``UNKNOWN``).  Of equally cheap repairs the one with
the smaller end state and, going back, the smaller state and the earlier choice wins.

How it runs: turns are range-partitioned by conversation and turn and written in order as blocks of
``BLOCK_TURNS`` turns, so a conversation of any length is spread over tasks.  A block is reduced to
the costs between its 4 states before and after (min-plus products of the turns' matrices); these few
numbers are chained per conversation to find the states at the blocks' borders, and then every block
is repaired by itself between its two states.

A piece is a source turn or an inserted one.  ``rendered`` of all pieces of a conversation, in the
order of source_index and piece, is the rendered conversation.  Template marks inside a text are broken
by a space, so a text cannot end its turn.

Defined results: a null or unlisted role is unknown; null text is empty; turns of a conversation are
ordered by turn (null last), then role, then text; repeated rows are turns of their own; rows of a null
conv_id are one conversation; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempest.llm.batches import run_batches
from tempest.llm.text import whole
from tempest.session import run_folder

MERGE, RELABEL, INSERT, UNKNOWN = 1, 2, 3, 1
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant",
           "ai": "assistant", "chatgpt": "assistant", "instructions": "system", "developer": "system"}
#: States: before the first turn, after a system, user, assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
BLOCK_TURNS = 512
BLOCK_CHARS = 4 << 20
FAR = 1 << 60

#: The chat template.
HEAD, TAIL, MARKS = "<|im_start|>{}\n", "<|im_end|>\n", ("<|im_start|>", "<|im_end|>")


def role_state(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else None


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest turns (states) to insert to come from a state to another; none to stay."""
    out = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (s, t), way in list(out.items()):
            for n in LEGAL[t]:
                if (s, n) not in out or len(out[s, n]) > len(way) + 1:
                    out[s, n] = (*way, n)
    return out


PATHS = _paths()


def _steps(role: int | None) -> list[list[tuple[int, tuple[int, ...], bool]]]:
    """By state before and after a turn of that role: (cost, states inserted before it, merged)."""
    table = [[(FAR, (), False)] * 4 for _ in range(4)]

    def offer(s: int, t: int, cost: int, way: tuple[int, ...], merged: bool) -> None:
        cost += 0 if role == t else UNKNOWN if role is None else RELABEL
        if cost < table[s][t][0]:
            table[s][t] = (cost, way, merged)

    for s in range(4):
        for t in LEGAL[s]:
            offer(s, t, 0, (), False)
        if s != START:
            offer(s, s, MERGE, (), True)
        for (a, mid), way in PATHS.items():
            if a == s and way:
                for t in LEGAL[mid]:
                    offer(s, t, INSERT * len(way), way, False)
    return table


STEPS = {r: _steps(r) for r in (None, SYSTEM, USER, ASSISTANT)}
#: Cost and insertions from a last state to the end of a legal conversation.
ENDS = [(INSERT * len(PATHS[s, ASSISTANT]), PATHS[s, ASSISTANT]) for s in range(4)]


def forward(roles: list[int | None], cost: list[int]) -> list[list[int]]:
    """Least cost of each state before each turn and after the last."""
    rows = [cost]
    for r in roles:
        step = STEPS[r]
        cost = [min(cost[s] + step[s][t][0] for s in range(4)) for t in range(4)]
        rows.append(cost)
    return rows


def block_costs(roles: list[int | None]) -> list[list[int]]:
    """Least cost from each state before the turns to each after them."""
    return [forward(roles, [0 if s == e else FAR for s in range(4)])[-1] for e in range(4)]


def between(roles: list[int | None], entry: int, leave: int) -> list[tuple[int, int, tuple[int, ...], bool]]:
    """The choices of the cheapest way from ``entry`` to ``leave``: per turn (state, cost, inserted, merged)."""
    rows, state, out = forward(roles, [0 if s == entry else FAR for s in range(4)]), leave, []
    for i in range(len(roles) - 1, -1, -1):
        step = STEPS[roles[i]]
        before = next(s for s in range(4) if rows[i][s] + step[s][state][0] == rows[i + 1][state])
        out.append((state, *step[before][state]))
        state = before
    return out[::-1]


def borders(blocks: list[list[list[int]]]) -> list[tuple[int, int]]:
    """States before and after each block of a conversation on the cheapest way through all."""
    rows = [[0 if s == START else FAR for s in range(4)]]
    for m in blocks:
        rows.append([min(rows[-1][s] + m[s][t] for s in range(4)) for t in range(4)])
    state = min(range(4), key=lambda s: rows[-1][s] + ENDS[s][0])
    out = []
    for i in range(len(blocks) - 1, -1, -1):
        before = next(s for s in range(4) if rows[i][s] + blocks[i][s][state] == rows[i + 1][state])
        out.append((before, state))
        state = before
    return out[::-1]


# ------------------------------------------------------------------ pieces

def clean(text: str) -> str:
    for mark in MARKS:
        text = text.replace(mark, mark[0] + " " + mark[1:])
    return text


def pieces(roles: list[str | None], texts: list[str], entry: int, leave: int, offset: int, last: bool) -> list[tuple]:
    """(source_index, piece, action, role, repaired, cost, rendered) of a block's turns."""
    out, begun = [], entry != START

    def put(i: int, k: int, action: str, role: str | None, state: int, cost: int, text: str, merged: bool = False) -> None:
        nonlocal begun
        head = "\n\n" if merged else (TAIL if begun else "") + HEAD.format(ROLES[state - 1])
        out.append((i, k, action, role, ROLES[state - 1], cost, head + text))
        begun = True

    states = [role_state(r) for r in roles]
    for i, (state, cost, way, merged) in enumerate(between(states, entry, leave)):
        for k, s in enumerate(way):
            put(offset + i, k, "insert", None, s, INSERT, "")
        same = states[i] == state
        action = ("merge" if same else "merge and relabel") if merged else "keep" if same else "relabel"
        put(offset + i, len(way), action, roles[i], state, cost - INSERT * len(way), clean(texts[i]), merged)
    if last:
        for k, s in enumerate(ENDS[leave][1]):
            put(offset + len(roles), k, "insert", None, s, INSERT, "")
        out[-1] = (*out[-1][:-1], out[-1][-1] + TAIL)
    return out


# ------------------------------------------------------------------ the job

def turn_blocks(turns: DataFrame, folder: str, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, part, seq, roles, texts: blocks in order of (part, seq) within a conversation."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, key, roles, texts, size = TaskContext.get().partitionId(), 0, None, [], [], 0

        def block(conv_type) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key], conv_type), pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                 pa.array([roles], pa.list_(pa.string())), pa.array([texts], pa.list_(pa.string()))], ["conv_id", "part", "seq", "roles", "texts"])

        for b in batches:
            kind = b.column("conv_id").type
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if roles and (conv != key or len(roles) >= block_turns or size >= BLOCK_CHARS):
                    yield block(kind)
                    seq, roles, texts, size = seq + 1, [], [], 0
                key = conv
                roles.append(role)
                texts.append(text)
                size += len(text)
        if roles:
            yield block(kind)

    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.xxhash64("text").asc()]
    rows = turns.select("conv_id", "turn", "role", whole(F.col("text")).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("conv_id", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return run_batches(rows.mapInArrow(cut, f"conv_id {kind}, part int, seq int, roles array<string>, texts array<string>"), folder, "blocks")


def border_states(blocks: DataFrame, folder: str) -> DataFrame:
    """part, seq, entry, leave, offset, last of every block; only matrices of 16 numbers travel."""
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles = b.column("roles").to_pylist()
            m = [[x for row in block_costs([role_state(r) for r in rs]) for x in row] for rs in roles]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), b.column("seq"), pa.array(list(map(len, roles)), pa.int64()),
                                              pa.array(m, pa.list_(pa.int64()))], ["conv_id", "part", "seq", "n", "costs"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "seq", "entry", "leave", "offset", "last"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
        held: list[dict] = []

        def done() -> list[tuple]:
            states = borders([[r["costs"][4 * s:4 * s + 4] for s in range(4)] for r in held])
            at, out = 0, []
            for i, (r, (a, z)) in enumerate(zip(held, states, strict=True)):
                out.append((r["part"], r["seq"], a, z, at, i == len(held) - 1))
                at += r["n"]
            return out

        for b in batches:
            rows = []
            for r in b.to_pylist():
                if held and r["conv_id"] != held[-1]["conv_id"]:
                    rows += done()
                    held = []
                held.append(r)
            yield _batch(names, types, rows)
        yield _batch(names, types, done() if held else [])

    m = blocks.select("conv_id", "part", "seq", "roles").mapInArrow(costs, f"conv_id {kind}, part int, seq int, n long, costs array<bigint>")
    m = m.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_last(), "part", "seq")
    return run_batches(m.mapInArrow(chain, "part int, seq int, entry int, leave int, offset long, last boolean"), folder, "borders")


def _batch(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def repair(turns: DataFrame, block_turns: int = BLOCK_TURNS, folder: str | None = None) -> DataFrame:
    """conv_id, source_index, piece, action, role, repaired, cost, rendered: the pieces of all conversations."""
    folder = folder or run_folder(turns.sparkSession, "roles")
    blocks = turn_blocks(turns, folder, block_turns)
    kind = blocks.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "source_index", "piece", "action", "role", "repaired", "cost", "rendered"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b.column("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            for r in b.to_pylist():
                got = pieces(r["roles"], r["texts"], r["entry"], r["leave"], r["offset"], r["last"])
                yield _batch(names, types, [(r["conv_id"], *p) for p in got])

    rows = blocks.join(border_states(blocks, folder), ["part", "seq"]).select("conv_id", "roles", "texts", "entry", "leave", "offset", "last")
    return run_batches(rows.mapInArrow(build, f"conv_id {kind}, source_index long, piece int, action string, role string, repaired string, "
                                       "cost long, rendered string"), folder, "pieces")
