"""Minimum-cost role repair of conversations, then their rendering.

A legal conversation walks an automaton of roles: an optional system turn, then user and assistant in turn, with tool turns
after an assistant and before the next; it ends with an assistant. Each turn may keep its role, be relabelled, be merged into
the turn before it (same role), or be preceded by inserted empty turns; dynamic programming over the automaton's states finds
the repair of least cost. Turns are sorted by range of (conversation, turn), so that even a conversation with a third of
all turns is spread over tasks, and cut into segments of at most SEGMENT turns. A segment is one matrix of least costs between
states; a conversation combines the matrices of its segments, which fixes the states between them; then each segment is
traced back by itself. Every turn's row has the text that it adds to the rendered conversation; rows in order of seq make the whole.

Roles are compared without case and outer blanks. A null or unknown role must be relabelled. A null text counts as empty. Null
conversation ids make one conversation, null turns come first, ties go by role and text. Equal costs go to the first role in the
order of ROLES. Repeated rows are turns like any other. Texts of any length are rendered whole. A table without rows gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import per_batch, written

ROLES = ("system", "user", "assistant", "tool")
START, UNKNOWN = 4, 4
LEGAL = {START: (0, 1), 0: (1,), 1: (2,), 2: (1, 3), 3: (2, 3)}
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 2.0, 1.0, 1.0, 3.0
SEGMENT = 256


@functools.cache
def inserted() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest legal ways between states: the roles to insert. To the end: key (state, START)."""
    out = {}
    for s in range(5):
        wave, seen = [(t, ()) for t in LEGAL[s]], {}
        while wave:
            after = []
            for t, way in wave:
                if t not in seen:
                    seen[t] = way
                    after += [(u, (*way, t)) for u in LEGAL[t]]
            wave = after
        out |= {(s, t): way for t, way in seen.items()}
    return out | {(s, START): () if s == 2 else (*out[s, 2], 2) for s in range(5)}


@functools.cache
def steps(role: int) -> tuple[np.ndarray, dict[tuple[int, int], tuple[str, tuple[int, ...]]]]:
    """For a turn of this role: least cost from each state to each, and what is done: action, inserted roles."""
    cost, how = np.full((5, 5), np.inf), {}
    for s in range(5):
        for t in range(4):
            change = 0.0 if t == role else RELABEL if role != UNKNOWN else RELABEL_UNKNOWN
            ways = []
            if (s, t) in inserted():
                way = inserted()[s, t]
                ways.append((change + INSERT * len(way), "keep" if t == role else "relabel", way))
            if s == t:
                ways.append((change + MERGE, "merge" if t == role else "relabel+merge", ()))
            if ways:
                cost[s, t], *did = min(ways)
                how[s, t] = tuple(did)
    return cost, how


def role_number(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else UNKNOWN


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def segment_matrix(roles: list[int]) -> np.ndarray:
    total = steps(roles[0])[0]
    for r in roles[1:]:
        total = combine(total, steps(r)[0])
    return total


def end_costs() -> np.ndarray:
    return np.array([INSERT * len(inserted()[s, START]) for s in range(5)])


def between(matrices: list[np.ndarray]) -> list[int]:
    """The state before each segment and after the last, on the cheapest way."""
    best, back = np.full(5, np.inf), []
    best[START] = 0.0
    for m in matrices:
        through = best[:, None] + m
        back.append(through.argmin(axis=0))
        best = through.min(axis=0)
    states = [int((best + end_costs()).argmin())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def trace(roles: list[int], enter: int, leave: int) -> list[int]:
    """The state after each turn of a segment, between the given states."""
    best, back = np.full(5, np.inf), []
    best[enter] = 0.0
    for r in roles:
        through = best[:, None] + steps(r)[0]
        back.append(through.argmin(axis=0))
        best = through.min(axis=0)
    states = [leave]
    for b in reversed(back[1:]):
        states.append(int(b[states[-1]]))
    return states[::-1]


def opened(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


CLOSED = "<|im_end|>\n"


def rendered(state: int, action: str, way: tuple[int, ...], role: int, text: str) -> str:
    """What a turn adds to the conversation when the turn before it left it in `state`."""
    if "merge" in action:
        return "\n" + text
    return CLOSED * (state != START) + "".join(opened(r) + CLOSED for r in way) + opened(role) + text


def closing(state: int) -> str:
    return CLOSED + "".join(opened(r) + CLOSED for r in inserted()[state, START])


SEGMENT_ROW = "conv_id long, seg long, turns array<struct<turn:long,role:string,text:string>>, costs array<double>"


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, k = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
    held, conv = [], None

    def row() -> dict:
        roles = [role_number(t["role"]) for t in held]
        return {"conv_id": conv, "seg": base + k, "turns": held, "costs": segment_matrix(roles).ravel().tolist()}

    schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("turns", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))), ("costs", pa.list_(pa.float64()))])
    for b in batches:
        out = []
        for r in b.to_pylist():
            if held and (r["conv_id"] != conv or len(held) == SEGMENT):
                out.append(row())
                held, k = [], k + 1
            conv = r.pop("conv_id")
            held.append(r)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


REPAIRED = "conv_id long, turn long, seq long, role string, new_role string, action string, inserted string, cost double, rendered string"


def repair(df: DataFrame) -> DataFrame:
    """One row for each turn: its place seq in the conversation's order, new role, action, roles inserted before it (and at the end after it), cost, and the text it adds."""
    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("role", "text").alias("_tie")
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.withColumn("_tie", tie).repartitionByRange(count, "conv_id", "turn", "_tie").sortWithinPartitions("conv_id", "turn", "_tie").drop("_tie")
    parts, _ = written(ordered.mapInArrow(segments, SEGMENT_ROW), "segments")

    def link(rows: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("conv_id", "seg", "enter", "leave", "ends")}
        for conv, own in zip(rows["conv_id"], rows["own"], strict=True):
            states = between([np.array(x["costs"]).reshape(5, 5) for x in own])
            for k, x in enumerate(own):
                for c, v in zip(out, (conv, x["seg"], states[k], states[k + 1], k == len(own) - 1), strict=True):
                    out[c].append(v)
        return out

    chains = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "costs"))).alias("own"))  # a matrix for each SEGMENT turns
    ways = per_batch(chains, link, "conv_id long, seg long, enter int, leave int, ends boolean")

    def edit(rows: dict) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in REPAIRED.split(", ")}
        for conv, seg, turns, enter, leave, ends in zip(*(rows[c] for c in ("conv_id", "seg", "turns", "enter", "leave", "ends")), strict=True):
            roles = [role_number(t["role"]) for t in turns]
            state = enter
            for i, (turn, role, new) in enumerate(zip(turns, roles, trace(roles, enter, leave), strict=True)):
                cost, how = steps(role)
                action, way = how[state, new]
                tail = closing(new) if ends and i == len(turns) - 1 else ""
                after = inserted()[new, START] if tail else ()
                names = [ROLES[r] for r in (*way, *after)]
                values = (conv, turn["turn"], (seg << 9) + i, turn["role"], ROLES[new], action, ",".join(names), float(cost[state, new]) + INSERT * len(after), rendered(state, action, way, new, turn["text"]) + tail)
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)
                state = new
        return out

    ways = ways.withColumnRenamed("conv_id", "_conv").withColumnRenamed("seg", "_seg")
    met = parts.join(ways, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seg") == F.col("_seg"))).select("conv_id", "seg", "turns", "enter", "leave", "ends")
    return per_batch(met, edit, REPAIRED)


def op2_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
