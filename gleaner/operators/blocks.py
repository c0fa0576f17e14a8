"""Folds over long runs of rows, cut into blocks that pass their end state on.

A fold goes over a key's rows in order with a state that each row may change. A key may hold a third of all rows, so the rows of
all keys, in order, are cut into blocks of a set number of rows. Every block is folded at first as if its first run began there;
then each block that the block before enters with another state is folded again from that state, until no incoming state
changes. Folds forget where they began after a few rows, so this takes two or three rounds; at the worst as many as a run has
blocks, since after every round at least one more block of each run is right. What passes between blocks is one row a block.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gleaner.tables import delete, numbered, written

#: fold(state, row) gives the next state and what the row is (a short text); rows and states are tuples of the same columns, the state None before a key's first row.
Fold = Callable[[tuple | None, tuple], tuple[tuple, str]]


def folded(df: DataFrame, key: str, order: list[str], state: list[str], fold: Fold, rows: int = 20_000) -> tuple[DataFrame, int]:
    """df with a column `verdict`, and how many rounds it took. Rows without a key are left out; nulls in state columns are None; rows that tie in key and order come in any order."""
    spark, types, columns = df.sparkSession, dict(df.dtypes), df.columns
    table, path = numbered(df.where(F.col(key).isNotNull()), [key, *order], "_row")
    dealt = table.withColumn("_block", F.floor(F.col("_row") / rows).cast("long"))
    names = ["_key", *(f"_{c}" for c in state)]
    ends_schema = f"_block long, _from_key {types[key]}, _key {types[key]}, " + ", ".join(f"`_{c}` {types[c]}" for c in state)
    arrow_ends, out_schema = to_arrow_schema(StructType.fromDDL(ends_schema)), ", ".join(f"`{c}` {types[c]}" for c in df.columns) + ", verdict string"

    def go(group: pa.Table, incoming: pa.Table) -> tuple[list[str], list]:
        before, now, out = None, None, []
        if incoming.num_rows:
            before, *now = (incoming.column(c)[0].as_py() for c in names)
        for k, *row in zip(*(group.column(c).to_pylist() for c in (key, *state)), strict=True):
            now, verdict = fold(tuple(now) if k == before else None, tuple(row))
            before = k
            out.append(verdict)
        return out, [before, *now]

    def end(group: pa.Table, incoming: pa.Table) -> pa.Table:
        if not group.num_rows:  # the state after the last block
            return arrow_ends.empty_table()
        group = group.sort_by("_row")
        last = [group.column("_block")[0].as_py(), group.column(key)[0].as_py(), *go(group, incoming)[1]]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(last, arrow_ends, strict=True)], schema=arrow_ends)

    def judge(group: pa.Table, incoming: pa.Table) -> pa.Table:
        group = group.sort_by("_row")
        verdicts = go(group, incoming)[0] if group.num_rows else []
        return group.select(columns).append_column("verdict", pa.array(verdicts, pa.string()))

    state_of = F.struct(*names)
    came = spark.createDataFrame([], ends_schema)  # the state before each block: none is known
    ends, ends_at, old_at, todo, rounds = None, None, None, dealt, 0
    while True:
        rounds += 1
        fresh = todo.groupBy("_block").cogroup(came.groupBy("_block")).applyInArrow(end, ends_schema)
        if ends is not None:  # a block that was folded again counts by its new end
            both = ends.withColumn("_again", F.lit(0)).unionByName(fresh.withColumn("_again", F.lit(1)))
            fresh = both.groupBy("_block").agg(F.max_by(F.struct("_from_key", *names), "_again").alias("_e")).select("_block", "_e.*")
        new, new_at = written(fresh, "ends")
        if old_at:
            delete(spark, old_at)
        before, came = came, new.withColumn("_block", F.col("_block") + 1)
        # what comes matters where the run of a key goes on from one block to the next, and another state came before
        goes_on = came.join(new.select("_block", F.col("_from_key").alias("_begins")), "_block").where(F.col("_key") == F.col("_begins"))
        moved = goes_on.join(before.select("_block", state_of.alias("_was")), "_block", "left").where(~state_of.eqNullSafe(F.col("_was"))).select("_block")
        todo = dealt.join(moved, "_block", "left_semi")
        ends, ends_at, old_at = new, new_at, ends_at
        if moved.isEmpty():
            break
    if old_at:
        delete(spark, old_at)
    return dealt.groupBy("_block").cogroup(came.groupBy("_block")).applyInArrow(judge, out_schema), rounds
