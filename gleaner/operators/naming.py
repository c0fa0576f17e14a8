"""Names that no two rows share, given in order: a row gets the first of its candidates that no earlier row has.

Row by row that is a loop; here it goes by rounds over all rows. Every row asks for one of its candidates, each name goes to the
earliest row that asks for it, and the others ask for their next one, until nobody has to. As every name prefers earlier rows,
what comes out is what the loop gives. Rows with the same candidates (a group) are never asked to try one by one: of such rows a
later one has a later candidate, so a row starts at its rank, and where one has to go on, those after it in the group go on too.
Hence rounds are few: they count how often made names meet names of other groups, not how many rows share a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.tables import delete, numbered, written


def allocate(rows: DataFrame, group: list[str], order: list[str], name_of: Callable[[Column], Column], start: Column | None = None, taken: DataFrame | None = None) -> tuple[DataFrame, int]:
    """rows with `name`, and the rounds it took.

    group: columns that fix a row's candidates. order: columns that order all rows, different for each. name_of(k): the k-th candidate, from 0, in terms of the group's columns.
    start: the least candidate that a group's first row can get, if not 0. taken: names (name) that are given already.
    """
    spark = rows.sparkSession
    at, path = numbered(rows.withColumn("_start", F.lit(0) if start is None else start), [*group, *order], "_at")
    first = at.groupBy(*group).agg(F.min("_at").alias("_first"))
    rank = (F.col("_at") - F.col("_first")).alias("_rank")
    same = F.lit(True)
    for c in group:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    placed = at.alias("a").join(first.alias("b"), same).select("a.*", rank).withColumn("_k", F.col("_rank") + F.col("_start"))
    state, state_at = written(placed.drop("_at", "_start"), "asked")
    delete(spark, path)
    rounds = 0
    while True:
        rounds += 1
        asked = state.withColumns({"name": name_of(F.col("_k")), "_order": F.struct(*order)})
        best = asked.groupBy("name").agg(F.min("_order").alias("_best"))
        if taken is not None:
            best = best.join(taken.select("name", F.lit(True).alias("_given")).distinct(), "name", "left")
        else:
            best = best.withColumn("_given", F.lit(None).cast("boolean"))
        lost = asked.join(best, "name").withColumn("_lost", (F.coalesce("_given", F.lit(False)) | (F.col("_order") != F.col("_best"))).cast("long"))
        judged, judged_at = written(lost.drop("_order", "_best", "_given"), "judged")
        losers = judged.where("_lost = 1").groupBy(*group).agg(F.min("_rank").alias("_from"))
        if losers.isEmpty():
            delete(spark, state_at)
            return judged.drop("_k", "_rank", "_lost"), rounds
        # only groups with a loser are sorted, and a row's next candidate follows from those before it in one running maximum
        so_far = Window.partitionBy(*(f"_g{k}" for k in range(len(group)))).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
        own = {f"_g{k}": F.col(c) for k, c in enumerate(group)}
        same = F.lit(True)
        for k, c in enumerate(group):
            same = same & F.col(f"_g{k}").eqNullSafe(F.col(c))
        touched = judged.withColumns(own).drop(*group).join(losers, same)
        moved = touched.withColumn("_k", F.col("_rank") + F.max(F.col("_k") + F.col("_lost") - F.col("_rank")).over(so_far))
        still = judged.join(losers.withColumns(own).drop(*group), same, "left_anti")
        columns = [c for c in state.columns]
        new, new_at = written(moved.select(columns).unionByName(still.select(columns)), "asked")
        delete(spark, state_at)
        delete(spark, judged_at)
        state, state_at = new, new_at


def unique_titles(rows: DataFrame, title: str, key: str, order: list[str]) -> tuple[DataFrame, int]:
    """Titles in order: the title, else title（key）, else title（key-2）, title（key-3） and so on; `name` has it. Null titles and keys count as empty."""
    held = rows.withColumns({"_title": F.coalesce(title, F.lit("")), "_key": F.coalesce(F.col(key).cast("string"), F.lit(""))})
    # of a title's rows the first in order may have it plain; groups without that row begin at their first bracketed name
    firsts = held.groupBy("_title").agg(F.min_by("_key", F.struct(*order)).alias("_owner"))
    dealt = held.join(firsts, "_title")
    bracketed = lambda k: F.concat("_title", F.lit("（"), "_key", F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise(""), F.lit("）"))
    out, rounds = allocate(dealt, ["_title", "_key"], order, lambda k: F.when(k == 0, F.col("_title")).otherwise(bracketed(k)), (F.col("_owner") != F.col("_key")).cast("long"))
    return out.drop("_title", "_key", "_owner"), rounds


def numbered_name(base: str) -> Callable[[Column], Column]:
    return lambda k: F.concat(base, F.when(k > 0, F.concat(F.lit("-"), k.cast("string"))).otherwise(""))
