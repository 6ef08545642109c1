"""Running values over the rows of a key, by splits.

A key may hold most of all rows, so no window runs over all of them. The rows of a key are cut into splits; each split is
worked out on its own, its effect on what follows is one row, and effects are composed from split to split, again by
splits. What a row then has is its split's own value, put together with what came in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.sources.stored import written

#: Rows of a split, where ``order`` counts rows; also effects of a split of splits.
SPLIT_ROWS = 10_000
#: Effects of splits are split again so often; a window then sees a 1 / SPLIT_ROWS^LEVELS of a key's rows.
LEVELS = 2


@dataclass(frozen=True)
class Effect:
    """How values compose: ``over`` some rows, and what came ``before`` with what is ``within``."""

    over: Callable[[str], Column]
    compose: Callable[[Column, Column], Column]


LAST = Effect(lambda value: F.last(value, ignorenulls=True), lambda before, within: F.coalesce(within, before))
SUM = Effect(lambda value: F.sum(value), lambda before, within: F.coalesce(before, F.lit(0)) + F.coalesce(within, F.lit(0)))


def running(rows: DataFrame, key: list[str], order: str, values: dict[str, tuple[Column, Effect]], *, before: bool = False,
            split_rows: int = SPLIT_ROWS, levels: int = LEVELS) -> DataFrame:
    """Rows with running values: ``{name: (value, effect)}``, up to each row, or up to the row ``before`` it.

    ``order`` is a whole number from 0 or 1 on, unique within a key, about as dense as rows are; a null one comes first.
    Rows with equal order are composed in no certain order. Nothing is gathered: the largest group a task sees is a split.
    """
    given = {name: f"_of_{name}" for name in values}
    rows = rows.select("*", *[value.alias(given[name]) for name, (value, _) in values.items()])
    effects = {name: effect for name, (_, effect) in values.items()}
    return _composed(rows, key, order, effects, given, before, split_rows, levels).drop(*given.values())


def _composed(rows: DataFrame, key: list[str], order: str, effects: dict[str, Effect], given: dict[str, str], before: bool,
              split_rows: int, levels: int) -> DataFrame:
    def over(window) -> dict[str, Column]:
        return {n: effects[n].over(given[n]).over(window) for n in effects}

    to = -1 if before else Window.currentRow
    if levels == 0:
        found = over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, to))
        return rows.select("*", *[effects[n].compose(F.lit(None), found[n]).alias(n) for n in effects])
    split = f"_split_{levels}"
    rows = rows.withColumn(split, F.floor(F.coalesce(order, F.lit(0)) / split_rows))
    of_split = Window.partitionBy(*key, split).orderBy(order)
    so_far = of_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.select("*", *[c.alias(n) for n, c in over(of_split.rowsBetween(Window.unboundedPreceding, to)).items()])
    # a split's effect stands at its last row; by itself it is a row of one split above
    whole = rows.select(
        *key, split, F.lead(split).over(of_split).alias("_next"), *[c.alias(given[n]) for n, c in over(so_far).items()]
    ).where("_next IS NULL").drop("_next")
    come_in = _composed(whole, key, split, effects, given, True, split_rows, levels - 1)
    come_in = come_in.select(*[F.col(k).alias(f"_key_{k}") for k in (*key, split)], *[F.col(n).alias(f"_in_{n}") for n in effects])
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in (*key, split)]
    kept = [c for c in rows.columns if c != split]
    return within.join(come_in, same, "left").select(
        *kept, *[effects[n].compose(F.col(f"_in_{n}"), F.col(n)).alias(n) for n in effects]
    )


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered 0, 1, 2, ... by ``order``, over all tasks.

    Rows are dealt by ranges of the order and sorted in their task; a row's number is its place in the task behind the rows
    of the tasks before. The dealt rows are written once, as ranges found anew might differ; what tasks tell each other is
    one count each.
    """
    within = 2**33 - 1  # the part of an id that counts rows within the task
    dealt = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().bitwiseAND(F.lit(within)).alias("_place"))
    )
    tasks = dealt.groupBy("_task").agg(F.count("*").alias("_rows")).withColumn("_all", F.floor(F.col("_task") / F.lit(2**31)))
    before = running(tasks, ["_all"], "_task", {"_before": (F.col("_rows"), SUM)}, before=True).select("_task", "_before")
    # as many rows as there are tasks
    return dealt.join(F.broadcast(before), "_task").withColumn(name, F.col("_before") + F.col("_place")).drop("_task", "_place", "_before")
