"""Caches and retention: newest entries, budgets, reuse by identity, numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .frames import cut


def running(df: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with running totals in a global order, ties included one after another.

    Rows are range partitioned and summed inside each; a partition starts at
    the totals of those before, one row each.  No task sees all rows.
    """
    w = Window.partitionBy("_part").orderBy(*order)
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_t{k}") for k, v in enumerate(sums.values())])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_s{k}") for k in range(len(sums))])
    out = ranged.join(F.broadcast(starts), "_part")
    inside = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumns({n: F.sum(v).over(inside) + F.col(f"_s{k}") for k, (n, v) in enumerate(sums.items())})
    return out.drop("_part", *[f"_s{k}" for k in range(len(sums))])


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with its place, from 1, in a global order."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running(one, order, {name: "_one"}).drop("_one").withColumn(name, F.col(name).cast("long"))


def retention(entries: DataFrame, keep: int, budget: int | None = None) -> DataFrame:
    """entries with ``fate``: kept, protected, aged or evicted.

    ``entries``: id, stage, finished, size, ok, orphan.  The newest ``keep``
    of each stage stay, orphans excepted; with a budget the newest ok entry
    of each stage is protected, and the oldest other survivors go until all
    fit.
    """
    newest = Window.partitionBy("stage", "orphan").orderBy(F.desc("finished"), F.desc("id"))
    ok = Window.partitionBy("stage", "ok", "orphan").orderBy(F.desc("finished"), F.desc("id"))
    e = entries.withColumn("_rank", F.row_number().over(newest)).withColumn("_ok_rank", F.row_number().over(ok))
    safe = F.col("ok") & ~F.col("orphan") & (F.col("_ok_rank") == 1)
    in_rank = ~F.col("orphan") & (F.col("_rank") <= keep)
    e = e.withColumn("_safe", safe & (F.lit(budget is not None) | in_rank)).withColumn("_kept", in_rank | F.col("_safe")).drop("_rank", "_ok_rank")
    fate = F.when(~F.col("_kept"), "aged").when(F.col("_safe"), "protected").otherwise("kept")
    e = e.withColumn("fate", fate).drop("_safe", "_kept")
    if budget is None:
        return e
    total = e.where("fate <> 'aged'").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    over = total - budget
    queue = running(e.where("fate = 'kept'"), ["finished", "id"], {"_cum": "size"})
    queue = queue.withColumn("fate", F.when(F.col("_cum") - F.col("size") < over, "evicted").otherwise("kept")).drop("_cum")
    return queue.unionByName(e.where("fate <> 'kept'"))


def least_recent(entries: DataFrame, budget: int) -> DataFrame:
    """The oldest entries that must go for the rest to fit the budget."""
    total = entries.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return running(entries, ["finished", "id"], {"_cum": "size"}).where(F.col("_cum") - F.col("size") < total - budget).drop("_cum")


def reuse(wanted: DataFrame, done: DataFrame, key: Sequence[str], identity: str) -> tuple[DataFrame, DataFrame]:
    """Wanted rows whose result is there under the same identity, and those to compute."""
    same = done.select(*key, identity).distinct()
    return wanted.join(same, [*key, identity], "left_semi"), wanted.join(same, [*key, identity], "left_anti")


def newest_ok(entries: DataFrame) -> DataFrame:
    """The latest ok entry of each stage."""
    return entries.where("ok and not orphan").groupBy("stage").agg(F.max_by("id", F.struct("finished", "id")).alias("id"))


def outer_difference(before: DataFrame, after: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key..., before, after, state): missing, extra, changed or same, by a full outer join."""
    a = before.select(*key, F.col(value).alias("before"))
    b = after.select(*key, F.col(value).alias("after"))
    state = F.when(F.col("after").isNull(), "missing").when(F.col("before").isNull(), "extra").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return a.join(b, list(key), "full_outer").withColumn("state", state)
