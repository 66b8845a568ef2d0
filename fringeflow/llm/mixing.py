"""Mixing sources to target weights by repetition rates.

The sizes are added up per source; weights give each source a target, held
below a ceiling of ``ceiling`` times its size, with the excess reshared by
weight until none is above.  A source's repetition rate is target over size.
Every document is emitted floor(rate) times, plus one copy more with
probability the fraction, drawn from a seeded hash of its id.

Scale: one grouped sum with map-side combine; everything else about sources
happens on the table of sources, whose code-point ranks come from a range
partitioning.  The table of sources is broadcast only if it is small,
otherwise joined with adaptive skew splitting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import durable, free_name

#: Sources up to this many (names up to NAME_CHARS long) are broadcast to the documents.
SMALL, NAME_CHARS = 20_000, 200


def source_targets(df: DataFrame, source: Column, size: Column, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """(source, source_size, target) for each source.

    Sources are ranked by code point, null last, and get ``weights`` in turn.
    ``share`` times all sizes is shared.  Sources without size get target 0.
    """
    sums = df.groupBy(source.alias("source")).agg(F.sum(size).alias("source_size"))
    ranged = sums.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id())
    ranged = durable(ranged)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").count().withColumn("skipped", F.coalesce(F.sum("count").over(before), F.lit(0))).select("part", "skipped")
    inside = Window.partitionBy("part").orderBy("last", "source")
    rank = F.col("skipped") + F.row_number().over(inside) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    table = durable(ranged.join(parts, "part").select("source", "source_size", weight.alias("weight")))

    cap = F.col("source_size") * ceiling
    total = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level, held = 0.0, -1
    while True:  # the level rises until no further source is held at its ceiling
        full = cap <= F.col("weight") * F.lit(level)
        n, used, free = table.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == held or not free:
            break
        held, level = n, max(0.0, total - used) / free
    return table.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).cast("double").alias("target"))


def mix_rates(
    df: DataFrame,
    id_col: str,
    source_col: str,
    size: Column,
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """The rows of ``df`` with four columns more, as a struct ``mix``: size, source_size, target, copies.

    ``size`` is a long expression over ``df``; null counts as 0.  A null
    source is a source of its own, ranked last.  Documents of a source of
    size 0 are emitted never.  Copies depend on the id and the seed alone, so
    reruns agree and repeated rows are drawn alike.  An empty table gives an
    empty result.  The struct is called ``mix``, or ``_mix`` and so on where
    ``df`` has such a column.
    """
    size = F.coalesce(size, F.lit(0)).cast("long")
    targets = source_targets(df, F.col(source_col), size, weights, share, ceiling)
    small = targets.agg(F.count(F.lit(1)) <= SMALL, F.coalesce(F.max(F.length("source")), F.lit(0)) <= NAME_CHARS).first()
    name, key, a = free_name(df, "mix"), free_name(df, "mix_source"), free_name(df, "mix_size")
    targets = targets.select(F.col("source").alias(key), F.struct("source_size", "target").alias(name))
    sized = df.withColumn(a, size)
    out = sized.join(F.broadcast(targets) if all(small) else targets, sized[source_col].eqNullSafe(targets[key]))
    rate = F.when(F.col(f"{name}.source_size") > 0, F.col(f"{name}.target") / F.col(f"{name}.source_size")).otherwise(F.lit(0.0))
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11) * F.lit(2.0**-53)
    copies = F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")
    mix = F.struct(F.col(a).alias("size"), F.col(f"{name}.source_size"), F.col(f"{name}.target"), copies.alias("copies"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], mix.alias(name))


def mix_sources(df: DataFrame, id_col: str, source_col: str, size: Column, **options) -> DataFrame:
    """The mix itself: each row of ``df`` as often as its copies say, same columns."""
    rated = mix_rates(df, id_col, source_col, size, **options)
    name = rated.columns[-1]
    again = rated.where(F.col(f"{name}.copies") > 0).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{name}.copies"))))
    return again.select(*[F.col(f"`{c}`") for c in df.columns])
