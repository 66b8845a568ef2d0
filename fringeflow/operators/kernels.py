"""Kernels over neighbourhoods and tiles: homogeneous neighbours, seam jumps, recovered offsets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ks_of(a: Column, b: Column) -> Column:
    """Largest distance of the empirical distributions of two arrays."""
    share = lambda x, v: F.size(F.filter(x, lambda e: e <= v)) / F.size(x)
    return F.array_max(F.transform(F.concat(a, b), lambda v: F.abs(share(a, v) - share(b, v))))


def homogeneous_means(pixels: DataFrame, keys: Sequence[str], half: int, critical: Column, value: str) -> DataFrame:
    """(keys..., row, col, n_shp, mean): the mean of ``value`` over the neighbours within ``half`` whose amplitudes are distributed alike, itself included.

    ``pixels``: keys, row, col, ``amps`` (an array, one amplitude a date) and
    ``value``.  ``critical`` is an expression over ``n`` and ``m``, the sizes
    of the two samples.  Every pixel goes to the (2 half + 1)^2 pixels that it
    neighbours, by an equi-join on the place.
    """
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-half, half + 1) for dx in range(-half, half + 1)])
    given = pixels.withColumn("s", F.explode(steps)).select(*keys, (F.col("row") + F.col("s.dy")).alias("row"), (F.col("col") + F.col("s.dx")).alias("col"), F.col("amps").alias("_amps"), F.col(value).alias("_value"))
    met = pixels.join(given, [*keys, "row", "col"]).withColumns({"n": F.size("amps"), "m": F.size("_amps")})
    alike = met.where(ks_of(F.col("amps"), F.col("_amps")) <= critical)
    return alike.groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("n_shp"), F.avg("_value").alias("mean"))


def seam_jumps(pixels: DataFrame, keys: Sequence[str], value: str, axis: str, across: Sequence[int]) -> DataFrame:
    """(keys..., seam, jump, n, share): at each seam the most frequent whole-cycle jump between the two pixels beside it, the smallest of equals, and its share.

    ``axis``: row or col; ``across``: the first index behind each seam.
    """
    along = "col" if axis == "row" else "row"
    seam = F.explode(F.array(*[F.lit(c) for c in across])).alias("seam")
    rows = pixels.select(*keys, F.col(axis).alias("_at"), F.col(along).alias("_along"), F.col(value).alias("_v"), seam).where((F.col("_at") == F.col("seam")) | (F.col("_at") == F.col("seam") - 1))
    pair = rows.groupBy(*keys, "seam", "_along").agg(F.max(F.when(F.col("_at") == F.col("seam"), F.col("_v"))).alias("after"), F.max(F.when(F.col("_at") < F.col("seam"), F.col("_v"))).alias("before"))
    jumps = pair.where("after is not null and before is not null").withColumn("jump", F.rint((F.col("after") - F.col("before")) / (2 * math.pi)).cast("long"))
    counts = jumps.groupBy(*keys, "seam", "jump").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys, "seam").agg(F.min(F.struct((-F.col("n")).alias("minus"), F.abs("jump").alias("size"), "jump")).alias("b"), F.sum("n").alias("total"))
    return best.select(*keys, "seam", F.col("b.jump").alias("jump"), (-F.col("b.minus")).alias("n"), (-F.col("b.minus") / F.col("total")).alias("share"))


def offsets_recovered(tiles: DataFrame, group: str) -> DataFrame:
    """(group, exact, n_wrong, max_error): found offsets against true ones, both relative to the first tile's; ``tiles``: group, tile, found, truth."""
    first = tiles.groupBy(group).agg(F.min_by(F.struct("found", "truth"), "tile").alias("o"))
    error = (F.col("found") - F.col("o.found")) - (F.col("truth") - F.col("o.truth"))
    e = tiles.join(first, group).withColumn("e", error)
    return e.groupBy(group).agg(F.bool_and(F.col("e") == 0).alias("exact"), F.count_if(F.col("e") != 0).alias("n_wrong"), F.max(F.abs("e")).alias("max_error"))
