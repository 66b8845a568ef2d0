"""Synthetic scenes as rows: masks, terrain, regions, coherence, noise, amplitudes, tiled truth.

Every value is an expression over a pixel's row and column, so a scene of any
size is generated where it is used.  Draws are columns in [0, 1): by
:func:`drawn` from a seed and any tokens, the same on every run.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.phase import MAX_PHASE_STD, wrap


def grid(spark: SparkSession, n_layers: int, ny: int, nx: int) -> DataFrame:
    """(layer, row, col) of all pixels."""
    i = F.col("id")
    return spark.range(n_layers * ny * nx).select(F.floor(i / (ny * nx)).alias("layer"), F.floor(i % (ny * nx) / nx).alias("row"), (i % nx).alias("col"))


def drawn(seed: int, *tokens: Column) -> Column:
    """A uniform draw told by a seed and tokens."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *tokens), 11) * F.lit(2.0**-53)


def normal(u: Column, v: Column) -> Column:
    """A standard normal draw from two uniform ones."""
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def water(col: Column, nx: int, fraction: float) -> Column:
    """The left columns, as many as the fraction rounds to."""
    return col < round(nx * fraction)


def ridge(col: Column, nx: int, height_m: float = 400.0, sigma_px: float = 8.0, centre: float | None = None) -> Column:
    """Height of a ridge along the rows."""
    return height_m * F.exp(-F.pow(col - (nx / 2 if centre is None else centre), 2) / (2 * sigma_px * sigma_px))


def layover(dem: DataFrame, value: str, spacing_m: float, incidence_deg: float, side: str = "left") -> DataFrame:
    """dem with ``layover``: where the slope that faces the sensor is steeper than the incidence; differences one-sided at the edges."""
    w = Window.partitionBy("layer", "row").orderBy("col")
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    slope = F.when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2) / spacing_m
    facing = slope if side == "left" else -slope
    return dem.withColumn("layover", F.coalesce(F.degrees(F.atan(facing)) > incidence_deg, F.lit(False)))


def region(row: Column, col: Column, ny: int, nx: int, kind: str) -> Column:
    """Label of a pixel: halves 0 and 1, quadrants 0 to 3, stripes 0 to 3."""
    right, low = (col >= nx // 2).cast("int"), (row >= ny // 2).cast("int")
    if kind == "halves":
        return right
    if kind == "quadrants":
        return right + 2 * low
    if kind == "stripes":
        return sum(((col >= i * nx // 4).cast("int") for i in (1, 2, 3)), F.lit(0))
    raise ValueError(f"unknown kind of regions {kind!r}")


def coherence(row: Column, col: Column, blobs: Sequence[tuple[float, float, float]], base: float = 0.8, low: float = 0.15, jitter: Column | None = None) -> Column:
    """A level with blobs (row, col, width) of low coherence, and a jitter of 0.03 times a normal draw."""
    c = F.lit(base)
    for y, x, s in blobs:
        weight = F.exp(-(F.pow(row - y, 2) + F.pow(col - x, 2)) / (2 * s * s))
        c = c * (1 - weight) + low * weight
    if jitter is not None:
        c = c + 0.03 * jitter
    return F.least(F.greatest(c, F.lit(0.01)), F.lit(0.999))


def phase_noise(coh: Column, z: Column, looks: int = 1) -> Column:
    """Noise of the least deviation that a coherence allows, the uniform limit at most, from a normal draw."""
    g2 = F.pow(F.least(F.greatest(coh, F.lit(0.0)), F.lit(1.0)), 2)
    std = F.when(g2 > 0, F.least(F.sqrt((1 - g2) / (2.0 * max(looks, 1) * g2)), F.lit(MAX_PHASE_STD))).otherwise(MAX_PHASE_STD)
    return z * std


def coherence_matrix(n: int, tau: float = 4.0, floor: float = 0.0):
    """Coherence of epochs that decays with their distance towards a floor."""
    import numpy as np

    i = np.arange(n)
    return floor + (1 - floor) * np.exp(-np.abs(i[:, None] - i) / tau)


def complex_stack(pixels: DataFrame, keys: Sequence[str], gamma, phase: Column, seed: int = 0, amplitude: Column | float = 1.0) -> DataFrame:
    """(keys..., epoch, phase_true, re, im): a complex image an epoch whose covariance over pixels is known.

    ``gamma``: the coherence of the epochs; ``phase``: the phase of an epoch,
    an expression over the pixel's columns and ``epoch``, which is drawn to
    zero at the first.  A pixel's draws are told by the seed and its keys, and
    mixed by the factor of ``gamma``, so pixels are made independently.
    """
    import numpy as np

    n = len(gamma)
    factor = np.linalg.cholesky(np.asarray(gamma, float) + 1e-9 * np.eye(n)) / math.sqrt(2)
    at = lambda part, k: normal(drawn(seed, F.lit(f"{part}/{k}/a"), *keys), drawn(seed, F.lit(f"{part}/{k}/b"), *keys))
    draws = pixels.select("*", *[F.array(*[at(part, k) for k in range(n)]).alias(f"_{part}") for part in ("re", "im")])
    rows = draws.withColumn("_f", F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), F.array(*[F.lit(float(x)) for x in factor[e]]).alias("row")) for e in range(n)])))
    rows = rows.withColumn("epoch", F.col("_f.epoch"))
    mixed = lambda part: F.aggregate(F.zip_with(F.col("_f.row"), F.col(part), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    first = rows.withColumn("_p", phase).withColumn("_re", mixed("_re")).withColumn("_im", mixed("_im"))
    p = F.col("_p") - F.first("_p").over(Window.partitionBy(*keys).orderBy("epoch"))
    a = amplitude if isinstance(amplitude, Column) else F.lit(float(amplitude))
    turned = first.withColumn("phase_true", p).withColumn("_a", a)
    c, s = F.cos("phase_true"), F.sin("phase_true")
    return turned.select(*keys, "epoch", "phase_true", (F.col("_a") * (F.col("_re") * c - F.col("_im") * s)).alias("re"), (F.col("_a") * (F.col("_re") * s + F.col("_im") * c)).alias("im"))


def rayleigh(scale: Column, u: Column) -> Column:
    """Single-look amplitude of a scale."""
    return scale * F.sqrt(-2 * F.log(1 - u))


def interferogram(pixels: DataFrame, unw: str, coh: str, mask: str, z: Column, looks: int = 1) -> DataFrame:
    """pixels with ``unw_true``, ``wrapped`` and ``coh``, missing where masked: truth, truth with noise wrapped, and zero coherence."""
    noisy = wrap(F.col(unw) + phase_noise(F.col(coh), z, looks))
    seen = ~F.col(mask)
    return pixels.withColumns({"unw_true": F.col(unw), "wrapped": F.when(seen, noisy), "coh": F.when(seen, F.col(coh)).otherwise(0.0)})


def with_cycles(tiles: DataFrame, value: str, u: Column, most: int) -> DataFrame:
    """tiles with ``cycles``, a whole number from -most to most by a draw for the tile, and ``value`` shifted by as many turns."""
    k = F.floor(u * (2 * most + 1)).cast("long") - most
    return tiles.withColumn("cycles", k).withColumn(value, F.col(value) + 2 * math.pi * F.col("cycles"))
