"""Joins that SQL has no operator for: ranges, as-of, radius, nearest.

Every one is an equi-join on a bucket of the ordered key, so that rows meet
only near ones and the shuffle is hashed; the exact condition follows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.phase import EARTH_RADIUS_M, haversine_m


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: Column, right_value: Column, reach: float, how: str = "inner") -> DataFrame:
    """Rows of equal ``keys`` with 0 <= right_value - left_value <= reach, as columns of both.

    Sides must have distinct column names but for ``keys``.  Each left row
    goes into the two buckets of width ``reach`` that its range touches.
    """
    width = float(reach) if reach > 0 else 1.0
    bucket = F.floor(left_value / width)
    a = left.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1))).withColumn("_low", left_value.cast("double"))
    b = right.withColumn("_bucket", F.floor(right_value / width)).withColumn("_at", right_value.cast("double"))
    out = a.join(b, [*keys, "_bucket"], how).where((F.col("_at") >= F.col("_low")) & (F.col("_at") - F.col("_low") <= reach))
    return out.drop("_bucket", "_low", "_at")


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: Column, start: Column, stop: Column, width: float) -> DataFrame:
    """Points of equal ``keys`` inside [start, stop]; spans go into every bucket of ``width`` they touch."""
    s = spans.withColumn("_from", start.cast("double")).withColumn("_to", stop.cast("double"))
    s = s.where("_from <= _to").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_to") / width))))
    p = points.withColumn("_at", point.cast("double")).withColumn("_bucket", F.floor(F.col("_at") / width))
    return p.join(s, [*keys, "_bucket"]).where("_at between _from and _to").drop("_bucket", "_at", "_from", "_to")


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str, max_gap: float, value: str, left_id: str) -> DataFrame:
    """Each left row with the nearest right row within ``max_gap``, the earlier on a tie; rows without one go.

    Orders are numbers (days, seconds).  A right row may serve many left ones.
    """
    width = max(float(max_gap), 1e-9)
    near = F.floor(F.col(left_order) / width)
    a = left.withColumn("_bucket", F.explode(F.array(near - 1, near, near + 1)))
    b = right.select(*keys, F.col(right_order).alias("_order"), F.col(value).alias("_value")).withColumn("_bucket", F.floor(F.col("_order") / width))
    gap = F.abs(F.col("_order") - F.col(left_order))
    met = a.join(b, [*keys, "_bucket"]).where(gap <= max_gap).withColumn("_gap", gap)
    best = F.min_by(F.struct("_order", "_value"), F.struct("_gap", "_order"))
    rest = [c for c in left.columns if c not in (*keys, left_id)]
    out = met.groupBy(*keys, left_id).agg(*[F.first(c).alias(c) for c in rest], best.alias("_best"))
    return out.select(*left.columns, F.col("_best._order").alias(right_order), F.col("_best._value").alias(value))


def asof_interpolated(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str, value: str) -> DataFrame:
    """Each left row with the right value at its order, linear between its neighbours; rows outside the span go.

    One pass over the union in order, no join: the last right row at or
    before, and the first at or after.
    """
    a = left.withColumn("_order", F.col(left_order).cast("double")).withColumn("_side", F.lit(1))
    b = right.select(*keys, F.col(right_order).cast("double").alias("_order"), F.col(value).cast("double").alias("_value")).withColumn("_side", F.lit(0))
    both = b.unionByName(a, allowMissingColumns=True)
    here = F.when(F.col("_side") == 0, F.struct(F.col("_order").alias("o"), F.col("_value").alias("v")))
    before = Window.partitionBy(*keys).orderBy("_order", "_side")
    after = Window.partitionBy(*keys).orderBy(F.desc("_order"), "_side")
    both = both.withColumn("_prev", F.last(here, ignorenulls=True).over(before)).withColumn("_next", F.last(here, ignorenulls=True).over(after))
    span = F.col("_next.o") - F.col("_prev.o")
    part = F.when(span > 0, (F.col("_order") - F.col("_prev.o")) / span).otherwise(F.lit(0.0))
    lerp = (1 - part) * F.col("_prev.v") + part * F.col("_next.v")
    out = both.where("_side = 1 and _prev is not null and _next is not null").withColumn(value, lerp)
    return out.select(*left.columns, value)


def radius_join(sites: DataFrame, pixels: DataFrame, radius_m: float, site_id: str = "site", pixel_id: str = "pixel") -> DataFrame:
    """(site, pixel, distance_m) within ``radius_m`` by great circle.

    Both sides have lat and lon columns.  Pixels are bucketed by latitude
    bands of the radius and, in each band, by as many cells of longitude
    around the globe as are no narrower than the radius there; a site asks
    its own band and cell and those beside, across the date line too.
    """
    angle = radius_m / EARTH_RADIUS_M
    band = math.degrees(angle) * 1.001

    def cells(b):  # of a band, from the smallest circle of latitude that a pair may touch
        cosine = F.greatest(F.cos(F.radians(F.least((F.abs(b) + 2) * band, F.lit(90.0)))), F.lit(1e-12))
        width = F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(angle / 2) / cosine))) * 1.001
        return F.greatest(F.floor(360 / width), F.lit(1))

    cell = lambda lon, b: F.floor((lon + 180) / 360 * cells(b))
    own = F.floor(F.col("lat") / band)
    p = pixels.select(F.col(pixel_id), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"), own.alias("_band"), F.pmod(cell(F.col("lon"), own), cells(own)).alias("_cell"))
    s = sites.select(F.col(site_id), F.col("lat").alias("_slat"), F.col("lon").alias("_slon"), F.explode(F.array(own - 1, own, own + 1)).alias("_band"))
    b = F.col("_band")
    beside = F.array_distinct(F.array(*[F.pmod(cell(F.col("_slon"), b) + d, cells(b)) for d in (-1, 0, 1)]))
    s = s.withColumn("_cell", F.explode(beside))
    d = haversine_m(F.col("_slat"), F.col("_slon"), F.col("_plat"), F.col("_plon"))
    return p.join(s, ["_band", "_cell"]).select(site_id, pixel_id, d.alias("distance_m")).where(F.col("distance_m") <= radius_m)


def nearest_planar(sites: DataFrame, pixels: DataFrame, site_id: str = "site", pixel_id: str = "pixel") -> DataFrame:
    """(site, pixel, d2): the nearest pixel by planar distance, the smaller pixel id on a tie.

    Pixels are bucketed by cells that hold a few of them on average; a site
    asks its own cell and the eight around it, and is settled if what it
    finds is no farther than a cell is wide.  The others ask again with cells
    twice as wide, until none is left; rounds are cut by checkpoints.
    """
    from ..functions.phase import planar_distance2
    from .frames import cut

    lat, lon = F.col("lat"), F.col("lon")
    whole = pixels.select("lat", "lon").unionByName(sites.select("lat", "lon")).agg(F.min(lat), F.max(lat), F.min(lon), F.max(lon), F.min(F.cos(F.radians(lat)))).first()
    n = pixels.count()
    if not n or whole[0] is None:
        return sites.select(site_id).where("false").withColumn(pixel_id, F.lit(None)).withColumn("d2", F.lit(None).cast("double"))
    span = max(whole[1] - whole[0], whole[3] - whole[2], 1e-9)
    step, shrink = span / max(1.0, math.sqrt(n / 4)), max(whole[4], 1e-9)
    d2 = planar_distance2(F.col("_slat"), F.col("_slon"), F.col("_plat"), F.col("_plon"))
    todo = cut(sites.select(F.col(site_id), lat.alias("_slat"), lon.alias("_slon")))
    done = None
    while todo.limit(1).count():
        wide = step / shrink
        p = pixels.select(F.col(pixel_id), lat.alias("_plat"), lon.alias("_plon"), F.floor(lat / step).alias("_y"), F.floor(lon / wide).alias("_x"))
        around = F.array(*[F.struct((F.floor(F.col("_slat") / step) + dy).alias("_y"), (F.floor(F.col("_slon") / wide) + dx).alias("_x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        asked = todo.withColumn("_c", F.explode(around)).select("*", "_c.*").drop("_c")
        best = p.join(asked, ["_y", "_x"]).groupBy(site_id, "_slat", "_slon").agg(F.min(F.struct(d2.alias("d2"), F.col(pixel_id))).alias("best"))
        last = step > span
        found = cut((best if last else best.where(F.col("best.d2") <= step**2)).select(site_id, F.col(f"best.{pixel_id}").alias(pixel_id), F.col("best.d2").alias("d2")))
        done = found if done is None else done.unionByName(found)
        if last:
            break
        todo = cut(todo.join(found.select(site_id), site_id, "left_anti"))
        step *= 2
    return done
