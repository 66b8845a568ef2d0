"""Footprints as text: rings, centroids, areas and boxes of polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outer_ring(wkt: Column) -> Column:
    """array<struct<x,y>> of a polygon's outer ring, as written; null where the text is no polygon or empty."""
    body = F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*\(\s*\(([^()]*)\)", 1)
    point = lambda p: F.struct(F.get(F.split(F.trim(p), r"\s+"), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double").alias("y"))
    ring = F.transform(F.split(body, ","), point)
    whole = F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.when((body != "") & whole, ring)


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive counterclockwise."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["cross"]) / 2


def _edges(ring: Column) -> Column:
    n = F.size(ring)

    def edge(i):
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("cross"), (a["x"] + b["x"]).alias("sx"), (a["y"] + b["y"]).alias("sy"))

    return F.transform(F.sequence(F.lit(0), n - 1), edge)


def centroid(ring: Column) -> Column:
    """Struct (x, y): of the area, or the mean of the points where the area is zero; null for no ring."""
    e, area = _edges(ring), signed_area(ring)
    of = lambda c, s: F.when(area != 0, F.aggregate(e, F.lit(0.0), lambda t, k: t + k[s] * k["cross"]) / (6 * area)).otherwise(F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[c]) / F.size(ring))
    return F.when(ring.isNotNull(), F.struct(of("x", "sx").alias("x"), of("y", "sy").alias("y")))


def box(ring: Column, buffer: float = 0.0, digits: int | None = None) -> Column:
    """Struct (w, s, e, n) around a ring, widened by ``buffer`` and rounded."""
    side = lambda f, c, d: f(F.transform(ring, lambda p: p[c])) + d * buffer
    cut = (lambda v: v) if digits is None else (lambda v: F.round(v, digits))
    return F.when(ring.isNotNull(), F.struct(cut(side(F.array_min, "x", -1)).alias("w"), cut(side(F.array_min, "y", -1)).alias("s"), cut(side(F.array_max, "x", 1)).alias("e"), cut(side(F.array_max, "y", 1)).alias("n")))


def counterclockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def to_wkt(ring: Column, digits: int = 6) -> Column:
    """A polygon's text, counterclockwise, coordinates rounded."""
    shown = lambda v: F.format_string(f"%.{digits}f", v)
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(counterclockwise(ring), lambda p: F.concat_ws(" ", shown(p["x"]), shown(p["y"]))), ","), F.lit("))"))


def target(lat: Column, lon: Column, wkt: Column) -> Column:
    """Struct (lat, lon, height): the centre given, else the footprint's centroid; height 0."""
    c = centroid(outer_ring(wkt))
    given = lat.isNotNull() & lon.isNotNull()
    out = F.struct(F.when(given, lat).otherwise(c["y"]).alias("lat"), F.when(given, lon).otherwise(c["x"]).alias("lon"), F.lit(0.0).alias("height"))
    return F.when(given | c.isNotNull(), out)
