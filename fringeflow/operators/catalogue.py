"""Acquisition catalogues: filters, matching of orbits and granules, coverage, completeness."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import polarisations
from .frames import cut
from .storage import numbered


def by_direction(df: DataFrame, wanted: str, column: str = "direction") -> DataFrame:
    """asc, desc or auto; anything else is refused."""
    kinds = {"asc": "ASCENDING", "desc": "DESCENDING"}
    if wanted == "auto":
        return df
    if wanted not in kinds:
        raise ValueError(f"unknown orbit direction {wanted!r}")
    return df.where(F.col(column) == kinds[wanted])


def by_polarisation(df: DataFrame, wanted: str, column: str = "pol") -> DataFrame:
    """Rows that hold the channel; all rows where none does, so that a rule can say why."""
    hit = F.array_contains(polarisations(F.col(column)), wanted.upper())
    some = df.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("_some"))
    return df.crossJoin(F.broadcast(some)).where(hit | ~F.col("_some")).drop("_some")


def within_box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Footprints (w, s, e, n) that touch the box; unknown ones are kept."""
    touch = (F.col("w") <= east) & (F.col("e") >= west) & (F.col("s") <= north) & (F.col("n") >= south)
    return df.where(touch | F.col("w").isNull())


def searched(
    df: DataFrame, box: tuple[float, float, float, float] | None = None, first: str | None = None, last: str | None = None, direction: str = "auto",
    channel: str | None = None, track: int | None = None, platforms: Sequence[str] = (), level: str | None = None, mode: str | None = None,
) -> DataFrame:
    """Scenes that a query asks for; what it leaves open does not narrow it.

    Every condition compares a column with a value, so they reach the scan;
    only the channel's fallback to all rows needs an aggregate first.  Days
    are inclusive.  Columns: w, s, e, n, day, direction, pol, track, platform,
    level, mode.
    """
    out = df if box is None else within_box(df, *box)
    for name, ok in (("day", first and F.col("day") >= F.lit(first).cast("date")), ("day", last and F.col("day") <= F.lit(last).cast("date")), ("track", track is not None and F.col("track") == track), ("level", level and F.col("level") == level), ("mode", mode and F.col("mode") == mode)):
        if isinstance(ok, Column):
            out = out.where(ok & F.col(name).isNotNull())
    if platforms:
        out = out.where(F.col("platform").isin(*platforms))
    out = by_direction(out, direction)
    return out if channel is None else by_polarisation(out, channel)


def best_level(df: DataFrame, keys: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """The rows of the first level, in the order given, that each query has any of; ``rank`` tells which, above 0 a fallback."""
    rank = F.coalesce(*[F.when(F.col("level") == v, F.lit(k)) for k, v in enumerate(levels)])
    ranked = df.withColumn("rank", rank).where(F.col("rank").isNotNull())
    return ranked.join(ranked.groupBy(*keys).agg(F.min("rank").alias("rank")), [*keys, "rank"], "left_semi")


def fallback_findings(asked: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., severity, detail): a WARN for queries met by a level that is not the first, a FAIL for those that nothing meets."""
    met = asked.select(*keys).distinct().join(chosen.groupBy(*keys).agg(F.min("rank").alias("rank"), F.min("level").alias("level")), list(keys), "left")
    return met.where("rank is null or rank > 0").select(*keys, F.when(F.col("rank").isNull(), "FAIL").otherwise("WARN").alias("severity"), F.coalesce("level", F.lit("none")).alias("detail"))


def in_polygon(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Ray casting against a closed ring of a few vertices."""
    inside = F.lit(False)
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y0 != y1:
            crosses = (F.lit(y0) > y) != (F.lit(y1) > y)
            inside = inside != (crosses & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0))
    return inside


#: Moments or orbit files, counted, that are few enough to be broadcast.
FEW = 1 << 18


def choose_orbits(records: DataFrame, orbits: DataFrame, rank: dict[str, int], width: float = 86400.0) -> DataFrame:
    """(id, orbit), one row an id: of the orbit files of its records' missions valid at their times, the best kind, then the newest, then the last name; null where none is.

    ``records``: id, mission, t; ``orbits``: mission, kind, start, stop, created, name.

    Of files with the same validity only the best stays, and records meet
    files by their distinct moments.  Moments and files of one mission and
    bucket of ``width`` are swept in order of time with a heap of the files
    now valid, so no record is paired with every file that is valid.
    """
    kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in rank.items()], F.lit(len(rank)))
    spans = orbits.select("mission", F.col("start").cast("double").alias("at"), F.col("stop").cast("double").alias("stop"), F.struct((-kind).alias("kind"), "created", "name").alias("file"))
    spans = cut(spans.where("mission is not null and at <= stop").groupBy("mission", "at", "stop").agg(F.max("file").alias("file")))
    spans = numbered(spans, ["file", "mission", "at", "stop"], "place").select("mission", "at", "stop", "place", F.col("file.name").alias("orbit"))
    spans = cut(spans)
    moments = records.select("mission", F.col("t").cast("double").alias("at")).where("mission is not null and at is not null").distinct()
    bucket = lambda c: F.floor(F.col(c) / width)
    inside = spans.select("mission", F.explode(F.sequence(bucket("at"), bucket("stop"))).alias("_bucket"), "at", "stop", "place")
    asked = moments.select("mission", bucket("at").alias("_bucket"), "at", F.lit(None).cast("double").alias("stop"), F.lit(None).cast("long").alias("place"))
    keys = ["mission", "_bucket"]
    both = inside.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "at", F.col("stop").isNull())
    best = cut(both.mapInArrow(_swept, StructType([*moments.schema.fields, StructField("place", LongType())])))
    few = lambda df: F.broadcast(df) if df.count() <= FEW else df
    found = records.select("id", "mission", F.col("t").cast("double").alias("at")).join(few(best), ["mission", "at"], "left")
    chosen = found.groupBy("id").agg(F.max(F.when(F.col("id").isNotNull(), F.col("place"))).alias("place"))
    return chosen.join(few(spans.select("place", "orbit")), "place", "left").select("id", "orbit")


def _swept(batches):
    """(mission, at, place): the largest place of the spans that hold each moment; rows come by mission, bucket and time, spans before moments."""
    import pyarrow as pa

    own, heap = None, []
    for batch in batches:
        out = []
        for i, (mission, bucket, at, stop, place) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if (mission, bucket) != own:
                own, heap = (mission, bucket), []
            if stop is not None:
                if not heap or -heap[0][0] < place or heap[0][1] < stop:  # else one that is better holds as long
                    heapq.heappush(heap, (-place, stop))
                continue
            while heap and heap[0][1] < at:
                heapq.heappop(heap)
            if heap:
                out.append((i, -heap[0][0]))
        rows = batch.take(pa.array([i for i, _ in out], pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([p for _, p in out], pa.int64())], ["mission", "at", "place"])


def matched(records: DataFrame, other: DataFrame, exact: Sequence[str], loose: Sequence[str], value: str) -> DataFrame:
    """records with ``value`` by the exact key, or else the smallest by the loose one."""
    a = other.groupBy(*exact).agg(F.min(value).alias("_a"))
    b = other.groupBy(*loose).agg(F.min(value).alias("_b"))
    out = records.join(a, list(exact), "left").join(b, list(loose), "left")
    return out.withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def complete_pairs(pairs: DataFrame, granules: DataFrame, bursts: DataFrame) -> DataFrame:
    """Pairs with how many bursts have a granule on both dates, and whether all have."""
    need = pairs.join(bursts, "stack")
    one = granules.select("stack", F.col("date").alias("ref"), "burst", F.lit(True).alias("_r")).distinct()
    two = granules.select("stack", F.col("date").alias("sec"), "burst", F.lit(True).alias("_s")).distinct()
    both = need.join(one, ["stack", "ref", "burst"], "left").join(two, ["stack", "sec", "burst"], "left")
    ok = F.col("_r").isNotNull() & F.col("_s").isNotNull()
    return both.groupBy("stack", "ref", "sec").agg(F.count_if(ok).alias("n_bursts"), F.bool_and(ok).alias("complete"))


def common_extent(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intersection of extents; null where they don't meet."""
    out = df.groupBy(*keys).agg(F.max("w").alias("w"), F.max("s").alias("s"), F.min("e").alias("e"), F.min("n").alias("n"))
    ok = (F.col("w") < F.col("e")) & (F.col("s") < F.col("n"))
    return out.select(*keys, *[F.when(ok, F.col(c)).alias(c) for c in ("w", "s", "e", "n")])


def box_coverage(boxes: DataFrame, keys: Sequence[str], west: float, south: float, east: float, north: float) -> DataFrame:
    """(keys..., coverage): share of the area that axis-parallel footprints cover together.

    A sweep: between neighbouring edges in x the covered length in y is that
    of a union of intervals, found by a running maximum.
    """
    b = boxes.select(*keys, *[f(F.col(c).cast("double"), F.lit(float(v))).alias(c) for c, v, f in (("w", west, F.greatest), ("s", south, F.greatest), ("e", east, F.least), ("n", north, F.least))]).where("w < e and s < n")
    edges = b.select(*keys, F.explode(F.array("w", "e")).alias("x")).distinct()
    slabs = edges.withColumn("x1", F.lead("x").over(Window.partitionBy(*keys).orderBy("x"))).where("x1 is not null")
    inside = slabs.join(b, list(keys)).where("w <= x and e >= x1").select(*keys, "x", "x1", "s", "n").distinct()
    before = Window.partitionBy(*keys, "x").orderBy("s", "n").rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.max("n").over(before), F.col("s"))
    part = F.greatest(F.col("n") - F.greatest(F.col("s"), top), F.lit(0.0)) * (F.col("x1") - F.col("x"))
    area = inside.withColumn("_part", part).groupBy(*keys).agg((F.sum("_part") / ((east - west) * (north - south))).alias("coverage"))
    return boxes.select(*keys).distinct().join(area, list(keys), "left").select(*keys, F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node): everything downstream of the start nodes, breadth first until the front is empty; ``edges``: a, b."""
    edges = cut(edges.select("a", "b").distinct())
    found = front = cut(start.select("node").distinct())
    while front.limit(1).count():
        step = edges.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        front = cut(step.join(found, "node", "left_anti"))
        found = cut(found.unionByName(front))
    return found
