"""Time series and ground truth: velocities, comparison, references, point series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.dates import YEAR_DAYS
from .stats import finite


def velocity(y: Column, days: Column) -> Column:
    """Least-squares slope per year; null for fewer than two values or one date."""
    return F.regr_slope(y, days / YEAR_DAYS)


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null for fewer than three pairs or no spread."""
    spread = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when((F.count(x) >= 3) & spread, F.corr(x, y))


def point_series(pixels: DataFrame, near: DataFrame, site: str, pixel: str, method: str = "mean") -> DataFrame:
    """(site, date, value, n): mean or median over the pixels near each site; pixels without any value don't count.

    ``pixels``: pixel, date, disp; ``near``: site, pixel, distance_m.
    """
    known = pixels.withColumn("disp", finite(F.col("disp").cast("double"))).where("disp is not null")
    joined = known.join(near, pixel)
    n = joined.groupBy(site).agg(F.count_distinct(pixel).alias("n_pixels"), F.min("distance_m").alias("distance_m"))
    value = F.avg("disp") if method == "mean" else F.median("disp")
    return joined.groupBy(site, "date").agg(value.alias("value")).join(n, site)


def compare(samples: DataFrame, site: str) -> tuple[DataFrame, DataFrame]:
    """Per site, and pooled: errors of one series against another, both from their first common date on.

    ``samples``: site, date, series, truth; rows with a null are left out, and
    sites with fewer than two.  The pooled figures leave out each site's first
    sample, zero by construction.
    """
    known = samples.where("series is not null and truth is not null")
    w = Window.partitionBy(site)
    first = w.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = known.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 2").withColumn("_rn", F.row_number().over(w.orderBy("date")))
    k = k.withColumn("s", F.col("series") - F.first("series").over(first)).withColumn("t", F.col("truth") - F.first("truth").over(first))
    k = k.withColumn("d", F.col("s") - F.col("t")).withColumn("days", F.datediff("date", F.first("date").over(first)).cast("double"))
    per_site = k.groupBy(site).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.avg("d").alias("bias"), pearson(F.col("s"), F.col("t")).alias("corr"),
        velocity(F.col("s"), F.col("days")).alias("velocity"), velocity(F.col("t"), F.col("days")).alias("truth_velocity"),
    )
    pooled = k.where("_rn > 1").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.avg("d").alias("bias"), F.count(F.lit(1)).alias("n_points"), F.count_distinct(site).alias("n_sites"))
    return per_site, pooled


def referenced(series: DataFrame, keys: Sequence[str], is_reference: Column, value: str) -> DataFrame:
    """The series less, at each date, the value of the reference pixel, the smallest where there are several."""
    ref = series.where(is_reference).groupBy(*keys).agg(F.min(value).alias("_ref"))
    return series.join(ref, list(keys)).withColumn(value, F.col(value) - F.col("_ref")).drop("_ref")


def reference_scores(px: DataFrame, weights: dict[str, float]) -> DataFrame:
    """px with a score in [0, 1]: coherence, component, elevation, distance and velocity, weights shared among those known.

    ``px``: coherence, conncomp, dem, lat, lon, velocity.  Needs the median
    height, the centre, the scales; each is one row joined back.
    """
    from ..functions.phase import haversine_m

    base = px.agg(F.median("dem").alias("_h"), F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"), F.percentile(F.abs("velocity"), F.lit(0.95)).alias("_v"), F.max(F.abs("velocity")).alias("_vmax"))
    label = px.where("conncomp > 0").groupBy("conncomp").count().agg(F.max_by("conncomp", F.struct(F.col("count"), -F.col("conncomp"))).alias("_major"))
    one = px.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(label))
    one = one.withColumn("_dev", F.abs(F.col("dem") - F.col("_h"))).withColumn("_dist", haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
    scale = one.agg(F.max("_dev").alias("_devmax"), F.max("_dist").alias("_distmax"))
    one = one.crossJoin(F.broadcast(scale))
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    falling = lambda x, most: F.when(most > 0, clip(1 - x / most)).otherwise(F.when(x.isNotNull(), F.lit(1.0)))
    v = F.when(F.col("_v") > 0, F.col("_v")).otherwise(F.col("_vmax"))
    parts = {
        "coherence": clip(F.col("coherence")), "conncomp": F.when(F.col("_major").isNotNull(), (F.col("conncomp") == F.col("_major")).cast("double")),
        "elevation": falling(F.col("_dev"), F.col("_devmax")), "distance": falling(F.col("_dist"), F.col("_distmax")), "velocity": falling(F.abs("velocity"), v),
    }
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, part in parts.items():
        total = total + F.coalesce(part, F.lit(0.0)) * weights[name]
        weight = weight + F.when(part.isNotNull(), F.lit(weights[name])).otherwise(F.lit(0.0))
    return one.select(*px.columns, (total / weight).alias("score"))


def top_separated(px: DataFrame, k: int, separation: int) -> DataFrame:
    """The k best of (row, col, score), none closer than ``separation`` rows or columns to a better one.

    Every point taken rules out at most (2 * separation - 1) ** 2 others, so
    the best k times that many hold the answer: a bounded sort, then a scan.
    """
    enough = k * (2 * separation - 1) ** 2
    rows = px.where("score is not null").select("row", "col", "score").orderBy(F.desc("score"), "row", "col").limit(enough).collect()
    taken = []
    for r in rows:
        if len(taken) < k and all(max(abs(r.row - t.row), abs(r.col - t.col)) >= separation for t in taken):
            taken.append(r)
    out = [(n + 1, int(r.row), int(r.col), float(r.score)) for n, r in enumerate(taken)]
    return px.sparkSession.createDataFrame(out, "place long, row long, col long, score double")
