"""Synthetic scenes and kernels: a nation is a layer, an embedding a patch of eight by eight."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels
from ..sources import synthetic as sy
from .grid_plans import patches
from .registry import plan, table

NY, NX = 10, 12
_GRID = f"grid as (select n_nationkey as layer, r.n as row, c.n as col from nation, (select unnest(generate_series(0, {NY - 1})) as n) r, (select unnest(generate_series(0, {NX - 1})) as n) c)"


def scene(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("layer"))
    rows, cols = (F.explode(F.array(*[F.lit(k).cast("long") for k in range(m)])) for m in (NY, NX))
    return n.withColumn("row", rows).withColumn("col", cols)


@plan(f"""with {_GRID}, d as (select *, (100.0 + layer * 20) * exp(-pow(col - 5.5, 2) / (2 * 1.5 * 1.5)) as dem from grid),
  g as (select *, lag(dem) over w as b, lead(dem) over w as a from d window w as (partition by layer, row order by col))
  select layer, row, col, col < 2 as water, round(dem, 6) as dem, degrees(atan(case when b is null then a - dem when a is null then dem - b else (a - b) / 2 end / 20)) > 39 as layover,
    cast((col >= 6)::int + 2 * (row >= 5)::int as int) as quadrant, cast((col >= 3)::int + (col >= 6)::int + (col >= 9)::int as int) as stripe from g""")
def synthetic_masks(spark, sf_dir):
    row, col = F.col("row"), F.col("col")
    d = scene(spark, sf_dir).withColumn("dem", sy.ridge(col, NX, 1.0, 1.5, 5.5) * (100.0 + F.col("layer") * 20))
    d = sy.layover(d, "dem", 20.0, 39.0)
    return d.select("layer", "row", "col", sy.water(col, NX, 0.15).alias("water"), F.round("dem", 6).alias("dem"), "layover", sy.region(row, col, NY, NX, "quadrants").alias("quadrant"), sy.region(row, col, NY, NX, "stripes").alias("stripe"))


_U = lambda a, b, c: f"(((layer * {a} + row * {b} + col * {c}) % 997) / 997.0::double)"


@plan(f"""with {_GRID}, c as (select *, {_U(7, 31, 17)} as u, {_U(13, 5, 29)} as v, 0.8 as base, exp(-(pow(row - 3, 2) + pow(col - 4, 2)) / (2 * 2.0 * 2.0)) as w from grid),
  n as (select *, sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v) as z from c),
  k as (select *, least(greatest(0.8 * (1 - w) + 0.15 * w + 0.03 * z, 0.01), 0.999) as coh, (row - 4) * 0.9 + layer * 0.1 as truth from n),
  s as (select *, z * least(sqrt((1 - coh * coh) / (2.0 * 4 * coh * coh)), pi() / sqrt(3)) as noise from k)
  select layer, row, col, round(case when col < 2 then 0 else coh end, 6)::double as coh, round(case when col >= 2 then atan2(sin(truth + noise), cos(truth + noise)) end, 6) as wrapped, round((1 + col // 6 * 2) * sqrt(-2 * ln(1 - v)), 6) as amplitude from s""")
def synthetic_interferograms(spark, sf_dir):
    u = lambda a, b, c: ((F.col("layer") * a + F.col("row") * b + F.col("col") * c) % 997) / 997.0
    row, col = F.col("row"), F.col("col")
    z = sy.normal(u(7, 31, 17), u(13, 5, 29))
    px = scene(spark, sf_dir).withColumn("z", z).withColumn("c", sy.coherence(row, col, [(3, 4, 2.0)], jitter=F.col("z"))).withColumn("truth", (row - 4) * 0.9 + F.col("layer") * 0.1)
    px = px.withColumn("mask", sy.water(col, NX, 0.15))
    out = sy.interferogram(px, "truth", "c", "mask", F.col("z"), looks=4)
    amp = sy.rayleigh(1.0 + 2 * sy.region(row, col, NY, NX, "halves"), u(13, 5, 29))
    return out.select("layer", "row", "col", F.round("coh", 6).alias("coh"), F.round("wrapped", 6).alias("wrapped"), F.round(amp, 6).alias("amplitude"))


@plan("""with t as (select vec_id as scene, i.n as tile, cast(floor(((vec_id * 7 + i.n * 3) % 11) / 11.0 * 7) as bigint) - 3 as truth, case when vec_id % 3 = 0 and i.n = 2 then 1 else 0 end as slip from embeddings, (select unnest(generate_series(0, 3)) as n) i),
  r as (select scene, truth - first_value(truth) over (partition by scene order by tile) + slip - first_value(slip) over (partition by scene order by tile) as found, truth - first_value(truth) over (partition by scene order by tile) as rel from t)
  select scene, bool_and(found = rel) as exact, count(*) filter (found <> rel) as n_wrong, max(abs(found - rel)) as max_error from r group by 1""")
def offset_recovery(spark, sf_dir):
    """Whole cycles put into tiles, found again with a slip in some."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("tile"))
    t = sy.with_cycles(t.withColumn("v", F.lit(0.0)), "v", ((F.col("scene") * 7 + F.col("tile") * 3) % 11) / 11.0, 3)
    t = t.withColumn("truth", F.col("cycles")).withColumn("found", F.rint(F.col("v") / 6.283185307179586).cast("long") + 5 + F.when((F.col("scene") % 3 == 0) & (F.col("tile") == 2), 1).otherwise(0))
    return kernels.offsets_recovered(t, "scene")


@plan("""with e as (select vec_id as layer, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), p as (select layer, i // 8 as row, i % 8 as col, v * 40 as v from e),
  j as (select a.layer, s.seam, cast(round_even((a.v - b.v) / (2 * pi()), 0) as bigint) as jump from (select unnest([3, 6]) as seam) s join p a on a.col = s.seam join p b on b.layer = a.layer and b.row = a.row and b.col = s.seam - 1),
  n as (select layer, seam, jump, count(*) as n from j group by 1, 2, 3)
  select layer, cast(seam as int) as seam, arg_min(jump, (-n, abs(jump), jump)) as jump, max(n) as n, max(n) / sum(n) as share from n group by 1, 2""")
def seam_jumps(spark, sf_dir):
    return kernels.seam_jumps(patches(spark, sf_dir).withColumn("v", F.col("v") * 40), ["layer"], "v", "col", [3, 6])


@plan("""with e as (select vec_id // 8 as scene, vec_id % 8 as date, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), p as (select scene, i // 8 as row, i % 8 as col, list(abs(v::double)) as amps, avg(v::double) as value from e group by 1, 2, 3),
  m as (select a.scene, a.row, a.col, a.amps as x, b.amps as y, b.value from p a join p b on b.scene = a.scene and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1),
  d as (select *, list_max(list_transform(list_concat(x, y), lambda v: abs(len(list_filter(x, lambda e: e <= v)) / len(x) - len(list_filter(y, lambda e: e <= v)) / len(y)))) as d from m)
  select scene, row, col, count(*) as n_shp, round(avg(value), 8) as mean from d where d <= 0.4 group by 1, 2, 3""")
def homogeneous_means(spark, sf_dir):
    """Pixels of a scene over eight dates: averaged with the neighbours whose amplitudes are distributed alike."""
    p = patches(spark, sf_dir).select(F.floor(F.col("layer") / 8).alias("scene"), "row", "col", "v")
    p = p.groupBy("scene", "row", "col").agg(F.collect_list(F.abs("v")).alias("amps"), F.avg("v").alias("value"))
    return kernels.homogeneous_means(p, ["scene"], 1, F.lit(0.4), "value").withColumn("mean", F.round("mean", 8))
