"""Pixel grids: embeddings as 8 x 8 patches, parts as one grid of fifty columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.phase import TWO_PI, wrap
from ..operators import grids, stats
from .registry import plan, table

PATCH = """patch as (select vec_id as layer, (i - 1) // 8 as row, (i - 1) % 8 as col, cast(embedding[i] as double) as v from embeddings, (select unnest(generate_series(1, 64)) as i))"""
GRID = "grid as (select p_partkey // 50 as row, p_partkey % 50 as col, p_retailprice / 10 + p_size as v, p_size as size from part)"


def patches(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("layer"), F.posexplode("embedding").alias("i", "v"))
    return e.select("layer", F.floor(F.col("i") / 8).alias("row"), (F.col("i") % 8).cast("long").alias("col"), F.col("v").cast("double").alias("v"))


def part_grid(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / 50).alias("row"), (k % 50).alias("col"), (F.col("p_retailprice") / 10 + F.col("p_size")).alias("v"), F.col("p_size").alias("size"))


def _box(expr: str, name: str) -> str:
    return f"sum({expr}) over (partition by layer, col order by row rows between {{b}} preceding and {{a}} following) as {name}"


@plan(f"""with {PATCH}, m as (select *, case when v > 0.35 then null else v end as x from patch),
  h as (select layer, row, col, sum(coalesce(x, 0)) over w as s, sum((x is null)::int) over w as b, sum(1) over w as n from m window w as (partition by layer, row order by col rows between 1 preceding and 1 following)),
  f as (select layer, row, col, sum(s) over w as s, sum(b) over w as b, sum(n) over w as n from h window w as (partition by layer, col order by row rows between 2 preceding and 1 following))
  select layer, row, col, round(case when b = 0 then s end, 8) as box_sum, round(case when b = 0 then s / n end, 8) as box_mean from f""")
def moving_window(spark, sf_dir):
    """Sums and means over 4 rows by 3 columns; values over 0.35 are missing."""
    p = patches(spark, sf_dir).withColumn("v", F.when(F.col("v") <= 0.35, F.col("v")).otherwise(float("nan")))
    return grids.box_filter(p, ["layer"], "v", 4, 3).withColumns({c: F.round(c, 8) for c in ("box_sum", "box_mean")})


@plan(f"""with {PATCH}, c as (select layer, row, col, v as a, v * 2 - 0.1 as b, lead(v, 1, 0.05) over (partition by layer order by row, col) as c, v + 0.01 as d from patch),
  h as (select layer, row, col, sum(a * c + b * d) over w as re, sum(b * c - a * d) over w as im, sum(a * a + b * b) over w as p, sum(c * c + d * d) over w as q from c window w as (partition by layer, row order by col rows between 1 preceding and 1 following)),
  f as (select layer, row, col, sum(re) over w as re, sum(im) over w as im, sum(p) over w as p, sum(q) over w as q from h window w as (partition by layer, col order by row rows between 1 preceding and 1 following))
  select layer, row, col, round(case when sqrt(p * q) > 0 then least(sqrt(re * re + im * im) / sqrt(p * q), 1) else 0 end, 8) as coherence from f""")
def moving_coherence(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("layer").orderBy("row", "col")
    p = patches(spark, sf_dir).select("layer", "row", "col", F.col("v").alias("a"), (F.col("v") * 2 - 0.1).alias("b"), F.lead("v", 1, 0.05).over(w).alias("c"), (F.col("v") + 0.01).alias("d"))
    return grids.coherence(p, ["layer"], "a", "b", "c", "d", 3, 3).withColumn("coherence", F.round("coherence", 8))


@plan(f"""with {PATCH}, s as (select layer, lead(v) over (partition by layer, row order by col) - v as x, lead(v) over (partition by layer, col order by row) - v as y from (select layer, row, col, v * 20 as v from patch)),
  u as (select layer, x as d from s where x is not null union all select layer, y from s where y is not null)
  select layer, round(avg(abs(atan2(sin(d), cos(d)))) / pi(), 8) as density from u group by 1""")
def fringe_density(spark, sf_dir):
    return grids.fringe_density(patches(spark, sf_dir).withColumn("v", F.col("v") * 20), ["layer"], "v").withColumn("density", F.round("density", 8))


@plan(f"""with {GRID}, g as (select row, col, lag(v) over x as xb, lead(v) over x as xa, lag(v) over y as yb, lead(v) over y as ya, v from grid window x as (partition by row order by col), y as (partition by col order by row)),
  d as (select row, col, case when xb is null then (xa - v) / 30 when xa is null then (v - xb) / 30 else (xa - xb) / 60 end as gx,
    case when yb is null then (ya - v) / -30 when ya is null then (v - yb) / -30 else (ya - yb) / -60 end as gy from g),
  s as (select *, degrees(atan(sqrt(gx * gx + gy * gy))) as slope, degrees(atan2(-gx, -gy)) as a from d)
  select row, col, round(slope, 5) as slope, round(case when slope = 0 then 0 when a < 0 then a + 360 else a end, 4) as aspect from s""")
def slope_and_aspect(spark, sf_dir):
    g = part_grid(spark, sf_dir).withColumn("layer", F.lit(0))
    return grids.slope_aspect(g, ["layer"], "v", 30.0, 30.0).select("row", "col", F.round("slope", 5).alias("slope"), F.round("aspect", 4).alias("aspect"))


@plan(f"""with {PATCH} select layer, row // 3 as block_row, col // 3 as block_col, round(avg(cos(v * 20)), 8) as re, round(avg(sin(v * 20)), 8) as im, round(avg(v * v), 8) as power,
  round(atan2(sum(abs(v) * sin(v * 20)), sum(abs(v) * cos(v * 20))), 6) as weighted_phase from patch where row < 6 and col < 6 group by 1, 2, 3""")
def multilook(spark, sf_dir):
    """Blocks of three by three: complex mean, power, coherence-weighted phase; the last two rows and columns are cropped."""
    v = F.col("v")
    values = {
        "re": F.avg(F.cos(v * 20)), "im": F.avg(F.sin(v * 20)), "power": F.avg(v * v), "weighted_phase": F.atan2(F.sum(F.abs(v) * F.sin(v * 20)), F.sum(F.abs(v) * F.cos(v * 20))),
    }
    out = grids.multilook(patches(spark, sf_dir), ["layer"], 3, 3, F.lit(8), F.lit(8), values)
    return out.withColumns({c: F.round(c, 6 if c == "weighted_phase" else 8) for c in values})


@plan(f"""with {PATCH}, b as (select layer, row // 3 as br, col // 3 as bc, avg(v) as m from patch where row < 6 and col < 6 group by 1, 2, 3)
  select p.layer, p.row, p.col, round(v - m, 8) as residual from patch p join b on b.layer = p.layer and br = least(row // 3, 1) and bc = least(col // 3, 1)""")
def upsampled_residual(spark, sf_dir):
    p = patches(spark, sf_dir)
    coarse = grids.multilook(p, ["layer"], 3, 3, F.lit(8), F.lit(8), {"m": F.avg("v")})
    return grids.upsample(coarse, p, ["layer"], 3, 2, 2).select("layer", "row", "col", F.round(F.col("v") - F.col("m"), 8).alias("residual"))


@plan()
def adaptive_filter(spark, sf_dir):
    p = patches(spark, sf_dir).select("layer", "row", "col", F.cos(F.col("v") * 20).alias("re"), F.sin(F.col("v") * 20).alias("im"))
    return grids.adaptive_filter(p, ["layer"], "re", "im", size=4).withColumns({c: F.round(c, 6) for c in ("re", "im")})


def extent(spark, sf_dir):
    top = part_grid(spark, sf_dir).agg(F.max("row")).first()[0]
    return int(top) + 1


ROWS, COLS, OVERLAP = 2, 3, 1

TILES = f"""dims as (select max(p_partkey // 50) + 1 as ny from part), axis as (
    select 'y' as ax, i, ny as n, {ROWS} as k from dims, (select unnest(generate_series(0, {ROWS - 1})) as i) union all select 'x', i, 50, {COLS} from (select unnest(generate_series(0, {COLS - 1})) as i)),
  parts as (select ax, i, cast(round_even(i * n / k, 0) as bigint) as c0, cast(round_even((i + 1) * n / k, 0) as bigint) as c1, n, k from axis),
  ext as (select ax, i, c0, c1, greatest(0, c0 - case when i > 0 then {OVERLAP // 2} else 0 end) as e0, least(n, c1 + case when i < k - 1 then {OVERLAP - OVERLAP // 2} else 0 end) as e1 from parts),
  tiles as (select y.i * {COLS} + x.i as tile, y.i as trow, x.i as tcol, y.e0 as ey0, y.e1 as ey1, x.e0 as ex0, x.e1 as ex1, y.c0 as cy0, y.c1 as cy1, x.c0 as cx0, x.c1 as cx1
    from ext y, ext x where y.ax = 'y' and x.ax = 'x')"""
TILED = f"""{GRID}, {TILES}, tiled as (select t.*, g.row, g.col, g.v + 2 * pi() * (t.tile % 2) as v, g.size, g.row >= cy0 and g.row < cy1 and g.col >= cx0 and g.col < cx1 as core
    from grid g join tiles t on g.row >= ey0 and g.row < ey1 and g.col >= ex0 and g.col < ex1)"""


def tile_grid(spark, sf_dir):
    return grids.tiles(spark, extent(spark, sf_dir), 50, ROWS, COLS, OVERLAP)


def tiled(spark, sf_dir):
    t = grids.with_halo(part_grid(spark, sf_dir), tile_grid(spark, sf_dir))
    return t.withColumn("v", F.col("v") + TWO_PI * (F.col("tile") % 2))


@plan(f"with {TILES} select * from tiles")
def tile_partition(spark, sf_dir):
    return tile_grid(spark, sf_dir)


@plan(f"""with {TILED}, w as (select row, col, v, cast(least(row - ey0 + 1, ey1 - row) * least(col - ex0 + 1, ex1 - col) as double) as w from tiled)
  select row, col, round(sum(w * v) / sum(w), 6) as merged from w group by 1, 2""")
def feathered_merge(spark, sf_dir):
    return grids.feather_merge(tiled(spark, sf_dir), "v").withColumn("merged", F.round("merged", 6))


@plan(f"""with {TILED}, l as (select tile, row, col, size % 4 as label from tiled where core), k as (select distinct tile, label from l where label > 0), n as (select *, row_number() over (order by tile, label) as u from k)
  select l.tile, row, col, cast(l.label as int) as label, coalesce(u, 0) as unique_label from l left join n on n.tile = l.tile and n.label = l.label""")
def relabelled_tiles(spark, sf_dir):
    return grids.relabel(tiled(spark, sf_dir).withColumn("label", F.col("size") % 4), "label")


@plan(f"""with {TILED}, adj as (select a.tile as a, b.tile as b from tiles a join tiles b on (b.trow = a.trow + 1 and b.tcol = a.tcol) or (b.trow = a.trow and b.tcol = a.tcol + 1)),
  c as (select a, b, cast(round_even((x.v - y.v) / (2 * pi()), 0) as bigint) as cycle from adj join tiled x on x.tile = a join tiled y on y.tile = b and y.row = x.row and y.col = x.col),
  s as (select a, b, cycle, count(*) as n from c group by 1, 2, 3)
  select a, b, arg_max(cycle, (n, -abs(cycle), -cycle)) as mode, cast(sum(n) as double) as total from s group by 1, 2""")
def tile_offsets(spark, sf_dir):
    c = grids.overlap_cycles(tiled(spark, sf_dir), tile_grid(spark, sf_dir), "v")
    return stats.cycle_mode(c, ["a", "b"], "cycle").select("a", "b", "mode", "total")


@plan(f"""with {GRID}, {TILES}, m as (select row, col, v + 2 * pi() * ((row // 7 + col // 9) % 3) as v from grid), s as (select row, col, v - lag(v) over (partition by col order by row) as up, v - lag(v) over (partition by row order by col) as le from m),
  o as (select s.*, t.* from s join tiles t on s.row >= cy0 and s.row < cy1 and s.col >= cx0 and s.col < cx1)
  select axis, a, b, cast(round_even(d / (2 * pi()), 0) as bigint) as cycle, count(*) as n from (
    select 'row' as axis, tile - {COLS} as a, tile as b, up as d from o where trow > 0 and row = cy0 union all select 'col', tile - 1, tile, le from o where tcol > 0 and col = cx0) group by 1, 2, 3, 4""")
def seam_cycles(spark, sf_dir):
    m = part_grid(spark, sf_dir).withColumn("v", F.col("v") + TWO_PI * ((F.floor(F.col("row") / 7) + F.floor(F.col("col") / 9)) % 3))
    c = grids.seam_cycles(m, tile_grid(spark, sf_dir), "v")
    return c.groupBy("axis", "a", "b", "cycle").agg(F.count(F.lit(1)).alias("n"))


@plan(f"""with {TILED}, r as (select row // 4 as br, col // 4 as bc, avg(v) as ref from grid group by 1, 2), o as (select tile, cast(round_even(avg(v - ref) / (2 * pi()), 0) as bigint) as k from tiled join r on br = row // 4 and bc = col // 4 group by 1)
  select tile, k as cycles from o""")
def reference_offsets(spark, sf_dir):
    """Whole cycles of each tile against a coarse reference of the untiled grid."""
    ref = part_grid(spark, sf_dir).groupBy(F.floor(F.col("row") / 4).alias("br"), F.floor(F.col("col") / 4).alias("bc")).agg(F.avg("v").alias("ref"))
    t = tiled(spark, sf_dir).withColumn("br", F.floor(F.col("row") / 4)).withColumn("bc", F.floor(F.col("col") / 4)).join(ref, ["br", "bc"])
    return t.groupBy("tile").agg(F.rint(F.avg(F.col("v") - F.col("ref")) / TWO_PI).cast("long").alias("cycles"))


@plan(f"""with {GRID}, g as (select row, col, 0.05 * exp(-(pow(row - 20, 2) + pow(col - 25, 2)) / (2 * 36)) + 0.001 * row as d from grid) select row, col, round(d, 9) as displacement, round(atan2(sin(-4 * pi() / 0.0555 * d), cos(-4 * pi() / 0.0555 * d)), 6) as phase from g""")
def synthetic_deformation(spark, sf_dir):
    """A Gaussian bowl and a ramp in metres, and its wrapped phase."""
    import math

    r, c = F.col("row"), F.col("col")
    d = 0.05 * F.exp(-(F.pow(r - 20, 2) + F.pow(c - 25, 2)) / (2 * 36.0)) + 0.001 * r
    g = part_grid(spark, sf_dir).select("row", "col", d.alias("d"))
    return g.select("row", "col", F.round("d", 9).alias("displacement"), F.round(wrap(-4 * math.pi / 0.0555 * F.col("d")), 6).alias("phase"))


@plan(f"""with {PATCH}, k as (select layer, count(*) filter (abs(v) < 0.02) as masked, count(*) as n, sum(case when abs(v) < 0.02 then 0 else least(greatest(abs(v), 0), 1) end) as c from patch group by 1)
  select layer, round(masked / n, 6) as masked_fraction, round(c, 6) as coherence_left from k""")
def coherence_mask(spark, sf_dir):
    """Share masked below a threshold, and the coherence left, clipped to [0, 1]."""
    v = F.abs("v")
    bad = F.isnan(v) | (v < 0.02)
    left = F.when(bad, F.lit(0.0)).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
    return patches(spark, sf_dir).groupBy("layer").agg(F.round(F.avg(bad.cast("double")), 6).alias("masked_fraction"), F.round(F.sum(left), 6).alias("coherence_left"))
