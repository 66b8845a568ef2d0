"""Time series, ground truth and aggregates over orders, lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.phase import EARTH_RADIUS_M, TWO_PI, wrap
from ..operators import joins, series, stats
from .registry import micros, plan, table

ERRORS = "errors as (select event_id, user_id, ts, epoch_us(ts) as t from events where event_type = 'error')"
VIEWS = "views as (select user_id, epoch_us(ts) as vt, max(value) as value from events where event_type = 'view' group by 1, 2)"
GAP = 6 * 3600 * 1_000_000


def errors(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", micros("ts").alias("t"))


def views(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id", micros("ts").alias("vt")).agg(F.max("value").alias("value"))


@plan(f"""with {ERRORS}, {VIEWS}, m as (select e.event_id, e.user_id, e.t, v.vt, v.value, row_number() over (partition by e.event_id order by abs(v.vt - e.t), v.vt) as n
      from errors e join views v on v.user_id = e.user_id and abs(v.vt - e.t) <= {GAP})
    select event_id, user_id, t, vt, value from m where n = 1""")
def asof_nearest(spark, sf_dir):
    return joins.asof_nearest(errors(spark, sf_dir), views(spark, sf_dir), ["user_id"], "t", "vt", GAP, "value", "event_id")


@plan(f"""with {ERRORS}, {VIEWS}, p as (select e.event_id, e.user_id, e.t, a.vt as t0, a.value as v0 from errors e asof join views a on a.user_id = e.user_id and a.vt <= e.t),
    q as (select p.*, b.vt as t1, b.value as v1 from p asof join views b on b.user_id = p.user_id and b.vt >= p.t)
    select event_id, user_id, t, round(case when t1 > t0 then (1 - (t - t0) / (t1 - t0)) * v0 + (t - t0) / (t1 - t0) * v1 else v0 end, 6) as value from q""")
def asof_interpolated(spark, sf_dir):
    return joins.asof_interpolated(errors(spark, sf_dir), views(spark, sf_dir), ["user_id"], "t", "vt", "value").withColumn("value", F.round("value", 6))


PLACES = """sites as (select s_suppkey as site, 35 + (s_suppkey * 7 % 40) * 0.001 + 0.0003 as lat, 128 + (s_suppkey * 11 % 50) * 0.001 + 0.0002 as lon from supplier),
  pixels as (select p_partkey as pixel, 35 + (p_partkey // 50) * 0.001 as lat, 128 + (p_partkey % 50) * 0.001 as lon from part)"""
HAVERSINE = f"2 * {EARTH_RADIUS_M} * asin(sqrt(least(greatest(pow(sin(radians(p.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - s.lon) / 2), 2), 0), 1)))"


def sites(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("site"), (35 + (k * 7 % 40) * 0.001 + 0.0003).alias("lat"), (128 + (k * 11 % 50) * 0.001 + 0.0002).alias("lon"))


def pixels(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("pixel"), (35 + F.floor(k / 50) * 0.001).alias("lat"), (128 + (k % 50) * 0.001).alias("lon"))


@plan(f"with {PLACES} select site, pixel, round({HAVERSINE}, 4) as distance_m from sites s, pixels p where {HAVERSINE} <= 150")
def radius_join(spark, sf_dir):
    return joins.radius_join(sites(spark, sf_dir), pixels(spark, sf_dir), 150.0).withColumn("distance_m", F.round("distance_m", 4))


@plan(f"""with {PLACES}, d as (select site, pixel, pow(p.lat - s.lat, 2) + pow(cos(radians(s.lat)) * (p.lon - s.lon), 2) as d2 from sites s, pixels p)
    select site, arg_min(pixel, (round(d2, 15), pixel)) as pixel, round(min(d2) * 1e6, 6) as d2 from d group by 1""")
def nearest_pixel(spark, sf_dir):
    return joins.nearest_planar(sites(spark, sf_dir), pixels(spark, sf_dir)).withColumn("d2", F.round(F.col("d2") * 1e6, 6))


LINES = """disp as (select l_partkey as pixel, cast(date_trunc('month', l_shipdate) as date) as date, avg(l_extendedprice) / 1000 as disp from lineitem group by 1, 2)"""


def displacement(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pixel"), F.to_date(F.trunc("l_shipdate", "month")).alias("date")).agg((F.avg("l_extendedprice") / 1000).alias("disp"))


@plan(f"""with {PLACES}, {LINES}, near as (select site, pixel, {HAVERSINE} as m from sites s, pixels p where {HAVERSINE} <= 150),
    j as (select * from disp join near using (pixel)), n as (select site, count(distinct pixel) as n_pixels from j group by 1)
    select site, strftime(date, '%Y-%m-%d') as date, round(avg(disp), 9) as value, n_pixels from j join n using (site) group by site, date, n_pixels""")
def site_series(spark, sf_dir):
    near = joins.radius_join(sites(spark, sf_dir), pixels(spark, sf_dir), 150.0)
    out = series.point_series(displacement(spark, sf_dir), near, "site", "pixel")
    return out.select("site", F.date_format("date", "yyyy-MM-dd").alias("date"), F.round("value", 9).alias("value"), "n_pixels")


@plan("""select l_partkey, round(regr_slope(l_extendedprice, datediff('day', date '1995-01-01', cast(l_shipdate as date)) / 365.25), 4) as velocity,
    case when count(*) >= 3 and stddev_pop(l_quantity) > 0 and stddev_pop(l_extendedprice) > 0 then round(corr(l_quantity, l_extendedprice), 6) end as corr from lineitem group by 1""")
def velocities(spark, sf_dir):
    days = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1995-01-01"))).cast("double")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.round(series.velocity(F.col("l_extendedprice"), days), 4).alias("velocity"), F.round(series.pearson(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("corr")
    )


COMPARED = """s as (select l_suppkey as site, cast(date_trunc('month', l_shipdate) as date) as date, avg(l_extendedprice) / 1000 as series, avg(l_quantity) as truth from lineitem group by 1, 2),
  n as (select *, count(*) over (partition by site) as cnt, row_number() over w as rn, first_value(series) over w as s0, first_value(truth) over w as t0, first_value(date) over w as d0 from s window w as (partition by site order by date)),
  k as (select site, rn, series - s0 as s, truth - t0 as t, (series - s0) - (truth - t0) as d, datediff('day', d0, date) / 365.25 as y from n where cnt >= 2)"""


def compared(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.to_date(F.trunc("l_shipdate", "month")).alias("date"))
    return series.compare(line.agg((F.avg("l_extendedprice") / 1000).alias("series"), F.avg("l_quantity").alias("truth")), "site")


@plan(f"""with {COMPARED} select site, count(*) as n, round(sqrt(avg(d * d)), 6) as rmse, round(avg(d), 6) as bias, round(corr(s, t), 6) as corr,
    round(regr_slope(s, y), 5) as velocity, round(regr_slope(t, y), 5) as truth_velocity from k group by 1""")
def site_comparison(spark, sf_dir):
    per_site, _ = compared(spark, sf_dir)
    return per_site.select("site", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "bias", "corr")], F.round("velocity", 5).alias("velocity"), F.round("truth_velocity", 5).alias("truth_velocity"))


@plan(f"with {COMPARED} select round(sqrt(avg(d * d)), 6) as rmse, round(avg(d), 6) as bias, count(*) as n_points, count(distinct site) as n_sites from k where rn > 1")
def pooled_comparison(spark, sf_dir):
    _, pooled = compared(spark, sf_dir)
    return pooled.withColumn("rmse", F.round("rmse", 6)).withColumn("bias", F.round("bias", 6))


@plan(f"""with {LINES}, r as (select date, disp as ref from disp where pixel = 7) select pixel, strftime(date, '%Y-%m-%d') as date, round(disp - ref, 6) as disp from disp join r using (date)""")
def referenced_series(spark, sf_dir):
    out = series.referenced(displacement(spark, sf_dir), ["date"], F.col("pixel") == 7, "disp")
    return out.select("pixel", F.date_format("date", "yyyy-MM-dd").alias("date"), F.round("disp", 6).alias("disp"))


CYCLES = "c as (select l_suppkey as boundary, cast(round_even((l_extendedprice / 1000 - l_quantity) / (2 * pi()), 0) as bigint) as k, l_tax as w from lineitem)"


def cycle_rows(spark, sf_dir):
    k = F.rint((F.col("l_extendedprice") / 1000 - F.col("l_quantity")) / TWO_PI).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("boundary"), k.alias("k"), F.col("l_tax").alias("w"))


@plan(f"""with {CYCLES}, s as (select boundary, k, count(*) as n from c group by 1, 2)
    select boundary, arg_max(k, (n, -abs(k), -k)) as mode, cast(max(n) as double) as weight, cast(sum(n) as double) as total, round(max(n) / sum(n), 6) as share from s group by 1""")
def cycle_mode(spark, sf_dir):
    return stats.cycle_mode(cycle_rows(spark, sf_dir), ["boundary"], "k").withColumn("share", F.round("share", 6))


@plan(f"""with {CYCLES}, s as (select boundary, k, round(sum(w), 6) as n from c group by 1, 2)
    select boundary, arg_max(k, (n, -abs(k), -k)) as mode, round(max(n), 4) as weight from s group by 1""")
def weighted_cycle_mode(spark, sf_dir):
    rows = cycle_rows(spark, sf_dir).groupBy("boundary", "k").agg(F.round(F.sum("w"), 6).alias("w"))
    return stats.cycle_mode(rows, ["boundary"], "k", F.col("w")).select("boundary", "mode", F.round("weight", 4).alias("weight"))


@plan("""with s as (select l_suppkey, l_extendedprice as v, sum(l_quantity) as w from lineitem group by 1, 2),
    r as (select *, sum(w) over (partition by l_suppkey order by v) as cum, sum(w) over (partition by l_suppkey) as total from s)
    select l_suppkey, min(v) as median, round(arg_min(w / total, v), 6) as share from r where cum >= total / 2 group by 1""")
def weighted_median(spark, sf_dir):
    out = stats.weighted_lower_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")
    return out.withColumn("share", F.round("share", 6))


@plan("""with n as (select c_nationkey, case when c_acctbal < 0 then 0 else c_custkey % 4 end as label from customer), s as (select c_nationkey, label, count(*) as c from n where label > 0 group by 1, 2)
    select n.c_nationkey, cast(coalesce(max(b), 0) as bigint) as label from (select distinct c_nationkey from n) n left join (select c_nationkey, arg_max(label, (c, -label)) as b from s group by 1) using (c_nationkey) group by 1""")
def majority_label(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_acctbal") < 0, 0).otherwise(F.col("c_custkey") % 4).alias("label"))
    return stats.majority_label(c, ["c_nationkey"], "label")


@plan("""with v as (select event_type, case when event_id % 13 = 0 then null else value end as x from events)
    select event_type, count(*) as n, round(count(*) filter (x is null) / count(*), 6) as nan_fraction, min(x) as min, max(x) as max, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std,
    round(quantile_cont(x, 0.05), 6) as p05, round(quantile_cont(x, 0.25), 6) as p25, round(quantile_cont(x, 0.5), 6) as p50, round(quantile_cont(x, 0.75), 6) as p75, round(quantile_cont(x, 0.95), 6) as p95 from v group by 1""")
def column_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("x", F.when(F.col("event_id") % 13 == 0, float("nan")).otherwise(F.col("value")))
    out = stats.column_stats(e, ["event_type"], "x")
    return out.withColumns({c: F.round(c, 6) for c in ("nan_fraction", "mean", "std", "p05", "p25", "p50", "p75", "p95")})


@plan("""select l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) as mean, round(coalesce(stddev_samp(l_extendedprice), 0), 4) as std, min(l_extendedprice) as min, max(l_extendedprice) as max,
    count(*) as n from lineitem group by 1, 2""")
def metric_summary(spark, sf_dir):
    return stats.metric_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice").withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@plan("""with r as (select min(value) as lo, max(value) as hi from events), b as (select least(29, cast(floor((value - lo) / ((hi - lo) / 30)) as bigint)) as bin, count(*) as n from events, r group by 1)
    select g.bin, coalesce(n, 0) as n from (select unnest(generate_series(0, 29)) as bin) g left join b using (bin)""")
def value_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "events"), "value", 30)


@plan("""with n as (select l_suppkey as stage, case when l_linenumber = 7 then null else l_quantity end as time_s, l_extendedprice as disk_gb, l_tax as rss_gb, case when l_suppkey % 5 = 0 then null else l_discount end as credits,
      case when l_suppkey % 3 = 0 then null else l_linenumber end as n_jobs from lineitem)
    select stage, sum(time_s) as time_s, round(sum(disk_gb), 2) as disk_gb, max(rss_gb) as rss_gb, round(sum(credits), 4) as credits, cast(coalesce(sum(n_jobs), 0) as bigint) as n_jobs from n group by 1""")
def resource_sums(spark, sf_dir):
    k = F.col("l_suppkey")
    n = table(spark, sf_dir, "lineitem").select(
        k.alias("stage"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("time_s"), F.col("l_extendedprice").alias("disk_gb"), F.col("l_tax").alias("rss_gb"),
        F.when(k % 5 != 0, F.col("l_discount")).alias("credits"), F.when(k % 3 != 0, F.col("l_linenumber")).alias("n_jobs"),
    )
    return stats.resources(n, ["stage"]).withColumn("disk_gb", F.round("disk_gb", 2)).withColumn("credits", F.round("credits", 4))


@plan("""with e as (select l_suppkey, l_extendedprice / 700 as e from lineitem), m as (select l_suppkey, atan2(avg(sin(e)), avg(cos(e))) as b from e group by 1),
    w as (select l_suppkey, b, atan2(sin(e), cos(e)) as x, atan2(sin(e - b), cos(e - b)) as y from e join m using (l_suppkey))
    select l_suppkey, round(sqrt(avg(x * x)), 6) as rmse, round(avg(abs(x)), 6) as mae, round(sqrt(avg(y * y)), 6) as rmse_unbiased, round(any_value(b), 6) as bias from w group by 1""")
def wrapped_errors(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 700).alias("e"))
    return stats.wrapped_errors(e, ["l_suppkey"], "e").withColumns({c: F.round(c, 6) for c in ("rmse", "mae", "rmse_unbiased", "bias")})


@plan("""with m as (select l_suppkey, median(l_quantity) as med from lineitem group by 1)
    select l_suppkey, round(avg(case when abs(l_quantity - med) >= pi() then 1.0 else 0.0 end), 6) as fraction from lineitem join m using (l_suppkey) group by 1""")
def unwrap_error_fraction(spark, sf_dir):
    return stats.unwrap_error_fraction(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity").withColumn("fraction", F.round("fraction", 6))


@plan("""select p_partkey from part a where not exists (select 1 from part b where b.p_type = a.p_type and b.p_size <= a.p_size and b.p_retailprice <= a.p_retailprice and (b.p_size < a.p_size or b.p_retailprice < a.p_retailprice))""")
def skyline_of_two(spark, sf_dir):
    return stats.skyline(table(spark, sf_dir, "part"), ["p_type"], "p_partkey", ["p_size", "p_retailprice"]).select("p_partkey")


@plan("""with s as (select l_suppkey as k, round(avg(l_quantity), 6) as q, round(avg(l_discount), 8) as d, round(avg(l_tax), 8) as t from lineitem group by 1)
    select k, q, d, t from s a where not exists (select 1 from s b where b.q <= a.q and b.d >= a.d and b.t <= a.t and (b.q < a.q or b.d > a.d or b.t < a.t))""")
def skyline_of_three(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_quantity"), 6).alias("q"), F.round(F.avg("l_discount"), 8).alias("d"), F.round(F.avg("l_tax"), 8).alias("t"))
    return stats.skyline(s, [], "k", ["q", "t"], ["d"])


PX = """px as (select p_partkey // 50 as row, p_partkey % 50 as col, (p_partkey * 37 % 101) / 100.0 as coherence, p_partkey % 3 as conncomp, p_retailprice as dem, 35 + (p_partkey // 50) * 0.001 as lat,
      128 + (p_partkey % 50) * 0.001 as lon, (p_size - 25) / 1000.0 as velocity from part)"""
WEIGHTS = {"coherence": 0.4, "conncomp": 0.2, "elevation": 0.1, "distance": 0.15, "velocity": 0.15}


def reference_pixels(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 50).alias("row"), (k % 50).alias("col"), ((k * 37 % 101) / 100.0).alias("coherence"), (k % 3).alias("conncomp"), F.col("p_retailprice").alias("dem"),
        (35 + F.floor(k / 50) * 0.001).alias("lat"), (128 + (k % 50) * 0.001).alias("lon"), ((F.col("p_size") - 25) / 1000.0).alias("velocity"),
    )


_DIST = f"2 * {EARTH_RADIUS_M} * asin(sqrt(least(greatest(pow(sin(radians(la - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * pow(sin(radians(lo - lon) / 2), 2), 0), 1)))"


SCORED = f"""{PX}, b as (select median(dem) as h, avg(lat) as la, avg(lon) as lo, quantile_cont(abs(velocity), 0.95) as v95 from px),
    major as (select arg_max(conncomp, (c, -conncomp)) as major from (select conncomp, count(*) as c from px where conncomp > 0 group by 1)),
    d as (select *, abs(dem - h) as dev, {_DIST} as dist from px, b, major), m as (select max(dev) as dm, max(dist) as xm from d),
    scored as (select row, col, 0.4 * least(greatest(coherence, 0), 1) + 0.2 * (conncomp = major)::int + 0.1 * least(greatest(1 - dev / dm, 0), 1) + 0.15 * least(greatest(1 - dist / xm, 0), 1)
      + 0.15 * least(greatest(1 - abs(velocity) / v95, 0), 1) as score from d, m)"""


@plan(f"with {SCORED} select row, col, round(score, 6) as score from scored")
def reference_point_scores(spark, sf_dir):
    return series.reference_scores(reference_pixels(spark, sf_dir), WEIGHTS).select("row", "col", F.round("score", 6).alias("score"))


@plan(f"""with recursive {SCORED}, rounded as (select row, col, round(score, 9) as score from scored where score is not null),
    best(place, taken, row, col, score) as (
      select 0, []::struct(r bigint, c bigint)[], 0::bigint, 0::bigint, 0.0::double
      union all
      select place + 1, list_append(taken, {{'r': b.row, 'c': b.col}}), b.row, b.col, b.score from (
        select p.place, p.taken, arg_min({{'row': cast(s.row as bigint), 'col': cast(s.col as bigint), 'score': s.score}}, (-s.score, s.row, s.col)) as b from best p, rounded s
        where p.place < 5 and len(list_filter(p.taken, lambda t: greatest(abs(t.r - s.row), abs(t.c - s.col)) < 5)) = 0 group by 1, 2))
  select cast(place as bigint) as place, row, col, score from best where place > 0""")
def reference_points(spark, sf_dir):
    scored = series.reference_scores(reference_pixels(spark, sf_dir), WEIGHTS).withColumn("score", F.round("score", 9))
    return series.top_separated(scored, 5, 5)


@plan("""with p as (select user_id, cast(date_trunc('day', ts) as date) as d, avg(value) as v from events group by 1, 2), m as (select d, median(v) as med from p group by 1)
    select user_id, strftime(d, '%Y-%m-%d') as d, round(atan2(sin(v - med), cos(v - med)), 6) as residual from p join m using (d)""")
def median_removed(spark, sf_dir):
    """Per-layer spatial median taken out, the rest wrapped."""
    p = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    m = p.groupBy("d").agg(F.median("v").alias("med"))
    return p.join(m, "d").select("user_id", F.date_format("d", "yyyy-MM-dd").alias("d"), F.round(wrap(F.col("v") - F.col("med")), 6).alias("residual"))
