"""Networks and closure over orders: a customer is a stack, order dates its acquisitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import pair_key, regular_dates
from ..functions.phase import wrap
from ..operators import closure as cl
from ..operators import network as nw
from ..operators.frames import cut
from .registry import plan, table

STACK = ["stack"]
MAX_DAYS, MAX_PERP = 365, 150.0

DATES = """dates as (
    select o_custkey as stack, cast(o_orderdate as date) as date,
           case when min(o_orderpriority) = '1-URGENT' then null else max(o_totalprice) / 1000 end as bperp
    from orders group by 1, 2)"""

PAIRS = f"""{DATES}, pairs as (
    select a.stack, a.date as ref, b.date as sec, cast(datediff('day', a.date, b.date) as bigint) as dt_days, b.bperp - a.bperp as bperp
    from dates a join dates b on a.stack = b.stack and a.date < b.date and datediff('day', a.date, b.date) <= {MAX_DAYS}
    where a.bperp is null or b.bperp is null or abs(b.bperp - a.bperp) <= {MAX_PERP})"""

OUT = "stack, strftime(ref, '%Y%m%d') || '_' || strftime(sec, '%Y%m%d') as pair, dt_days, round(bperp, 6) as bperp"


def acquisitions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    b = F.when(F.min("o_orderpriority") != "1-URGENT", F.max("o_totalprice") / 1000)
    return o.groupBy(F.col("o_custkey").alias("stack"), F.to_date("o_orderdate").alias("date")).agg(b.alias("bperp"))


def sbas(spark, sf_dir):
    return nw.build_pairs(acquisitions(spark, sf_dir), STACK, max_days=MAX_DAYS, max_perp_m=MAX_PERP)


def shown(pairs):
    return pairs.select("stack", pair_key(F.col("ref"), F.col("sec")).alias("pair"), "dt_days", F.round("bperp", 6).alias("bperp"))


@plan(f"with {PAIRS} select {OUT} from pairs")
def network_pairs(spark, sf_dir):
    return shown(sbas(spark, sf_dir))


@plan(f"""with {DATES}, n as (select *, row_number() over (partition by stack order by date) as k from dates)
    select a.stack, strftime(a.date, '%Y%m%d') || '_' || strftime(b.date, '%Y%m%d') as pair,
           cast(datediff('day', a.date, b.date) as bigint) as dt_days, round(b.bperp - a.bperp, 6) as bperp
    from n a join n b on a.stack = b.stack and b.k between a.k + 1 and a.k + 3""")
def network_sequential(spark, sf_dir):
    return shown(nw.build_pairs(acquisitions(spark, sf_dir), STACK, method="sequential", connections=3))


REFERENCE = f"""{DATES}, span as (
    select stack, min(date) as d0, max(date) as d1, count(bperp) as known from dates group by 1),
  sums as (
    select a.stack, a.date, sum(abs(a.bperp - b.bperp)) as s from dates a join dates b on a.stack = b.stack and b.bperp is not null
    where a.bperp is not null group by 1, 2),
  worst as (select stack, max(s) as w from sums group by 1),
  scored as (
    select d.stack, d.date, round(
      case when d1 > d0 then abs(datediff('day', d0, d.date) - datediff('day', d0, d1) / 2.0) / (datediff('day', d0, d1) / 2.0) else 0 end
      + case when known >= 2 then coalesce(s.s / case when w = 0 then 1 else w end, 1.0) else 0 end, 9) as score
    from dates d join span using (stack) left join worst using (stack) left join sums s on s.stack = d.stack and s.date = d.date),
  best as (select stack, arg_min(date, (score, date)) as reference, min(score) as score from scored group by 1)"""


@plan(f"with {REFERENCE} select stack, strftime(reference, '%Y-%m-%d') as reference, round(score, 6) as score from best")
def reference_dates(spark, sf_dir):
    r = nw.recommend_reference(acquisitions(spark, sf_dir), STACK)
    return r.select("stack", F.date_format("reference", "yyyy-MM-dd").alias("reference"), F.round("score", 6).alias("score"))


@plan(f"""with {REFERENCE}
    select d.stack, strftime(least(d.date, reference), '%Y%m%d') || '_' || strftime(greatest(d.date, reference), '%Y%m%d') as pair,
           cast(abs(datediff('day', reference, d.date)) as bigint) as dt_days,
           round(case when d.date > reference then d.bperp - m.bperp else m.bperp - d.bperp end, 6) as bperp
    from dates d join best using (stack) join dates m on m.stack = d.stack and m.date = reference where d.date <> reference""")
def network_single_reference(spark, sf_dir):
    return shown(nw.build_pairs(acquisitions(spark, sf_dir), STACK, method="single_reference"))


COMPONENTS = f"""recursive {PAIRS}, both_ways as (select stack, ref as a, sec as b from pairs union select stack, sec, ref from pairs),
  reach(stack, node, other) as (
    select stack, date, date from dates
    union
    select r.stack, r.node, e.b from reach r join both_ways e on e.stack = r.stack and e.a = r.other),
  labels as (select stack, node, min(other) as root from reach group by 1, 2)"""


@plan(f"with {COMPONENTS} select stack, strftime(node, '%Y-%m-%d') as node, strftime(root, '%Y-%m-%d') as root from labels")
def network_components(spark, sf_dir):
    d = cut(acquisitions(spark, sf_dir))
    p = nw.build_pairs(d, STACK, max_days=MAX_DAYS, max_perp_m=MAX_PERP)
    out = nw.components(d.select("stack", F.col("date").alias("node")), p.select("stack", F.col("ref").alias("a"), F.col("sec").alias("b")), STACK)
    return out.select("stack", F.date_format("node", "yyyy-MM-dd").alias("node"), F.date_format("root", "yyyy-MM-dd").alias("root"))


@plan(f"""with {COMPONENTS},
  sizes as (select stack, root, count(*) as n from labels group by 1, 2),
  comps as (select stack, count(*) as n_components, cast(sum(n) - max(n) as bigint) as n_dates_disconnected from sizes group by 1),
  stats as (select stack, count(*) as n_pairs, count(bperp) as n_with_baseline, min(dt_days) as days_min, median(dt_days) as days_median,
                   max(dt_days) as days_max, min(abs(bperp)) as perp_min, median(abs(bperp)) as perp_median, max(abs(bperp)) as perp_max from pairs group by 1)
  select stack, n_components, n_dates_disconnected, coalesce(n_pairs, 0) as n_pairs, coalesce(n_with_baseline, 0) as n_with_baseline, days_min,
         cast(days_median as double) as days_median, days_max, round(perp_min, 6) as perp_min, round(perp_median, 6) as perp_median, round(perp_max, 6) as perp_max
  from comps left join stats using (stack)""")
def network_summary(spark, sf_dir):
    d = cut(acquisitions(spark, sf_dir))
    s = nw.network_summary(d, cut(nw.build_pairs(d, STACK, max_days=MAX_DAYS, max_perp_m=MAX_PERP)), STACK)
    return s.select(
        "stack", "n_components", "n_dates_disconnected", "n_pairs", "n_with_baseline", "days_min", F.col("days_median").cast("double").alias("days_median"), "days_max",
        *[F.round(f"perp_{x}", 6).alias(f"perp_{x}") for x in ("min", "median", "max")],
    )


INTEGRATED = f"""recursive {PAIRS}, known as (select * from pairs where bperp is not null),
  both_ways as (select stack, ref as a, sec as b from known union select stack, sec, ref from known),
  origin as (select stack, min(a) as o from both_ways group by 1),
  reach(stack, date) as (select stack, o from origin union select r.stack, e.b from reach r join both_ways e on e.stack = r.stack and e.a = r.date),
  per_date as (select r.stack, r.date, d.bperp - z.bperp as bperp from reach r join dates d using (stack, date) join origin using (stack) join dates z on z.stack = r.stack and z.date = o)"""


@plan(f"with {INTEGRATED} select stack, strftime(date, '%Y-%m-%d') as date, round(bperp, 6) as bperp from per_date")
def baseline_integration(spark, sf_dir):
    """Differences add up along any path, so the SQL takes them from the dates reached."""
    out = nw.integrate_baselines(sbas(spark, sf_dir), STACK)
    return out.select("stack", F.date_format("date", "yyyy-MM-dd").alias("date"), F.round(F.round("bperp", 8), 6).alias("bperp"))


@plan(f"""with {PAIRS}, kept as (select * from pairs where bperp is null or abs(bperp) <= 60)
  select stack, count(*) filter (bperp is null or abs(bperp) <= 60) as n_pairs, count(*) filter (abs(bperp) > 60) as n_pairs_dropped, max(case when bperp is null or abs(bperp) <= 60 then dt_days end) as days_max from pairs group by 1""")
def baselines_reapplied(spark, sf_dir):
    """Pairs beyond a threshold go once baselines are known; the network is summed up anew."""
    _, summary = nw.with_baselines(acquisitions(spark, sf_dir), cut(sbas(spark, sf_dir)), STACK, 60.0)
    return summary.where("n_pairs + n_pairs_dropped > 0").select("stack", "n_pairs", "n_pairs_dropped", "days_max")


@plan("""with seen as (
    select l_returnflag as flag, l_linestatus as status, l_suppkey as burst, cast(date_trunc('month', l_shipdate) as date) as date, max(1.0 / 40) as area
    from lineitem group by 1, 2, 3, 4),
  per_burst as (select flag, status, burst, count(*) as on_dates, max(area) as area from seen group by 1, 2, 3),
  per_date as (select flag, status, date, count(*) as n_bursts from seen group by 1, 2, 3),
  dates as (select flag, status, count(*) as n_dates from per_date group by 1, 2),
  bursts as (select flag, status, n_dates, count(*) as n_union, count(*) filter (on_dates = n_dates) as n_common,
                    least(1.0, coalesce(sum(area) filter (on_dates = n_dates), 0)) as cov_a, least(1.0, sum(area)) as cov_all
             from per_burst join dates using (flag, status) group by 1, 2, 3),
  complete as (select flag, status, count(*) filter (n_bursts = n_union) as n_complete from per_date join bursts using (flag, status) group by 1, 2),
  both_ways as (select *, case when n_complete > 0 then cov_all else 0 end as cov_b from bursts join complete using (flag, status))
  select flag, status, n_dates, n_complete, n_union, n_common, cast(round(cov_a, 6) as double) as cov_a, cast(round(cov_b, 6) as double) as cov_b,
         case when cov_a >= 0.9 or cov_a > cov_b or (cov_a = cov_b and n_dates >= n_complete) then 'drop_bursts' else 'drop_dates' end as chosen,
         n_union - n_common as n_bursts_dropped, n_dates - n_complete as n_dates_dropped from both_ways""")
def candidate_groups(spark, sf_dir):
    rec = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("burst"),
        F.to_date(F.trunc("l_shipdate", "month")).alias("date"), F.lit(1.0 / 40).alias("area"),
    )
    out = nw.group_candidates(rec, ["flag", "status"], 0.9)
    return out.withColumn("cov_a", F.round("cov_a", 6)).withColumn("cov_b", F.round("cov_b", 6))


TRIPLETS = f"""{PAIRS}, tri as (
    select ij.stack, ij.ref as d1, ij.sec as d2, jk.sec as d3 from pairs ij join pairs jk on jk.stack = ij.stack and jk.ref = ij.sec
    join pairs ik on ik.stack = ij.stack and ik.ref = ij.ref and ik.sec = jk.sec)"""

#: A pixel's phase of a pair: baseline and time with a gain of its own, so that triplets don't close.
PHASES = """px as (select * from (values (0), (1), (2), (3)) t(px)),
  phases as (
    select stack, ref, sec, px, case when (dt_days + px) % 11 = 0 then null else bperp * 0.1 * (px + 1) + 0.3 * sqrt(dt_days) end as unw from pairs, px)"""


def phases(pairs):
    px = pairs.withColumn("px", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    unw = F.when((F.col("dt_days") + F.col("px")) % 11 != 0, F.col("bperp") * 0.1 * (F.col("px") + 1) + 0.3 * F.sqrt("dt_days"))
    return px.select("stack", "ref", "sec", "px", unw.alias("phase"))


D = ", ".join(f"strftime({d}, '%Y-%m-%d') as {d}" for d in ("d1", "d2", "d3"))


def dated(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


@plan(f"with {TRIPLETS} select stack, {D} from tri")
def triplet_enumeration(spark, sf_dir):
    return dated(cl.triplets(sbas(spark, sf_dir), STACK), "d1", "d2", "d3")


CLOSURE = f"""{TRIPLETS}, {PHASES}, raw as (
    select tri.*, a.px, a.unw + b.unw - c.unw as c from tri join phases a on a.stack = tri.stack and a.ref = d1 and a.sec = d2
    join phases b on b.stack = tri.stack and b.ref = d2 and b.sec = d3 and b.px = a.px
    join phases c on c.stack = tri.stack and c.ref = d1 and c.sec = d3 and c.px = a.px
    where a.unw is not null and b.unw is not null and c.unw is not null),
  closed as (select *, cast(round_even((c - atan2(sin(c), cos(c))) / (2 * pi()), 0) as bigint) as turns from raw)"""


@plan(f"""with {CLOSURE} select stack, {D}, round(sqrt(avg(c * c)), 6) as rms, round(count(*) filter (turns <> 0) / count(*), 6) as nonzero_fraction
    from closed group by stack, d1, d2, d3""")
def closure_by_triplet(spark, sf_dir):
    p = cut(sbas(spark, sf_dir))
    s = cl.triplet_stats(cl.closure(phases(p), p, STACK), STACK)
    return dated(s, "d1", "d2", "d3").withColumn("rms", F.round("rms", 6)).withColumn("nonzero_fraction", F.round("nonzero_fraction", 6))


@plan(f"""with {CLOSURE} select stack, cast(px as int) as px, round(sqrt(avg(c * c)), 6) as rms, count(*) filter (turns <> 0) as n_nonzero,
    round(sqrt(pow(sum(cos(c)), 2) + pow(sum(sin(c)), 2)) / count(*), 6) as coherence from closed group by stack, px""")
def closure_by_pixel(spark, sf_dir):
    p = cut(sbas(spark, sf_dir))
    s = cl.pixel_stats(cl.closure(phases(p), p, STACK), ["stack", "px"])
    return s.withColumn("rms", F.round("rms", 6)).withColumn("coherence", F.round("coherence", 6))


SCORES = f"""{CLOSURE}, per_tri as (select stack, d1, d2, d3, sqrt(avg(c * c)) as rms from closed group by 1, 2, 3, 4),
  edges as (select stack, d1 as ref, d2 as sec, rms from per_tri union all select stack, d2, d3, rms from per_tri union all select stack, d1, d3, rms from per_tri),
  means as (select stack, ref, sec, avg(rms) as score, count(*) as n_triplets from edges group by 1, 2, 3),
  scores as (select p.stack, p.ref, p.sec, coalesce(score, 0) as score, coalesce(n_triplets, 0) as n_triplets from pairs p left join means using (stack, ref, sec))"""


@plan(f"""with {SCORES} select stack, strftime(ref, '%Y%m%d') || '_' || strftime(sec, '%Y%m%d') as pair, round(score, 6) as score, n_triplets,
    row_number() over (partition by stack order by round(score, 9) desc, ref, sec) as place from scores""")
def closure_ranking(spark, sf_dir):
    from pyspark.sql import Window

    p = cut(sbas(spark, sf_dir))
    s = cl.pair_scores(cl.triplet_stats(cl.closure(phases(p), p, STACK), STACK), p, STACK, "rms")
    order = Window.partitionBy("stack").orderBy(F.desc(F.round("score", 9)), "ref", "sec")
    return s.select("stack", pair_key(F.col("ref"), F.col("sec")).alias("pair"), F.round("score", 6).alias("score"), "n_triplets", F.row_number().over(order).cast("long").alias("place"))


_PAIR = lambda a, b: f"strftime({a}, '%Y%m%d') || '_' || strftime({b}, '%Y%m%d')"
PEELED = f"""{CLOSURE}, per_tri as (select stack, [{_PAIR('d1', 'd2')}, {_PAIR('d2', 'd3')}, {_PAIR('d1', 'd3')}] as tri, sqrt(avg(c * c)) as rms from closed group by stack, d1, d2, d3),
  ed as (select stack, tri, unnest(tri) as pair, rms from per_tri),
  peel(stack, place, flagged, pair, score) as (
    select distinct stack, 0, []::varchar[], '', 0.0::double from per_tri
    union all
    select stack, place + 1, list_append(flagged, worst), worst, score from (
      select stack, place, flagged, arg_max(pair, (s, pair)) as worst, max(s) as score from (
        select p.stack, p.place, p.flagged, e.pair, round(avg(e.rms), 9) as s from peel p join ed e on e.stack = p.stack and not list_has_any(e.tri, p.flagged) group by 1, 2, 3, 4) group by 1, 2, 3) where score > 1.2)"""


@plan(f"with recursive {PEELED} select stack, cast(place as bigint) as place, pair, round(score, 6) as score from peel where place > 0")
def closure_suspicious(spark, sf_dir):
    p = cut(sbas(spark, sf_dir))
    out = cl.suspicious_pairs(cl.triplet_stats(cl.closure(phases(p), p, STACK), STACK), STACK, "rms", 1.2)
    return out.withColumn("score", F.round("score", 6))


@plan(f"""with {CLOSURE}, per_px as (select stack, px, sqrt(avg(c * c)) as rms from closed group by 1, 2)
    select (select round(sqrt(avg(c * c)), 6) from closed) as pooled_rms, (select round(sqrt(avg(rms * rms)), 6) from per_px) as rms_of_pixels,
           (select round(sqrt(avg(pow(atan2(sin(c), cos(c)), 2))), 6) from closed) as wrapped_rms""")
def closure_pooled(spark, sf_dir):
    p = cut(sbas(spark, sf_dir))
    c = cl.closure(phases(p), p, STACK)
    pooled = c.agg(F.round(F.sqrt(F.avg(F.pow("closure", 2))), 6).alias("pooled_rms"), F.round(F.sqrt(F.avg(F.pow(wrap(F.col("closure")), 2))), 6).alias("wrapped_rms"))
    by_px = cl.pixel_stats(c, ["stack", "px"]).agg(F.round(F.sqrt(F.avg(F.pow("rms", 2))), 6).alias("rms_of_pixels"))
    return pooled.crossJoin(by_px).select("pooled_rms", "rms_of_pixels", "wrapped_rms")


@plan(f"""with {DATES}, n as (select *, row_number() over (partition by stack order by date) as k from dates),
    p as (select a.stack, a.k as ka, b.k as kb from n a join n b on a.stack = b.stack and a.date < b.date and datediff('day', a.date, b.date) <= {MAX_DAYS}
          where a.bperp is null or b.bperp is null or abs(b.bperp - a.bperp) <= {MAX_PERP})
    select stack, greatest(1, max(kb - ka)) as span from p group by 1""")
def network_index_span(spark, sf_dir):
    """Largest distance of a pair's dates in the order of the stack's dates, one at least."""
    from pyspark.sql import Window

    n = acquisitions(spark, sf_dir).select("stack", "date", F.row_number().over(Window.partitionBy("stack").orderBy("date")).cast("long").alias("k"))
    p = sbas(spark, sf_dir).join(n.select("stack", F.col("date").alias("ref"), F.col("k").alias("ka")), ["stack", "ref"])
    p = p.join(n.select("stack", F.col("date").alias("sec"), F.col("k").alias("kb")), ["stack", "sec"])
    return p.groupBy("stack").agg(F.greatest(F.lit(1).cast("long"), F.max(F.col("kb") - F.col("ka"))).alias("span"))


@plan("""with recursive d(stack, k, date) as (select r_regionkey, 0, date '2024-01-01' from region union all select stack, k + 1, cast(date + interval 12 day as date) from d where k < 5)
    select cast(a.stack as bigint) as stack, strftime(a.date, '%Y%m%d') || '_' || strftime(b.date, '%Y%m%d') as pair
    from d a join d b on a.stack = b.stack and a.k < b.k and datediff('day', a.date, b.date) <= 48""")
def network_regular_dates(spark, sf_dir):
    """Six dates twelve days apart, pairs up to 48 days: fourteen a stack."""
    d = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("stack"), F.explode(regular_dates("2024-01-01", 6, 12)).alias("date"), F.lit(None).cast("double").alias("bperp"))
    return nw.build_pairs(d, STACK, max_days=48).select("stack", pair_key(F.col("ref"), F.col("sec")).alias("pair"))
