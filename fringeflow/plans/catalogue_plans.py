"""Catalogue operators and estimators over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as cat
from ..operators import estimators as est
from ..operators import grids
from .grid_plans import patches
from .network_plans import PAIRS, sbas
from .registry import micros, plan, table

SCENES = """scenes as (select p_partkey as id, case when p_partkey % 2 = 0 then 'ASCENDING' else 'DESCENDING' end as direction, case p_partkey % 4 when 0 then 'VV+VH' when 1 then 'vh/hv' when 2 then 'HH' else 'VH' end as pol,
    case when p_partkey % 17 = 0 then null else p_size / 10.0 end as w, p_size / 10.0 + 1.5 as e, (p_partkey % 30) / 10.0 as s, (p_partkey % 30) / 10.0 + 1 as n, p_brand as brand from part)"""


def scenes(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 2 == 0, "ASCENDING").otherwise("DESCENDING").alias("direction"), F.when(k % 4 == 0, "VV+VH").when(k % 4 == 1, "vh/hv").when(k % 4 == 2, "HH").otherwise("VH").alias("pol"),
        F.when(k % 17 != 0, size / 10.0).alias("w"), (size / 10.0 + 1.5).alias("e"), ((k % 30) / 10.0).alias("s"), ((k % 30) / 10.0 + 1).alias("n"), F.col("p_brand").alias("brand"),
    )


@plan(f"with {SCENES} select id from scenes where direction = 'ASCENDING' and (w is null or (w <= 3 and e >= 1 and s <= 2.5 and n >= 0.5)) and pol in ('VV+VH')")
def scene_search(spark, sf_dir):
    s = cat.within_box(cat.by_direction(scenes(spark, sf_dir), "asc"), 1.0, 0.5, 3.0, 2.5)
    return cat.by_polarisation(s, "VV").select("id")


@plan(f"with {SCENES} select id from scenes where direction = 'DESCENDING'")
def scene_search_without_channel(spark, sf_dir):
    """No descending scene has HH alone: the filter falls back to all of them."""
    return cat.by_polarisation(cat.by_direction(scenes(spark, sf_dir), "desc"), "HH").select("id")


@plan("""with p as (select p_partkey, p_partkey % 50 as x, p_partkey // 50 as y from part), ring(x0, y0, x1, y1) as (values (5.2, 2.5, 40.1, 8.5), (40.1, 8.5, 30.3, 33.5), (30.3, 33.5, 10.7, 20.5), (10.7, 20.5, 5.2, 2.5))
  select p_partkey from p, ring where (y0 > y) <> (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 group by 1 having count(*) % 2 = 1""")
def points_in_polygon(spark, sf_dir):
    k = F.col("p_partkey")
    ring = [(5.2, 2.5), (40.1, 8.5), (30.3, 33.5), (10.7, 20.5)]
    return table(spark, sf_dir, "part").where(cat.in_polygon((k % 50).cast("double"), F.floor(k / 50).cast("double"), ring)).select("p_partkey")


ORBITS = """orbits as (select o_orderkey as n, o_custkey % 3 as mission, case o_orderkey % 3 when 0 then 'POEORB' when 1 then 'RESORB' else 'PREORB' end as kind, epoch(o_orderdate) - 43200 as start, epoch(o_orderdate) + 43200 * (1 + o_orderkey % 3) as stop,
    o_totalprice as created, 'O' || lpad(cast(o_orderkey as varchar), 8, '0') as name from orders)"""


@plan(f"""with {ORBITS}, r as (select l_orderkey * 10 + l_linenumber as id, l_suppkey % 3 as mission, epoch(l_shipdate) as t, count(*) as c from lineitem group by 1, 2, 3),
  m as (select r.id, name, row_number() over (partition by r.id order by case kind when 'POEORB' then 0 when 'RESORB' then 1 else 2 end, created desc, name desc) as n from r join orbits o on o.mission = r.mission and r.t between o.start and o.stop)
  select id, max(name) as orbit from (select distinct id from r) left join (select * from m where n = 1) using (id) group by 1""")
def orbit_choice(spark, sf_dir):
    sec = lambda c: (micros(c) / 1e6)
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 3).alias("mission"), F.when(k % 3 == 0, "POEORB").when(k % 3 == 1, "RESORB").otherwise("PREORB").alias("kind"), (sec("o_orderdate") - 43200).alias("start"), (sec("o_orderdate") + 43200 * (1 + k % 3)).alias("stop"),
        F.col("o_totalprice").alias("created"), F.concat(F.lit("O"), F.lpad(k.cast("string"), 8, "0")).alias("name"),
    )
    r = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 3).alias("mission"), sec("l_shipdate").alias("t"))
    return cat.choose_orbits(r, o, {"POEORB": 0, "RESORB": 1, "PREORB": 2})


@plan(f"""with {PAIRS}, g as (select distinct o_custkey as stack, cast(o_orderdate as date) as date, o_orderkey % 2 as burst from orders), b as (select distinct stack, burst from g),
  need as (select * from pairs join b using (stack)), j as (select need.*, r.burst is not null and s.burst is not null as ok from need left join g r on r.stack = need.stack and r.date = need.ref and r.burst = need.burst
    left join g s on s.stack = need.stack and s.date = need.sec and s.burst = need.burst)
  select stack, strftime(ref, '%Y-%m-%d') as ref, strftime(sec, '%Y-%m-%d') as sec, count(*) filter (ok) as n_bursts, bool_and(ok) as complete from j group by 1, 2, 3""")
def pair_completeness(spark, sf_dir):
    g = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stack"), F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 2).alias("burst")).distinct()
    out = cat.complete_pairs(sbas(spark, sf_dir).select("stack", "ref", "sec"), g, g.select("stack", "burst").distinct())
    return out.select("stack", F.date_format("ref", "yyyy-MM-dd").alias("ref"), F.date_format("sec", "yyyy-MM-dd").alias("sec"), "n_bursts", "complete")


@plan("""with a as (select l_orderkey, l_suppkey, min(l_tax) as v from lineitem where l_linenumber % 2 = 1 group by 1, 2), b as (select l_suppkey, min(l_tax) as v from lineitem where l_linenumber % 2 = 1 group by 1),
  r as (select distinct l_orderkey, l_suppkey from lineitem) select r.l_orderkey, r.l_suppkey, coalesce(a.v, b.v) as l_tax from r left join a using (l_orderkey, l_suppkey) left join b using (l_suppkey)""")
def granule_matching(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    r = li.select("l_orderkey", "l_suppkey").distinct()
    return cat.matched(r, li.where("l_linenumber % 2 = 1"), ["l_orderkey", "l_suppkey"], ["l_suppkey"], "l_tax").select("l_orderkey", "l_suppkey", "l_tax")


@plan(f"with {SCENES}, x as (select brand, max(w) as w, max(s) as s, min(e) as e, min(n) as n from scenes where w is not null group by 1) select brand, case when w < e and s < n then cast(w as double) end as w, case when w < e and s < n then cast(s as double) end as s, case when w < e and s < n then cast(e as double) end as e, case when w < e and s < n then cast(n as double) end as n from x")
def common_extents(spark, sf_dir):
    return cat.common_extent(scenes(spark, sf_dir).where("w is not null"), ["brand"])


@plan(f"""with {SCENES}, b as (select brand, greatest(w, 0.5) as w, greatest(s, 0.5) as s, least(e, 4.5) as e, least(n, 3.5) as n from scenes where w is not null),
  cells as (select x / 20.0 as x, y / 20.0 as y from (select unnest(generate_series(10, 89)) as x), (select unnest(generate_series(10, 69)) as y)), k as (select distinct brand from scenes where w is not null)
  select brand, round(cast(count(*) filter (exists (select 1 from b where b.brand = k.brand and b.w <= c.x + 1e-6 and b.e >= c.x + 0.05 - 1e-6 and b.s <= c.y + 1e-6 and b.n >= c.y + 0.05 - 1e-6)) as double) / 4800, 6) as coverage from k, cells c group by 1""")
def footprint_coverage(spark, sf_dir):
    """Union of footprints over an area of interest; all edges are multiples of a twentieth, which the SQL counts by cells."""
    return cat.box_coverage(scenes(spark, sf_dir).where("w is not null"), ["brand"], 0.5, 0.5, 4.5, 3.5).withColumn("coverage", F.round("coverage", 6))


@plan("""with recursive edges as (select distinct n_regionkey as a, n_nationkey + 100 as b from nation union all select n_nationkey + 100, n_nationkey + 101 from nation where n_nationkey % 6 <> 5),
  r(node) as (select 3 union select e.b from r join edges e on e.a = r.node) select cast(node as bigint) as node from r""")
def downstream_stages(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("long")
    edges = n.select(F.col("n_regionkey").cast("long").alias("a"), (k + 100).alias("b")).distinct().unionByName(n.where("n_nationkey % 6 <> 5").select((k + 100).alias("a"), (k + 101).alias("b")))
    return cat.reachable(edges, spark.range(3, 4).withColumnRenamed("id", "node"))


@plan("""with v as (select l_suppkey, l_returnflag = 'A' as s, l_quantity as x, l_orderkey * 10 + l_linenumber as o from lineitem where l_returnflag <> 'N'),
  c as (select l_suppkey, sum(s::int) over p as n, sum((not s)::int) over p as m, sum(s::int) over (partition by l_suppkey order by x, s desc rows between unbounded preceding and current row) as a,
    sum((not s)::int) over (partition by l_suppkey order by x, s desc rows between unbounded preceding and current row) as b from v window p as (partition by l_suppkey))
  select l_suppkey, round(max(abs(a / n - b / m)), 8) as d, cast(any_value(n) as bigint) as n, cast(any_value(m) as bigint) as m from c where n > 0 and m > 0 group by 1""")
def sample_distance(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").withColumn("s", F.col("l_returnflag") == "A")
    return est.ks_distance(v, ["l_suppkey"], "s", "l_quantity").withColumn("d", F.round("d", 8))


@plan()
def phase_linking(spark, sf_dir):
    """Rows of a patch are epochs, columns samples; layers are blocks."""
    p = patches(spark, sf_dir).select("layer", "row", "col", F.cos(F.col("v") * 3).alias("re"), F.sin(F.col("v") * 3).alias("im"))
    return est.linked_phase(p, ["layer"], "row", "re", "im", "col").withColumns({c: F.round(c, 6) for c in ("phase", "quality")})


@plan("""with recursive e as (select l_suppkey as g, 0 as x from lineitem group by 1), t as (select g, unnest(generate_series(0, 3)) as tile from e) select g as "group", tile, cast((g + tile * 3) % 5 - g % 5 as bigint) as cycles, 0.0::double as residual from t""")
def tile_offset_solution(spark, sf_dir):
    """Four tiles in a ring; every edge tells the difference of the tiles' whole cycles."""
    g = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("group")).distinct()
    e = g.withColumn("e", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in ((0, 1), (1, 2), (2, 3), (0, 3))]))).select("group", "e.*")
    truth = lambda t: (F.col("group") + t * 3) % 5
    e = e.withColumn("cycle", truth(F.col("b")) - truth(F.col("a"))).withColumn("weight", F.lit(1.0) + F.col("a"))
    return est.tile_offsets(e, "group")


@plan()
def turbulence_screens(spark, sf_dir):
    n = table(spark, sf_dir, "region").count()
    s = est.power_law_screens(spark, n, 16, 16)
    return grids.fringe_density(s, ["layer"], "value").withColumn("density", F.round("density", 6))


@plan("""with v as (select user_id, cast(date_trunc('day', ts) as date) as d, avg(case when event_type = 'error' then null else value end) as b from events group by 1, 2)
  select a.user_id, strftime(a.d, '%Y-%m-%d') as ref, strftime(c.d, '%Y-%m-%d') as sec, round(c.b - a.b, 6) as bperp from v a join v c on a.user_id = c.user_id and datediff('day', a.d, c.d) between 1 and 2""")
def baseline_differences(spark, sf_dir):
    """Mean per date of the values known, differences over pairs; null where a date has none."""
    from ..operators.joins import band_join

    b = F.avg(F.when(F.col("event_type") != "error", F.col("value")))
    v = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(b.alias("b"))
    one, two = v.select("user_id", F.col("d").alias("ref"), F.col("b").alias("b1")), v.select("user_id", F.col("d").alias("sec"), F.col("b").alias("b2"))
    p = band_join(one, two, ["user_id"], F.unix_date("ref"), F.unix_date("sec"), 2).where("ref < sec")
    return p.select("user_id", F.date_format("ref", "yyyy-MM-dd").alias("ref"), F.date_format("sec", "yyyy-MM-dd").alias("sec"), F.round(F.col("b2") - F.col("b1"), 6).alias("bperp"))


@plan("""with s as (select c_custkey % 40 as site, c_custkey as seq, c_acctbal as v from customer) select cast(site as bigint) as site, min(seq) as first_seen, count(*) as n, string_agg(cast(seq as varchar), ',' order by v, seq) as in_order from s group by 1""")
def grouped_sites(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("site"), F.col("c_custkey").alias("seq"), F.col("c_acctbal").alias("v"))
    listed = F.array_sort(F.collect_list(F.struct("v", "seq")))
    out = s.groupBy("site").agg(F.min("seq").alias("first_seen"), F.count(F.lit(1)).alias("n"), listed.alias("l"))
    return out.select("site", "first_seen", "n", F.array_join(F.transform("l", lambda x: x["seq"].cast("string")), ",").alias("in_order"))


@plan("""with r as (select l_suppkey as stage, l_linenumber as run, sum(l_quantity) as wall from lineitem group by 1, 2), b as (select stage, median(wall) as m, count(*) as n from r group by 1),
  a as (select stage, median(wall * (1 + (stage % 3) * 0.1)) as m from r group by 1) select b.stage, b.n as repeats, round(b.m, 4) as before, round(a.m, 4) as after, round((a.m - b.m) / abs(b.m) * 100, 4) as change_pct, a.m > b.m * 1.15 as regressed from b join a using (stage)""")
def repeated_timings(spark, sf_dir):
    """Medians over repeats, their change, and whether it exceeds 15 percent."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("stage"), "l_linenumber").agg(F.sum("l_quantity").alias("wall"))
    slower = F.col("wall") * (1 + (F.col("stage") % 3) * 0.1)
    m = r.groupBy("stage").agg(F.count(F.lit(1)).alias("repeats"), F.median("wall").alias("b"), F.median(slower).alias("a"))
    change = (F.col("a") - F.col("b")) / F.abs("b") * 100
    return m.select("stage", "repeats", F.round("b", 4).alias("before"), F.round("a", 4).alias("after"), F.round(change, 4).alias("change_pct"), (F.col("a") > F.col("b") * 1.15).alias("regressed"))
