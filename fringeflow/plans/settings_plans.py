"""Settings, grids and product files over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import settings
from ..operators import artifacts
from .registry import plan, table

_k = "o_orderkey"


@plan("""with c as (select o_orderkey,
    case o_orderkey % 4 when 0 then 'auto' when 2 then (o_custkey % 20)::varchar when 3 then 'x' end as a,
    case o_orderkey % 3 when 0 then '[3, ' || (o_orderkey % 7) || ']' when 2 then '[4]' end as b,
    case when o_orderkey % 5 < 2 then (o_orderkey % 9)::varchar end as d from orders),
  v as (select o_orderkey, try_cast(a as double) as x, (3 * nullif(regexp_extract(b, ', ([0-9]+)', 1), '')::bigint)::double as y, try_cast(d as double) as z from c)
  select o_orderkey, coalesce(x, y, z, 1.0)::double as looks, case when x is not null then 'nlooks' when y is not null then 'looks' when z is not null then 'attrs' else 'default' end as source from v""")
def looks_resolved(spark, sf_dir):
    k = F.col(_k)
    a = F.when(k % 4 == 0, F.lit("auto")).when(k % 4 == 2, (F.col("o_custkey") % 20).cast("string")).when(k % 4 == 3, F.lit("x"))
    b = F.when(k % 3 == 0, F.concat(F.lit("[3, "), (k % 7).cast("string"), F.lit("]"))).when(k % 3 == 2, F.lit("[4]"))
    d = F.when(k % 5 < 2, (k % 9).cast("string"))
    return table(spark, sf_dir, "orders").select(_k, settings.looks(a, b, d).alias("l")).select(_k, F.col("l.value").alias("looks"), F.col("l.source").alias("source"))


@plan("""with p as (select p_partkey, 100 + p_partkey % 3000 as n, 1 + p_partkey % 6 as tiles, (p_size % 10) / 10.0::double as fraction, (p_size * 10)::bigint as least from part),
  t as (select *, ceil(n::double / tiles) as tile from p), r as (select *, greatest(least, round_even(fraction * tile, 0)::bigint) as asked, greatest(tile - 1, 0)::bigint as most from t)
  select p_partkey, case when tiles > 1 then least(asked, most) else 0 end::bigint as overlap, case when tiles > 1 then asked else 0 end::bigint as requested, tiles > 1 and asked > most as capped from r""")
def tile_overlaps(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    o = settings.axis_overlap(100 + k % 3000, 1 + k % 6, (s % 10) / F.lit(10.0), s * 10)
    return table(spark, sf_dir, "part").select("p_partkey", o.alias("o")).select("p_partkey", "o.*")


@plan("""with a as (select c_custkey, unnest(range(1 + c_custkey % 6)) as i, c_custkey % 2 as up, c_custkey % 11 as odd from customer),
  y as (select c_custkey, i, 10.0::double + c_custkey % 50 + (case when up = 1 then 0.5 else -0.5 end) * i + case when odd = 3 and i = 3 then 0.25 else 0 end as v from a),
  d as (select c_custkey, v - lag(v) over (partition by c_custkey order by i) as d, i, v from y),
  g as (select c_custkey, arg_min(v, i) as a, arg_max(v, i) as b, coalesce(arg_min(d, i) filter (d is not null), -0.001) as s, min(d) as lo, max(d) as hi from d group by 1),
  o as (select *, coalesce(hi - s <= 0.002 * abs(s) and s - lo <= 0.002 * abs(s), true) as regular from g)
  select c_custkey, case when regular then -0.125::double end as west, case when regular then round(case when s > 0 then b else a end + abs(s) / 2, 9) end as north, case when regular then 0.25::double end as dx, case when regular then -abs(s) end::double as dy, case when regular then s > 0 end as flip, regular from o""")
def grid_affines(spark, sf_dir):
    k, i = F.col("c_custkey"), F.col("i")
    n = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0).cast("long"), k.cast("long") % 6)).alias("i"))
    v = 10.0 + k % 50 + F.when(k % 2 == 1, 0.5).otherwise(-0.5) * i + F.when((k % 11 == 3) & (i == 3), 0.25).otherwise(0.0)
    x = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*[F.lit(j).cast("long") for j in range(4)])).alias("i"))
    axes = n.select("c_custkey", F.lit("y").alias("axis"), "i", v.alias("v")).union(x.select("c_custkey", F.lit("x"), "i", i * 0.25))
    return artifacts.grid_transforms(axes, ["c_custkey"]).withColumn("north", F.round("north", 9))


@plan("""with b as (select s_suppkey, (s_suppkey % 40) * 2.5::double - 10 as low, (s_suppkey % 40) * 2.5::double - 10 + (s_suppkey % 7) * 1.25 as high from supplier),
  w as (select s_suppkey, greatest(floor(low) - 2, 0) as a, least(floor(low) + ceil(high - low) + 2, 64) as z from b)
  select s_suppkey, case when z - a >= 2 then a::bigint end as start, case when z - a >= 2 then (z - a)::bigint end as length from w""")
def padded_windows(spark, sf_dir):
    k = F.col("s_suppkey")
    low = (k % 40) * 2.5 - 10
    w = settings.padded_window(low, low + (k % 7) * 1.25, F.lit(64))
    return table(spark, sf_dir, "supplier").select("s_suppkey", w.alias("w")).select("s_suppkey", "w.start", "w.length")


@plan("""with s as (select p_partkey, 64 + (p_partkey * 37) % 4000 as ny, 64 * (1 + p_partkey % 40) as nx from part), f as (select p_partkey, greatest(ny, nx) as side, unnest([2, 4, 8, 16, 32, 64, 128]) as f from s)
  select p_partkey, coalesce(string_agg(f::varchar, ',' order by f) filter (side / (f / 2.0) > 128), '') as factors from f group by 1""")
def overview_levels(spark, sf_dir):
    k = F.col("p_partkey")
    f = settings.overview_factors(64 + (k * 37) % 4000, 64 * (1 + k % 40), 128)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(f.cast("array<string>"), ",").alias("factors"))


@plan("""select o_orderkey, left(sha256('{"date":"' || strftime(o_orderdate, '%Y-%m-%d') || '","kind":"orbit","mission":"S1' || chr((65 + o_orderkey % 2)::int) || '","orbit_type":"precise"}'), 32) as key from orders""")
def request_keys(spark, sf_dir):
    mission = F.concat(F.lit("s1"), F.when(F.col(_k) % 2 == 0, "a").otherwise("b"))
    return table(spark, sf_dir, "orders").select(_k, settings.orbit_request(mission, F.col("o_orderdate")).alias("key"))


@plan("""select l_orderkey, l_linenumber, case when l_linenumber % 5 <> 0 then round(case when l_partkey % 2 = 0 then atan2(l_quantity - 25, l_tax + 0.5) else l_quantity / 10 end + 4 * pi(), 6) end as unw, case when l_linenumber % 5 = 0 then 0 else 1 end::int as label from lineitem""")
def unwrapping_by_truth(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    phase = settings.phase_of(F.when(F.col("l_partkey") % 2 == 0, F.col("l_tax") + 0.5).otherwise(q / 10), F.when(F.col("l_partkey") % 2 == 0, q - 25))
    u = settings.from_truth(phase, F.col("l_linenumber") % 5 == 0, 2.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", u.alias("u")).select("l_orderkey", "l_linenumber", F.round("u.unw", 6).alias("unw"), "u.label")


@plan("""with a as (select o_custkey as stack, o_orderkey as option, o_orderkey % 9 = 0 as dates, o_orderkey % 14 = 0 as bursts from orders)
  select stack, option from a where stack in (select stack from a where dates or bursts)""")
def dropping_alternatives(spark, sf_dir):
    k = F.col(_k)
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stack"), k.alias("option"), F.when(k % 9 == 0, 2).otherwise(0).alias("dates"), F.when(k % 14 == 0, 1).alias("bursts"))
    return artifacts.worth_showing(a, "stack", ["dates", "bursts"]).select("stack", "option")


_FILES = """files as (select l_orderkey as pair, case l_linenumber % 3 when 0 then '' else 'd' || (l_partkey % 10) || '/' end || case when l_linenumber % 4 = 3 then 'deep/' else '' end || 'p' || l_suppkey || case when l_returnflag = 'R' then '_unw_phase.tif' else '_corr.tif' end as path from lineitem)"""


def files(spark, sf_dir):
    n = F.col("l_linenumber")
    below = F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("d"), (F.col("l_partkey") % 10).cast("string"), F.lit("/")))
    path = F.concat(below, F.when(n % 4 == 3, "deep/").otherwise(""), F.lit("p"), F.col("l_suppkey").cast("string"), F.when(F.col("l_returnflag") == "R", "_unw_phase.tif").otherwise("_corr.tif"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), path.alias("path"))


@plan(f"""with {_FILES}, f as (select pair, string_split(path, '/') as parts from files where path like '%\\_unw\\_phase.tif' escape '\\')
  select pair, min(case when len(parts) = 2 then parts[1] else '' end) as folder from f where len(parts) <= 2 group by 1""")
def found_folders(spark, sf_dir):
    return artifacts.product_folders(files(spark, sf_dir), "pair", "_unw_phase.tif")


@plan("""with f as (select l_orderkey as pair, 'p' || l_suppkey || '_dem' || case when l_linenumber % 3 = 1 then '_clip' else '' end || case when l_returnflag = 'N' then '.tif' else '.txt' end as name from lineitem)
  select pair, coalesce(min(name) filter (ends_with(name, '_dem_clip.tif')), min(name) filter (ends_with(name, '_dem.tif'))) as name from f where name like '%.tif' group by 1""")
def clipped_products(spark, sf_dir):
    name = F.concat(F.lit("p"), F.col("l_suppkey").cast("string"), F.lit("_dem"), F.when(F.col("l_linenumber") % 3 == 1, "_clip").otherwise(""), F.when(F.col("l_returnflag") == "N", ".tif").otherwise(".txt"))
    return artifacts.clipped_first(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), name.alias("name")), ["pair"], "_dem")


@plan("""with m as (select o_orderkey, case when o_orderkey % 7 = 0 then '{"stage": "unwr' when o_orderkey % 5 = 0 then '{"bytes": 1}' else '{"stage": "s' || (o_orderkey % 11) || '", "bytes": ' || (o_custkey * 3) || ', "other": [1]}' end as text from orders)
  select 'm' || o_orderkey as path, case when o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0 then text->>'$.stage' end as stage, case when o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0 then (text->>'$.bytes')::bigint end as bytes from m""")
def manifest_records(spark, sf_dir):
    k = F.col(_k)
    whole = F.concat(F.lit('{"stage": "s'), (k % 11).cast("string"), F.lit('", "bytes": '), (F.col("o_custkey") * 3).cast("string"), F.lit(', "other": [1]}'))
    text = F.when(k % 7 == 0, '{"stage": "unwr').when(k % 5 == 0, '{"bytes": 1}').otherwise(whole)
    m = table(spark, sf_dir, "orders").select(F.concat(F.lit("m"), k.cast("string")).alias("path"), text.alias("text"))
    return artifacts.manifests(m, "stage string, bytes bigint", ["stage"]).select("path", "record.stage", "record.bytes")


@plan("""with e as (select 'KB-' || case when c_custkey % 13 = 0 then 'x' else upper(left(c_mktsegment, 4)) end || '-' || lpad((c_custkey % 400)::varchar, 3, '0') as id, c_custkey % 6 = 1 as lacks, case when c_custkey % 5 = 0 then 'KB-' || upper(left(c_mktsegment, 4)) || '-' || lpad(((c_custkey + 1) % 400)::varchar, 3, '0') end as other from customer)
  select distinct id, 'form' as problem from e where not regexp_matches(id, '^KB-[A-Z0-9]+-[0-9]{3}$') union all select distinct id, 'extract' from e where lacks
  union all select id, 'repeated' from e group by id having count(*) > 1 union all select distinct id, 'supersedes' from e where other is not null and other not in (select id from e)""")
def knowledge_problems(spark, sf_dir):
    k, s = F.col("c_custkey"), F.upper(F.left("c_mktsegment", F.lit(4)))
    name = lambda engine, n: F.concat_ws("-", F.lit("KB"), engine, F.lpad((n % 400).cast("string"), 3, "0"))
    e = table(spark, sf_dir, "customer").select(
        name(F.when(k % 13 == 0, "x").otherwise(s), k).alias("id"), F.when(k % 6 == 1, r"error (?P<code>\d+)").otherwise(r"(?P<file>\S+) lost at (?P<line>\d+)").alias("pattern"),
        F.array(F.when(k % 6 == 1, "line").otherwise("file")).alias("extract"), F.when(k % 5 == 0, F.array(name(s, k + 1))).alias("supersedes"),
    )
    return artifacts.entry_problems(e)


@plan("""select s.o_orderkey, (100 + s.o_custkey % 3) as ny, (200 + s.o_custkey % 2) as nx, (100 + c_nationkey % 3) as expected_ny, 200::bigint as expected_nx from orders s join customer on c_custkey = s.o_custkey
  where s.o_custkey % 3 <> c_nationkey % 3 or s.o_custkey % 2 <> 0""")
def mismatched_grids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stacks = o.select(_k, (100 + F.col("o_custkey") % 3).alias("ny"), (200 + F.col("o_custkey") % 2).alias("nx"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (100 + F.col("c_nationkey") % 3).alias("ny"))
    return artifacts.grid_mismatches(stacks, o.join(c, "o_custkey").select(_k, "ny", F.lit(200).cast("long").alias("nx")), _k)


@plan("""with s as (select l_orderkey, l_linenumber, max(l_quantity)::double as coherence from lineitem group by 1, 2), u as (select l_orderkey, l_linenumber, round(sum(l_extendedprice), 2)::double as unw from lineitem where l_returnflag <> 'N' group by 1, 2)
  select l_orderkey, l_linenumber, coherence, unw from s left join u using (l_orderkey, l_linenumber)""")
def attached_layers(spark, sf_dir):
    li, k = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    s = li.groupBy(*k).agg(F.max("l_quantity").cast("double").alias("coherence")).withColumn("unw", F.lit(0.0))
    u = li.where("l_returnflag <> 'N'").groupBy(*k).agg(F.round(F.sum("l_extendedprice"), 2).cast("double").alias("unw"))
    return artifacts.attached(s, u, k, ["unw"])
