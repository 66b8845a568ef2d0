"""Pipeline runs over the tables: a customer is a run of all stages, an order a folder whose lines are steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orbits, runs
from ..operators.frames import cut
from .registry import plan, table

_L = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::varchar[]"
_REG = ", ".join(f"({k}, '{n}', {_L(i)}, {_L(o)}, {_L(out)})" for k, (n, i, o, out, _, _) in enumerate(runs.STAGES))

NODES = f"""reg(position, stage, inputs, optional_inputs, outputs) as (values {_REG}),
  nodes as (select c_custkey as run, reg.*, (stage = 'validate' and c_custkey % 3 = 0) or (stage = 'multilook' and c_custkey % 4 = 0) or (stage = 'coregister' and c_custkey % 5 = 0) as skipped,
      position = c_custkey % 13 as forced, (c_custkey + position) % 7 <> 0 or c_custkey % 2 = 0 as fresh from customer, reg),
  asked as (select run, position, unnest(inputs) as name, true as required from nodes union all select run, position, unnest(optional_inputs), false from nodes),
  made as (select run, position as pos, unnest(outputs) as name from nodes where not skipped),
  prod as (select a.run, a.position, a.name, a.required, max(pos) as producer from asked a left join made m on m.run = a.run and m.name = a.name and m.pos < a.position group by 1, 2, 3, 4)"""


def nodes(spark, sf_dir):
    k, p = F.col("run"), F.col("position")
    all_stages = F.broadcast(runs.registry(spark))  # a dozen rows
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run")).crossJoin(all_stages)
    skipped = ((F.col("stage") == "validate") & (k % 3 == 0)) | ((F.col("stage") == "multilook") & (k % 4 == 0)) | ((F.col("stage") == "coregister") & (k % 5 == 0))
    return n.withColumns({"skipped": skipped, "forced": p == k % 13, "fresh": ((k + p) % 7 != 0) | (k % 2 == 0)})


@plan(f"with {NODES} select run, cast(position as int) as position, name, required, cast(producer as int) as producer from prod")
def stage_producers(spark, sf_dir):
    return runs.producers(nodes(spark, sf_dir))


STATUS = f"""recursive {NODES},
  e as (select run, position, bool_or(required and producer is null) as lacks, list(producer) filter (producer is not null) as froms, list(producer) filter (required and producer is not null) as needs from prod group by 1, 2),
  n as (select nodes.*, coalesce(lacks, false) as lacks, coalesce(froms, []) as froms, coalesce(needs, []) as needs from nodes left join e using (run, position)),
  st(run, position, status, due, stuck) as (
    select run, -1, '', []::integer[], []::integer[] from n where position = 0
    union all
    select run, position, status, case when status = 'to_run' then list_append(due, position) else due end, case when status = 'blocked' then list_append(stuck, position) else stuck end from (
      select n.run, n.position, st.due, st.stuck, case when skipped then 'skipped' when lacks or list_has_any(needs, st.stuck) then 'blocked' when forced or not fresh or list_has_any(froms, st.due) then 'to_run' else 'cached' end as status
      from st join n on n.run = st.run and n.position = st.position + 1)),
  status as (select run, position, stage, status from st join nodes using (run, position))"""


@plan(f"with {STATUS} select run, cast(position as int) as position, stage, status from status")
def stage_statuses(spark, sf_dir):
    return runs.statuses(nodes(spark, sf_dir), len(runs.STAGES)).select("run", "position", "stage", "status")


@plan(f"""with {STATUS} select run, count(*) filter (status = 'cached') as n_cached, count(*) filter (status = 'to_run') as n_to_run, count(*) filter (status = 'blocked') as n_blocked, count(*) filter (status = 'skipped') as n_skipped,
    coalesce(sum(case when status = 'to_run' then 10.0 * (position + 1) end), 0)::double as time_s, coalesce(sum(case when status = 'to_run' then 0.5 * (run % 4) end), 0)::double as disk_gb, coalesce(max(case when status = 'to_run' then (position * 3) % 7 + 1.0 end), 0)::double as rss_gb
  from status group by 1""")
def run_plan(spark, sf_dir):
    p, k = F.col("position"), F.col("run")
    n = runs.statuses(nodes(spark, sf_dir), len(runs.STAGES)).withColumns({"time_s": 10.0 * (p + 1), "disk_gb": 0.5 * (k % 4), "rss_gb": (p * 3) % 7 + 1.0})
    return runs.dry_run(n)


@plan(f"""with {NODES}, c as (select run, position, stage, (run * (position + 3)) % 5 as computed from nodes)
  select run, arg_max(stage, (computed, -position)) as stage, max(computed) as computed from c group by 1""")
def run_pair_counts(spark, sf_dir):
    return runs.pair_summary(nodes(spark, sf_dir).withColumn("computed", (F.col("run") * (F.col("position") + 3)) % 5))


def steps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("folder"), F.col("l_linenumber").alias("order")).agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("code")).withColumn("step", F.concat(F.lit("s"), F.col("order").cast("string")))


_STEPS = """steps as (select l_orderkey as folder, l_linenumber as "order", max(case when l_returnflag = 'R' then 1 else 0 end) as code, 's' || l_linenumber as step from lineitem group by 1, 2, 4)"""


@plan(f"""with {_STEPS} select folder, step from steps where not (("order" + folder) % 3 = 0)""")
def pending_steps(spark, sf_dir):
    s = steps(spark, sf_dir)
    return runs.pending(s, s.where("(`order` + folder) % 3 = 0")).select("folder", "step")


@plan(f"""with {_STEPS}, b as (select folder, min(case when step = 's2' then "order" end) as a, min(case when step = 's' || (2 + folder % 3) then "order" end) as z from steps group by 1)
  select folder, step from steps join b using (folder) where "order" >= coalesce(a, 0) and "order" <= coalesce(z, "order")""")
def step_window(spark, sf_dir):
    last = F.concat(F.lit("s"), (2 + F.col("folder") % 3).cast("string"))
    return runs.sub_range(steps(spark, sf_dir), F.lit("s2"), last).select("folder", "step")


@plan(f"""with {_STEPS} select folder, min("order") as "order", 's' || min("order") as job, cast(1 as int) as code from steps where code <> 0 group by 1""")
def first_failed_jobs(spark, sf_dir):
    return runs.first_failed(steps(spark, sf_dir).withColumn("job", F.col("step")))


@plan("""with f as (select l_orderkey as pair, l_returnflag as name, max(cast(l_quantity as bigint)) as bytes from lineitem group by 1, 2), e as (select distinct l_orderkey as pair, unnest(['A', 'N', 'X']) as name from lineitem)
  select pair, name, coalesce(bytes, 0) as bytes, bytes is not null as "exists" from e left join f using (pair, name)""")
def file_inventory(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("pair", F.col("l_orderkey"))
    expected = li.select("pair").distinct().select("pair", F.explode(F.array(*[F.lit(x) for x in "ANX"])).alias("name"))
    return runs.inventory(expected, li.select("pair", F.col("l_returnflag").alias("name"), F.col("l_quantity").cast("long").alias("bytes")), ["pair", "name"]).select("pair", "name", "bytes", "exists")


@plan("""with c as (select distinct l_suppkey as folder, 'w' || l_suppkey || '/s' || l_linenumber || '/f' as path from lineitem),
  p as (select distinct l_suppkey as folder, case l_suppkey % 3 when 0 then 'w' || l_suppkey || '/s2' else 'w' || l_suppkey || '/s3/f/deep' end as path from lineitem where l_suppkey % 3 < 2)
  select folder, path from c where not exists (select 1 from p where p.folder = c.folder and (c.path = p.path or starts_with(c.path, p.path || '/') or starts_with(p.path, c.path || '/')))""")
def cleanup_paths(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_suppkey")
    w = F.concat(F.lit("w"), k.cast("string"))
    c = li.select(k.alias("folder"), F.concat(w, F.lit("/s"), F.col("l_linenumber").cast("string"), F.lit("/f")).alias("path")).distinct()
    p = li.where(k % 3 < 2).select(k.alias("folder"), F.when(k % 3 == 0, F.concat(w, F.lit("/s2"))).otherwise(F.concat(w, F.lit("/s3/f/deep"))).alias("path")).distinct()
    return runs.cleanup_targets(c, p)


def _vector(t, x, y, z, vx, vy, vz):
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(("t", "x", "y", "z", "vx", "vy", "vz"), (t, x, y, z, vx, vy, vz), strict=True)])


def arcs(spark, sf_dir):
    """Straight arcs: positions move with one velocity, so times and baselines have a closed form."""
    k = F.col("o_orderkey")
    zero, o = F.lit(0.0), table(spark, sf_dir, "orders")
    vy, vz = 7000.0 + k % 11, 300.0 - k % 7

    def pair(x, y0, z0):
        return _vector(zero, x, y0, z0, zero, vy, vz), _vector(zero + 10.0, x, y0 + 10 * vy, z0 + 10 * vz, zero, vy, vz)

    a, b = pair(700_000.0 + k % 13, (k % 17) * -1000.0, (k % 5) * 10.0)
    c, d = pair(700_100.0 + k % 19, (k % 23) * -1000.0, (k % 3) * 50.0)
    t = F.struct(F.lit(0.0).alias("x"), (20_000.0 + k % 29).alias("y"), F.lit(500.0).alias("z"))
    return o.select("o_orderkey", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), t.alias("target"))


_ARCS = """arcs as (select o_orderkey, 7000.0::double + o_orderkey % 11 as vy, 300.0::double - o_orderkey % 7 as vz, 700000.0::double + o_orderkey % 13 as x, (o_orderkey % 17) * -1000.0::double as y, (o_orderkey % 5) * 10.0::double as z,
    700100.0::double + o_orderkey % 19 as x2, (o_orderkey % 23) * -1000.0::double as y2, (o_orderkey % 3) * 50.0::double as z2, 20000.0::double + o_orderkey % 29 as ty, 500.0::double as tz from orders),
  hits as (select *, ((ty - y) * vy + (tz - z) * vz) / (vy * vy + vz * vz) as t, ((ty - y2) * vy + (tz - z2) * vz) / (vy * vy + vz * vz) as t2 from arcs),
  pos as (select *, x as px, y + t * vy as py, z + t * vz as pz, x2 - x as bx, y2 + t2 * vy - y - t * vy as bby, z2 + t2 * vz - z - t * vz as bz, sqrt(vy * vy + vz * vz) as v from hits),
  look as (select *, px / l as lx, (py - ty) / l as ly, (pz - tz) / l as lz from (select *, sqrt(px * px + pow(py - ty, 2) + pow(pz - tz, 2)) as l from pos)),
  nrm as (select *, (vy * lz - vz * ly) / v as nx, vz / v * lx as ny, -vy / v * lx as nz from look)"""


@plan(f"with {_ARCS} select o_orderkey, round(t, 4) as t_ref, round(t2, 4) as t_sec from hits")
def zero_doppler_times(spark, sf_dir):
    x = arcs(spark, sf_dir)
    t = lambda p, q: F.round(orbits.zero_doppler(F.col(p), F.col(q), F.col("target")), 4)
    return x.select("o_orderkey", t("a", "b").alias("t_ref"), t("c", "d").alias("t_sec"))


@plan(f"""with {_ARCS} select o_orderkey, round((bx * nx + bby * ny + bz * nz) / sqrt(nx * nx + ny * ny + nz * nz), 3) as perpendicular, round(bx * lx + bby * ly + bz * lz, 3) as parallel, round(sqrt(bx * bx + bby * bby + bz * bz), 3) as total from nrm""")
def orbit_baselines(spark, sf_dir):
    x = arcs(spark, sf_dir)
    t = lambda p, q: orbits.zero_doppler(F.col(p), F.col(q), F.col("target"))
    x = cut(x.withColumn("t_ref", t("a", "b")).withColumn("t_sec", t("c", "d")))  # or the halvings are worked out again at every use
    return orbits.with_baseline(x, "a", "b", "c", "d", "target", "t_ref", "t_sec", "m").select("o_orderkey", *[F.round(f"m.{n}", 3).alias(n) for n in ("perpendicular", "parallel", "total")])
