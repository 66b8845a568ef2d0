"""Retention, reuse and comparison over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import storage
from .registry import micros, plan, table

ENTRIES = "entries as (select event_id as id, event_type as stage, epoch_us(ts) as finished, cast(round_even(value * 100, 0) as bigint) as size, event_id % 7 <> 0 as ok, event_id % 11 = 0 as orphan from events)"
KEEP, SHARE = 50, 20


def entries(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(k.alias("id"), F.col("event_type").alias("stage"), micros("ts").alias("finished"), F.rint(F.col("value") * 100).cast("long").alias("size"), (k % 7 != 0).alias("ok"), (k % 11 == 0).alias("orphan"))


@plan(f"""with {ENTRIES}, r as (select *, row_number() over (partition by stage, orphan order by finished desc, id desc) as n from entries)
  select id, stage, case when not orphan and n <= {KEEP} then 'kept' else 'aged' end as fate from r""")
def retention_by_count(spark, sf_dir):
    out = storage.retention(entries(spark, sf_dir), KEEP)
    return out.select("id", "stage", F.when(F.col("fate") == "aged", "aged").otherwise("kept").alias("fate"))


@plan(f"""with {ENTRIES}, r as (select *, row_number() over (partition by stage, orphan order by finished desc, id desc) as n, row_number() over (partition by stage, ok, orphan order by finished desc, id desc) as m from entries),
  k as (select *, case when ok and not orphan and m = 1 then 'protected' when not orphan and n <= {KEEP} then 'kept' else 'aged' end as fate from r),
  q as (select id, size, sum(size) over (order by finished, id) as cum from k where fate = 'kept'), t as (select sum(size) - 100000 as excess from k where fate <> 'aged')
  select k.id, stage, case when fate = 'kept' and cum - q.size < excess then 'evicted' else fate end as fate from k left join q using (id), t""")
def retention_by_budget(spark, sf_dir):
    return storage.retention(entries(spark, sf_dir), KEEP, 100000).select("id", "stage", "fate")


@plan(f"""with {ENTRIES}, q as (select *, sum(size) over (order by finished, id) as cum, sum(size) over () as total from entries) select id, stage, size from q where cum - size < total - 1000000""")
def least_recently_finished(spark, sf_dir):
    return storage.least_recent(entries(spark, sf_dir), 1000000).select("id", "stage", "size")


@plan(f"with {ENTRIES} select stage, arg_max(id, (finished, id)) as id from entries where ok and not orphan group by 1")
def newest_good_entry(spark, sf_dir):
    return storage.newest_ok(entries(spark, sf_dir))


@plan(f"with {ENTRIES} select stage, sum(size)::bigint as bytes, count(*) filter (orphan) as n_orphans, coalesce(sum(size) filter (orphan), 0)::bigint as orphan_bytes from entries group by 1")
def size_summary(spark, sf_dir):
    return entries(spark, sf_dir).groupBy("stage").agg(F.sum("size").alias("bytes"), F.count_if("orphan").alias("n_orphans"), F.coalesce(F.sum(F.when(F.col("orphan"), F.col("size"))), F.lit(0).cast("long")).alias("orphan_bytes"))


@plan("""with w as (select o_orderkey as pair, sha256(cast(o_custkey as varchar) || ':' || o_orderstatus)[1:32] as identity from orders), d as (select o_orderkey as pair, sha256(cast(o_custkey as varchar) || ':' || case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end)[1:32] as identity from orders where o_orderpriority <> '1-URGENT')
  select w.pair, case when d.pair is not null then 'reused' else 'to_run' end as state from w left join d on d.pair = w.pair and d.identity = w.identity""")
def incremental_reuse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ident = lambda s: F.substring(F.sha2(F.concat(F.col("o_custkey").cast("string"), F.lit(":"), s), 256), 1, 32).alias("identity")
    wanted = o.select(F.col("o_orderkey").alias("pair"), ident(F.col("o_orderstatus")))
    done = o.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("pair"), ident(F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))))
    have, todo = storage.reuse(wanted, done, ["pair"], "identity")
    return have.select("pair", F.lit("reused").alias("state")).unionByName(todo.select("pair", F.lit("to_run").alias("state")))


@plan("""with b as (select l_suppkey as stage, 'n' || l_linenumber as quantity, round(sum(l_quantity), 2) as v from lineitem where l_returnflag <> 'R' group by 1, 2), a as (select l_suppkey as stage, 'n' || l_linenumber as quantity, round(sum(l_quantity), 2) as v from lineitem where l_returnflag <> 'A' or l_linenumber < 3 group by 1, 2)
  select stage, quantity, b.v as before, a.v as after, case when a.v is null then 'missing' when b.v is null then 'extra' when a.v = b.v then 'same' else 'changed' end as state from b full join a using (stage, quantity)""")
def document_difference(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("quantity", F.concat(F.lit("n"), F.col("l_linenumber").cast("string")))
    per = lambda d: d.groupBy(F.col("l_suppkey").alias("stage"), "quantity").agg(F.round(F.sum("l_quantity"), 2).alias("v"))
    return storage.outer_difference(per(li.where("l_returnflag <> 'R'")), per(li.where("l_returnflag <> 'A' or l_linenumber < 3")), ["stage", "quantity"], "v")


@plan("""select r_regionkey, a.v as alpha, b.v as beta, cast((row_number() over (partition by r_regionkey order by a.i, b.i)) as bigint) as point from region, (values (0, 0.1::double), (1, 0.5::double), (2, 0.9::double)) a(i, v), (values (0, 'x'), (1, 'y')) b(i, v)""")
def parameter_grid(spark, sf_dir):
    """All combinations of parameter values, the first key slowest."""
    a = F.posexplode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("i", "alpha")
    g = table(spark, sf_dir, "region").select("r_regionkey", a).select("*", F.posexplode(F.array(F.lit("x"), F.lit("y"))).alias("j", "beta"))
    return g.select("r_regionkey", "alpha", "beta", (F.col("i") * 2 + F.col("j") + 1).cast("long").alias("point"))
