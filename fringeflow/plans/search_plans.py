"""Catalogue queries and synthetic stacks over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as cat
from ..operators import estimators as est
from ..sources import records, synthetic
from .registry import plan, table

_SCENES = """scenes as (select o_orderkey as id, cast(o_orderdate as date) as day, o_custkey % 5 as track, case o_orderkey % 3 when 0 then 'A' when 1 then 'B' end as platform, case when o_custkey % 4 = 0 then 'SLC' when o_custkey % 4 = 3 then 'GRD' when o_orderkey % 3 = 0 then 'SLC' else 'BURST' end as level,
    case when o_orderkey % 10 = 0 then 'EW' else 'IW' end as mode, case when o_orderkey % 2 = 0 then 'ASCENDING' else 'DESCENDING' end as direction, o_custkey as query from orders)"""


def scenes(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    level = F.when(c % 4 == 0, "SLC").when(c % 4 == 3, "GRD").when(k % 3 == 0, "SLC").otherwise("BURST")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_orderdate").cast("date").alias("day"), (c % 5).alias("track"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").alias("platform"), level.alias("level"),
        F.when(k % 10 == 0, "EW").otherwise("IW").alias("mode"), F.when(k % 2 == 0, "ASCENDING").otherwise("DESCENDING").alias("direction"), c.alias("query"),
    )


@plan(f"with {_SCENES} select id from scenes where day between date '1994-03-01' and date '1996-08-15' and track = 2 and platform in ('A', 'B') and level = 'BURST' and mode = 'IW' and direction = 'DESCENDING'")
def scene_predicates(spark, sf_dir):
    return cat.searched(scenes(spark, sf_dir), first="1994-03-01", last="1996-08-15", direction="desc", track=2, platforms=["A", "B"], level="BURST", mode="IW").select("id")


_BEST = f"""{_SCENES}, r as (select *, case level when 'BURST' then 0 when 'SLC' then 1 end as rank from scenes), b as (select query, min(rank) as rank from r where rank is not null group by 1)"""


@plan(f"with {_BEST} select id, query, level from r join b using (query, rank)")
def level_fallback(spark, sf_dir):
    return cat.best_level(scenes(spark, sf_dir), ["query"], ["BURST", "SLC"]).select("id", "query", "level")


@plan(f"""with {_BEST} select query, case when rank is null then 'FAIL' else 'WARN' end as severity, case when rank is null then 'none' else 'SLC' end as detail from (select distinct query from scenes) left join b using (query) where rank is null or rank > 0""")
def level_findings(spark, sf_dir):
    s = scenes(spark, sf_dir)
    return cat.fallback_findings(s, cat.best_level(s, ["query"], ["BURST", "SLC"]), ["query"])


@plan("""with g as (select l_suppkey, count(*) filter (l_returnflag = 'A') as n1, count(*) filter (l_returnflag <> 'A') as n0, avg(l_quantity) filter (l_returnflag = 'A') as m1, avg(l_quantity) filter (l_returnflag <> 'A') as m0,
    var_samp(l_quantity) filter (l_returnflag = 'A') as v1, var_samp(l_quantity) filter (l_returnflag <> 'A') as v0 from lineitem group by 1)
  select l_suppkey, case when n1 > 1 and n0 > 1 and v1 / n1 + v0 / n0 > 0 then round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 8) end as t,
    case when n1 > 1 and n0 > 1 and v1 / n1 + v0 / n0 > 0 then round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 6) end as dof from g""")
def unequal_variances(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").withColumn("s", F.col("l_returnflag") == "A")
    return est.welch(v, ["l_suppkey"], "s", "l_quantity").withColumns({"t": F.round("t", 8), "dof": F.round("dof", 6)})


_SITES = """sites as (select c_custkey as site, c_custkey % 5 as ok, case when c_custkey % 5 = 1 then 'levelling' else 'gnss' end as kind, c_acctbal as value from customer)"""


@plan(f"with {_SITES} select site, value, kind from sites where ok in (1, 2)")
def both_ground_truths(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.col("c_acctbal").alias("value"))
    of = lambda n, kind: c.where(F.col("site") % 5 == n).withColumn("kind", F.lit(kind))
    return records.combined_ground_truth(of(1, "levelling"), of(2, "gnss"))


@plan()
def linked_synthetic(spark, sf_dir):
    """A block a supplier: 6 epochs of 64 samples, phase a line in time, linked in short stacks."""
    pixels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("sample"))
    z = synthetic.complex_stack(pixels, ["block", "sample"], synthetic.coherence_matrix(6, 8.0, 0.3), F.col("epoch") * 0.4 + F.col("block") % 3, seed=7)
    return est.linked_phase(z, ["block"], "epoch", "re", "im", "sample", "emi", short=3).withColumns({c: F.round(c, 6) for c in ("phase", "quality")})
