"""Templates, versions, nested settings and footprints over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import footprints as fp
from ..functions import templates as tp
from ..operators import runs
from .registry import plan, table


@plan("""select n_nationkey, case when n_nationkey % 4 = 3 then 'rule.none' when n_nationkey % 3 = 0 then n_name || ': ' || n_nationkey || '건 {more}' else 'Stack ' || n_name || ' has ' || n_nationkey || ' of {what} {' end as text from nation""")
def message_texts(spark, sf_dir):
    k = F.col("n_nationkey")
    said = F.create_map(*[F.lit(x) for x in ("ko/rule.a", "{name}: {n}건 {more}", "en/rule.a", "Stack {name} has {n} of {what} {")])
    lang = F.when(k % 3 == 0, "ko").when(k % 3 == 1, "en").otherwise("de")
    params = F.create_map(F.lit("name"), F.col("n_name"), F.lit("n"), k.cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", tp.message(said, F.when(k % 4 == 3, "rule.none").otherwise("rule.a"), lang, params).alias("text"))


@plan("""with v as (select p_partkey, p_size as a, p_partkey % 10 as b, p_partkey % 5 as s from part)
  select p_partkey, case s when 0 then (a, b) >= (10, 0) and (a, b) < (20, 5) when 1 then a = 5 and b = 3 when 2 then not (a = 7 and b = 0) when 3 then true end as ok from v""")
def version_checks(spark, sf_dir):
    k = F.col("p_partkey")
    version = F.when(k % 5 == 4, "unknown").otherwise(F.concat(F.lit("tool v"), F.col("p_size").cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("-dev")))
    spec = F.when(k % 5 == 0, ">=10, <20.5").when(k % 5 == 1, "==5.3").when(k % 5 == 2, "!=7.0.0").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", tp.satisfies(version, spec).alias("ok"))


@plan("""select event_id, 'a.b=1;a.c.d=' || case when event_id % 2 = 0 then '5' else cast(event_id as varchar) end || case when event_id % 2 = 0 then ';s={}' else '' end || ';x=y' || case when event_id % 2 = 0 then ';z=[1,2]' else '' end as flat,
    case when event_id % 2 = 0 then 'a.c.d,z' else 'a.c.d' end as found from events""")
def nested_settings(spark, sf_dir):
    base = F.concat(F.lit('{"a":{"b":1,"c":{"d":'), F.col("event_id").cast("string"), F.lit('}},"x":"y"}'))
    over = F.when(F.col("event_id") % 2 == 0, F.lit('{"a":{"c":{"d":5}},"z":[1,2],"s":{}}')).otherwise(F.lit("{}"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    keys = F.array_sort(F.array_union(tp.forbidden(base, ["d", "z"]), tp.forbidden(over, ["d", "z"])))
    return table(spark, sf_dir, "events").select("event_id", tp.merged([base, over]).alias("m"), F.array_join(keys, ",").alias("found")).select("event_id", shown.alias("flat"), "found")


@plan("""with t as (select o_orderkey, cast(o_orderkey % 90 as double) as x, cast(o_orderkey % 45 as double) as y, 1 + o_orderkey % 3 as w, 2 + o_orderkey % 5 as h, o_orderkey % 8 = 7 as broken from orders)
  select o_orderkey, case when not broken then round(w * h / 2.0, 6) end as area, case when not broken then round(x + w / 3.0, 6) end as lon, case when not broken then round(y + h / 3.0, 6) end as lat,
    case when not broken then round(x - 0.1::double, 2) end as west, case when not broken then round(y + h + 0.1::double, 2) end as north from t""")
def footprint_shapes(spark, sf_dir):
    k = F.col("o_orderkey")
    x, y, w, h = (k % 90).cast("double"), (k % 45).cast("double"), 1 + k % 3, 2 + k % 5
    point = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    text = F.concat(F.lit("Polygon (("), F.concat_ws(", ", point(x, y), point(x, y + h), point(x + w, y), point(x, y)), F.lit("))"))
    ring = fp.outer_ring(F.when(k % 8 == 7, F.lit("POLYGON EMPTY")).otherwise(text))
    o = table(spark, sf_dir, "orders").select("o_orderkey", ring.alias("ring"))
    c, b = fp.centroid(F.col("ring")), fp.box(F.col("ring"), 0.1, 2)
    area = F.round(F.abs(fp.signed_area(F.col("ring"))), 6)
    return o.select("o_orderkey", F.when(F.col("ring").isNotNull(), area).alias("area"), F.round(c["x"], 6).alias("lon"), F.round(c["y"], 6).alias("lat"), b["w"].alias("west"), b["n"].alias("north"))


@plan("""with a as (select s_suppkey as id from supplier), gone as (select s_suppkey + 1 as id from supplier where s_suppkey % 3 = 0), both_files as (select id from a union all select id from a where id % 2 = 0)
  select id, count(*) as n from both_files where id not in (select id from gone) group by 1""")
def superseded_removed(spark, sf_dir):
    """Bag union of two files, without the ids that another replaces."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    gone = a.where("id % 3 = 0").select((F.col("id") + 1).alias("id"))
    return runs.superseded_removed(a.unionByName(a.where("id % 2 = 0")), gone, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@plan("""select o_orderkey, case when o_orderkey % 3 = 0 then true when o_orderkey % 3 = 1 then true else false end as inside from orders""")
def finding_scopes(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("T"), k.cast("string"))
    scope = F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat(name, F.lit(":20240101_20240113"))).otherwise(F.concat(name, F.lit("5")))
    return table(spark, sf_dir, "orders").select("o_orderkey", runs.in_scope(scope, name).alias("inside"))
