"""Precheck rules over lines: a supplier is a stack, a shipping month an acquisition date, a part group a burst."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network as nw
from ..operators import rules
from .registry import plan, table

REC = """rec as (select l_suppkey as stack, 1 + (l_suppkey + case when l_suppkey % 9 = 0 then l_linenumber % 2 else 0 end) % 175 as track,
    case when l_suppkey % 2 = 0 then 'ASCENDING' when l_suppkey % 11 = 0 and l_returnflag = 'R' then 'ASCENDING' else 'DESCENDING' end as direction,
    case when l_suppkey % 13 = 0 and l_linestatus = 'O' then 'EW' else 'IW' end as mode, 'IW' || (1 + l_partkey % 2) as subswath,
    case l_suppkey % 5 when 0 then 'VH' when 1 then 'VV+VH' when 2 then 'hh/hv' else 'VV' end as pol, cast(date_trunc('month', l_shipdate) as date) as date, l_partkey % 4 as burst,
    case when l_suppkey % 7 = 0 then '003.' || (l_linenumber % 2) else '00' || (3 + l_linenumber % 2 * (l_suppkey % 2)) || '.31' end as ipf,
    2.3 + case when l_suppkey % 6 = 0 then l_tax * 3 else 0 end as rg_spacing, case when l_suppkey % 8 = 1 then 0 else 14.0 end as az_spacing, case when l_discount > 0.095 and l_suppkey % 3 = 0 then 1 else 0 end as missing_lines, 30.0 + l_suppkey % 16 as incidence from lineitem),
  own_dates as (select distinct stack, date from rec union select distinct stack, date '1991-01-01' from rec where stack % 5 = 2),
  own_bursts as (select distinct stack, burst from rec where not (stack % 7 = 3 and burst = 3)),
  stk as (select stack, 1 + stack % 175 as track, case when stack % 2 = 0 then 'ASCENDING' else 'DESCENDING' end as direction, min(pol) as pol,
    round(least(1.0, count(distinct burst) * 0.25 * (1 - (stack % 4) * 0.2)), 6) as coverage, count(distinct burst) as n_bursts, count(distinct date) as n_dates, case when stack % 3 = 0 then null else stack % 90 - 30.0 end as lat from rec group by stack),
  d as (select stack, date, case when stack % 10 = 0 then null else max(rg_spacing) * 10 + month(date) * 20.0 end as bperp from rec group by 1, 2),
  pairs as (select a.stack, a.date as ref, b.date as sec, cast(datediff('day', a.date, b.date) as bigint) as dt_days, b.bperp - a.bperp as bperp from d a join d b on a.stack = b.stack and a.date < b.date and datediff('day', a.date, b.date) <= 62)"""


def inputs(spark, sf_dir):
    k = F.col("l_suppkey")
    li = table(spark, sf_dir, "lineitem")
    rec = li.select(
        k.alias("stack"), (1 + (k + F.when(k % 9 == 0, F.col("l_linenumber") % 2).otherwise(0)) % 175).alias("track"),
        F.when(k % 2 == 0, "ASCENDING").when((k % 11 == 0) & (F.col("l_returnflag") == "R"), "ASCENDING").otherwise("DESCENDING").alias("direction"),
        F.when((k % 13 == 0) & (F.col("l_linestatus") == "O"), "EW").otherwise("IW").alias("mode"), F.concat(F.lit("IW"), (1 + F.col("l_partkey") % 2).cast("string")).alias("subswath"),
        F.when(k % 5 == 0, "VH").when(k % 5 == 1, "VV+VH").when(k % 5 == 2, "hh/hv").otherwise("VV").alias("pol"), F.to_date(F.trunc("l_shipdate", "month")).alias("date"), (F.col("l_partkey") % 4).alias("burst"),
        F.when(k % 7 == 0, F.concat(F.lit("003."), (F.col("l_linenumber") % 2).cast("string"))).otherwise(F.concat(F.lit("00"), (3 + F.col("l_linenumber") % 2 * (k % 2)).cast("string"), F.lit(".31"))).alias("ipf"),
        (2.3 + F.when(k % 6 == 0, F.col("l_tax") * 3).otherwise(0.0)).alias("rg_spacing"), F.when(k % 8 == 1, 0.0).otherwise(14.0).alias("az_spacing"),
        F.when((F.col("l_discount") > 0.095) & (k % 3 == 0), 1).otherwise(0).alias("missing_lines"), (30.0 + k % 16).alias("incidence"),
    )
    s = F.col("stack")
    stk = rec.groupBy("stack").agg(F.min("pol").alias("pol"), F.count_distinct("burst").alias("n_bursts"), F.count_distinct("date").alias("n_dates")).select(
        "stack", (1 + s % 175).alias("track"), F.when(s % 2 == 0, "ASCENDING").otherwise("DESCENDING").alias("direction"), "pol",
        F.round(F.least(F.lit(1.0), F.col("n_bursts") * 0.25 * (1 - (s % 4) * 0.2)), 6).alias("coverage"), "n_bursts", "n_dates", F.when(s % 3 != 0, s % 90 - 30.0).alias("lat"),
    )
    b = F.when(s % 10 != 0, F.max("rg_spacing") * 10 + F.month("date") * 20.0)
    pairs = nw.build_pairs(rec.groupBy("stack", "date").agg(b.alias("bperp")), ["stack"], max_days=62, max_perp_m=1e9)
    dates = rec.select("stack", "date").union(stk.where("stack % 5 = 2").select("stack", F.to_date(F.lit("1991-01-01")))).distinct()
    return rules.Inputs(stk, rec, pairs, dates, rec.select("stack", "burst").where("not (stack % 7 = 3 and burst = 3)").distinct())


KEY = "cast(stack as varchar) || ':' || strftime(ref, '%Y%m%d') || '_' || strftime(sec, '%Y%m%d')"
_S = lambda months: f"month(ref) in {months} "
_NORTH = "(lat is null or lat >= 0)"


def _season(d: str) -> str:
    m = f"case when {_NORTH} then month({d}) else (month({d}) + 5) % 12 + 1 end"
    return f"case when {m} in (11, 12, 1, 2, 3) then 'snow' when {m} in (5, 6, 7, 8, 9) then 'leaf_on' else 'transition' end"


def _several(rule: str, column: str) -> str:
    return f"""select stack, cast(stack as varchar), '{rule}', 'FAIL', string_agg(v, ', ' order by v) from (select distinct stack, cast({column} as varchar) as v from rec union select stack, cast({column} as varchar) from stk) group by stack having count(*) > 1"""


LOOKS = """spc as (select stack, median(rg_spacing) / sin(radians(any_value(incidence))) as rg, median(az_spacing) as az from rec where rg_spacing > 0 and az_spacing > 0 group by 1),
  grid as (select stack, rg, az, r.n as n_rg, a.n as n_az, rg * r.n as p, az * a.n as q from spc, (select unnest(generate_series(1, 80)) as n) r, (select unnest(generate_series(1, 20)) as n) a where r.n <= greatest(1, ceil(120 / rg) + 1) and a.n <= greatest(1, ceil(120 / az) + 1)),
  looks as (select stack, arg_min(n_rg, (abs(sqrt(p * q) - 30), n_rg * n_az, greatest(p, q) / least(p, q), n_rg, n_az)) as n_rg, arg_min(n_az, (abs(sqrt(p * q) - 30), n_rg * n_az, greatest(p, q) / least(p, q), n_rg, n_az)) as n_az from grid where greatest(p, q) / least(p, q) <= 2 group by 1)"""

FOUND = f"""{REC}, {LOOKS}, found(stack, scope, rule, severity, detail) as (
  select cast(null as bigint), direction, 'SEL-01', 'INFO', cast(count(distinct track) as varchar) from stk group by direction having count(distinct track) >= 2
  union all {_several('SEL-01', 'track')} union all {_several('SEL-02', 'direction')}
  union all select m.stack, cast(m.stack as varchar), 'SEL-03', 'FAIL', modes || '/' || n_layouts from (select stack, string_agg(distinct mode, ', ' order by mode) as modes, count(distinct mode) as n_modes from rec group by 1) m
    join (select stack, count(distinct layout) as n_layouts from (select stack, date, string_agg(distinct subswath, ', ' order by subswath) as layout from rec group by 1, 2) group by 1) l using (stack) where n_modes > 1 or n_layouts > 1
  union all select stack, cast(stack as varchar), 'SEL-04', case when n_bursts = 0 or coverage <= 0 then 'FAIL' else 'WARN' end, cast(cast(coverage as double) as varchar) from stk where coverage < 0.9
  union all select stack, cast(stack as varchar), 'SEL-05', 'FAIL', string_agg(distinct pol, ', ' order by pol) from rec group by stack having not bool_and(pol in ('VV+VH', 'hh/hv', 'VV'))
  union all select stack, {KEY}, 'SEL-06', 'WARN', cast(round(abs(bperp), 3) as varchar) from pairs where abs(bperp) > 150
  union all select stack, cast(stack as varchar), 'SEL-06', 'INFO', cast(count(*) as varchar) from pairs group by stack having count(bperp) = 0
  union all select stack, {KEY}, 'SEL-07', 'WARN', cast(dt_days as varchar) from pairs where dt_days > 48
  union all select stack, cast(stack as varchar), 'SEL-07', 'INFO', cast(count(*) as varchar) from (select p.stack, {_season('ref')} as a, {_season('sec')} as b from pairs p join stk using (stack)) where (a = 'snow' and b = 'leaf_on') or (a = 'leaf_on' and b = 'snow') group by stack
  union all select stack, cast(stack as varchar), 'SEL-08', 'INFO', string_agg(distinct ipf, ', ' order by ipf) from rec group by stack having count(distinct regexp_extract(ipf, '^\\s*(\\d+)', 1)::int) > 1
  union all select stack, cast(stack as varchar), 'SEL-09', 'WARN', cast(cast(round(w, 6) as double) as varchar) from (select stack, greatest((max(rg_spacing) - min(rg_spacing)) / median(rg_spacing), (max(az_spacing) - min(az_spacing)) / median(az_spacing)) as w, count(*) as n from rec where rg_spacing > 0 and az_spacing > 0 group by 1) where n >= 2 and w > 0.05
  union all select stack, cast(stack as varchar), 'SEL-09', 'INFO', n_rg || 'x' || n_az from looks union all select stack, cast(stack as varchar), 'SEL-09', 'INFO', '' from stk where stack not in (select stack from looks)
  union all select stack, cast(stack as varchar), 'SEL-10', 'WARN', cast(count(*) as varchar) from (select o.stack, o.date, (select count(distinct r.burst) from rec r join own_bursts b on b.stack = r.stack and b.burst = r.burst where r.stack = o.stack and r.date = o.date) as n,
      (select max(missing_lines) from rec r where r.stack = o.stack and r.date = o.date) as lines, (select count(*) from own_bursts b where b.stack = o.stack) as expected from own_dates o) where n <> expected or lines > 0 group by stack)"""


@plan(f"with {FOUND} select * from found")
def precheck_findings(spark, sf_dir):
    return rules.precheck(inputs(spark, sf_dir))


COUNTS = f"{FOUND}, counts as (select s.stack, count(*) filter (severity = 'FAIL') as n_fail, count(*) filter (severity = 'WARN') as n_warn, count(*) filter (severity = 'INFO') as n_info from stk s left join found f on f.stack = s.stack group by 1)"


@plan(f"with {COUNTS} select * from counts")
def precheck_severities(spark, sf_dir):
    x = inputs(spark, sf_dir)
    return rules.severity_counts(rules.precheck(x), x.stacks)


@plan(f"with {COUNTS} select stack, cast(coverage as double) as coverage, n_dates, n_warn from stk join counts using (stack) where n_fail = 0 order by coverage desc, n_dates desc, n_warn, stack limit 1")
def precheck_recommendation(spark, sf_dir):
    x = inputs(spark, sf_dir)
    return rules.recommended(x.stacks, rules.severity_counts(rules.precheck(x), x.stacks)).select("stack", "coverage", "n_dates", "n_warn")


@plan(f"""with {FOUND}, n as (select *, row_number() over (order by case severity when 'FAIL' then 0 when 'WARN' then 1 else 2 end, rule, scope, detail) as place from found where stack is not null and not (severity = 'WARN' and rule in ('SEL-06', 'SEL-07')))
  select place, stack, scope, rule, severity from n""")
def precheck_ordered(spark, sf_dir):
    """Findings about whole stacks in order of severity and rule: a running number over range partitions of that order."""
    from ..operators.storage import numbered

    f = rules.precheck(inputs(spark, sf_dir)).where("stack is not null and not (severity = 'WARN' and rule in ('SEL-06', 'SEL-07'))")
    f = f.withColumn("level", rules.severity_rank(F.col("severity")))
    return numbered(f, ["level", "rule", "scope", "detail"], "place").select("place", "stack", "scope", "rule", "severity")
