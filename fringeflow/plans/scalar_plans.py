"""Expressions over the tables: angles, phase, dates, text, hashes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import hashing, masking, text
from ..functions import phase as ph
from ..operators.frames import last_wins_maps
from .registry import micros, plan, table

R6 = lambda c, name: F.round(c, 6).alias(name)


@plan("""select c_custkey, round(atan2(sin(c_acctbal), cos(c_acctbal)), 6) as wrapped,
    round(c_acctbal - round_even(c_acctbal / 360, 0) * 360, 6) as degrees,
    round((c_acctbal + 180) - floor((c_acctbal + 180) / 360) * 360 - 180, 6) as heading,
    cast(round_even(c_acctbal / (2 * pi()), 0) as bigint) as cycles from customer""")
def angle_wrapping(spark, sf_dir):
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", R6(ph.wrap(x), "wrapped"), R6(ph.wrap_degrees(x), "degrees"), R6(ph.wrap_heading(x), "heading"), ph.cycles(x).alias("cycles"))


@plan("""with p as (select p_partkey, 20 + p_size * 0.5 as inc, case when p_partkey % 2 = 0 then -12.0 else 192.0 end as heading, p_retailprice as v from part),
  a as (select *, -(heading - 90) - round_even(-(heading - 90) / 360, 0) * 360 as az from p)
  select p_partkey, round(az, 6) as azimuth, round(-sin(radians(inc)) * sin(radians(az)), 6) as east, round(sin(radians(inc)) * cos(radians(az)), 6) as north,
    round(cos(radians(inc)), 6) as up,
    round(v * -sin(radians(inc)) * sin(radians(az)) + v * 0.5 * sin(radians(inc)) * cos(radians(az)) + v * 0.1 * cos(radians(inc)), 5) as los,
    round(v / cos(radians(inc)), 5) as vertical, round(2.33 / sin(radians(inc)), 6) as ground_range from a""")
def line_of_sight(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        "p_partkey", (20 + F.col("p_size") * 0.5).alias("inc"), F.when(F.col("p_partkey") % 2 == 0, "ASCENDING").otherwise("DESCENDING").alias("dir"), F.col("p_retailprice").alias("v")
    )
    p = p.withColumn("az", ph.look_azimuth(ph.default_heading(F.col("dir")))).withColumn("u", ph.los_vector(F.col("inc"), F.col("az")))
    v = F.col("v")
    return p.select(
        "p_partkey", R6(F.col("az"), "azimuth"), R6(F.col("u.east"), "east"), R6(F.col("u.north"), "north"), R6(F.col("u.up"), "up"),
        F.round(ph.project_los(v, v * 0.5, v * 0.1, F.col("inc"), F.col("az")), 5).alias("los"), F.round(ph.los_to_vertical(v, F.col("inc")), 5).alias("vertical"),
        R6(ph.ground_range(F.lit(2.33), F.col("inc")), "ground_range"),
    )


@plan(f"""with s as (select s_suppkey, 30 + s_suppkey * 0.01 as lat, 120 + s_nationkey * 0.5 as lon, s_acctbal as h from supplier),
  e as (select *, {ph.WGS84_A} / sqrt(1 - {ph.WGS84_F * (2 - ph.WGS84_F)!r} * pow(sin(radians(lat)), 2)) as n from s)
  select s_suppkey, round((n + h) * cos(radians(lat)) * cos(radians(lon)), 3) as x, round((n + h) * cos(radians(lat)) * sin(radians(lon)), 3) as y,
    round((n * (1 - {ph.WGS84_F * (2 - ph.WGS84_F)!r}) + h) * sin(radians(lat)), 3) as z,
    round(2 * {ph.EARTH_RADIUS_M} * asin(sqrt(least(greatest(pow(sin(radians(37.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(37.5)) * pow(sin(radians(127 - lon) / 2), 2), 0), 1))), 3) as distance_m
  from e""")
def geodetic_positions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (30 + F.col("s_suppkey") * 0.01).alias("lat"), (120 + F.col("s_nationkey") * 0.5).alias("lon"), F.col("s_acctbal").alias("h"))
    s = s.withColumn("p", ph.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("h")))
    d = ph.haversine_m(F.col("lat"), F.col("lon"), F.lit(37.5), F.lit(127.0))
    return s.select("s_suppkey", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), F.round("p.z", 3).alias("z"), F.round(d, 3).alias("distance_m"))


@plan(f"""select l_orderkey, l_linenumber, l_partkey, round(case when l_discount <= 0 then pi() / sqrt(3)
      else least(sqrt((1 - l_discount * l_discount) / (2 * l_quantity * l_discount * l_discount)), pi() / sqrt(3)) end, 6) as phase_std,
    round({-4 * math.pi / 0.0555!r} * l_tax * 1000 * l_quantity / (850000 * sin(radians(34))), 6) as topo_phase from lineitem""")
def phase_models(spark, sf_dir):
    c, n = F.col("l_discount"), F.col("l_quantity")
    g2 = c * c
    std = F.when(c <= 0, ph.MAX_PHASE_STD).otherwise(F.least(F.sqrt((1 - g2) / (2 * n * g2)), F.lit(ph.MAX_PHASE_STD)))
    topo = ph.height_to_phase(n, F.col("l_tax") * 1000, 0.0555, 850000.0, F.lit(34.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R6(std, "phase_std"), R6(topo, "topo_phase"))


@plan("""with g as (select p_partkey, p_size * 1.2 as slope, (p_partkey * 7) % 360 as aspect, 30.0 + (p_partkey % 20) as inc from part),
  a as (select *, cos(radians(slope)) * cos(radians(inc)) + sin(radians(slope)) * sin(radians(inc)) * cos(radians(aspect - 102)) as c,
     degrees(atan(tan(radians(slope)) * cos(radians(aspect - 102)))) as t from g),
  b as (select *, degrees(acos(least(greatest(c, -1), 1))) as loc from a)
  select p_partkey, round(loc, 6) as incidence_local, round(t, 6) as range_slope, t > inc as layover, t < inc - 90 as shadow,
    round(case when t > inc then 1.0 else least(greatest(1 - sin(radians(least(greatest(loc, 0), 90))) / sin(radians(inc)), 0), 1) end, 6) as foreshortening,
    cast(case when t > inc and t < inc - 90 then 3 when t < inc - 90 then 2 when t > inc then 1 else 0 end as int) as ls_code from b""")
def terrain_geometry(spark, sf_dir):
    g = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.2).alias("slope"), ((F.col("p_partkey") * 7) % 360).alias("aspect"), (30.0 + F.col("p_partkey") % 20).alias("inc"))
    g = g.withColumn("m", ph.local_geometry(F.col("slope"), F.col("aspect"), F.lit(102.0), F.col("inc")))
    code = F.when(F.col("m.layover") & F.col("m.shadow"), 3).when(F.col("m.shadow"), 2).when(F.col("m.layover"), 1).otherwise(0)
    return g.select("p_partkey", R6(F.col("m.incidence_local"), "incidence_local"), R6(F.col("m.range_slope"), "range_slope"), "m.layover", "m.shadow", R6(F.col("m.foreshortening"), "foreshortening"), code.alias("ls_code"))


_SEASON = "case when {m} in (11, 12, 1, 2, 3) then 'snow' when {m} in (5, 6, 7, 8, 9) then 'leaf_on' else 'transition' end"
_N, _S = _SEASON.format(m="month(d)"), _SEASON.format(m="((month(d) + 5) % 12 + 1)")
_N2 = _SEASON.format(m="month(e)")


@plan(f"""with o as (select o_orderkey, cast(o_orderdate as date) as d, cast(o_orderdate + interval 150 day as date) as e from orders)
  select o_orderkey, {_N} as north, {_S} as south, (({_N}) = 'snow' and ({_N2}) = 'leaf_on') or (({_N}) = 'leaf_on' and ({_N2}) = 'snow') as crosses,
    round(datediff('day', date '1995-01-01', d) / 365.25, 6) as years, strftime(d, '%Y%m%d') || '_' || strftime(e, '%Y%m%d') as pair from o""")
def seasons_and_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")).withColumn("e", F.date_add("d", 150))
    return o.select(
        "o_orderkey", dt.season(F.col("d")).alias("north"), dt.season(F.col("d"), False).alias("south"), dt.crosses_season(F.col("d"), F.col("e")).alias("crosses"),
        R6(dt.year_fraction(F.col("d"), F.to_date(F.lit("1995-01-01"))), "years"), dt.pair_key(F.col("e"), F.col("d")).alias("pair"),
    )


@plan("""with t as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y%m%d') when 2 then ' ' || strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00Z' else o_orderstatus end as s,
      cast(o_orderdate as date) as d from orders)
    select o_orderkey, case when o_orderkey % 4 < 3 then strftime(d, '%Y-%m-%d') end as parsed,
      case when o_orderkey % 4 = 1 then strftime(d, '%Y-%m-%d') end as reference from t""")
def date_parsing(spark, sf_dir):
    iso, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyyMMdd")
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, iso).when(k == 1, key).when(k == 2, F.concat(F.lit(" "), iso, F.lit("T10:00:00Z"))).otherwise(F.col("o_orderstatus"))
    pair = dt.split_pair_key(F.concat(s, F.lit("_"), s))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(dt.parse_date(s), "yyyy-MM-dd").alias("parsed"), F.date_format(pair["reference"], "yyyy-MM-dd").alias("reference"))


@plan("""with b as (select p_partkey, lpad(cast(p_size as varchar), 3, '0') || '_' || lpad(cast(p_partkey as varchar), 6, '0') || case when p_partkey % 5 = 0 then '_EW1' else '_IW' || (p_partkey % 3 + 1) end as burst,
      case p_partkey % 4 when 0 then 'VV+VH' when 1 then 'vh/hv' when 2 then 'HH' else 'VH' end as pol, case when p_partkey % 7 = 0 then 'none' else ' 00' || (p_size % 4) || '.31' end as ipf, p_type, p_size from part)
  select p_partkey, case when p_partkey % 5 <> 0 then p_size end as track, cast(nullif(regexp_extract(ipf, '^\\s*(\\d+)', 1), '') as int) as major,
    pol in ('VV+VH', 'HH') as co_polarised, 'T' || lpad(cast(p_size as varchar), 3, '0') || case when p_partkey % 2 = 0 then 'A' else 'D' end || '_' || pol as stack,
    case when length(p_type) > 6 then p_type[1:5] || '…' else p_type end as short from b""")
def identifiers(spark, sf_dir):
    k = F.col("p_partkey")
    tail = F.when(k % 5 == 0, "_EW1").otherwise(F.concat(F.lit("_IW"), (k % 3 + 1).cast("string")))
    burst = F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("_"), F.lpad(k.cast("string"), 6, "0"), tail)
    pol = F.when(k % 4 == 0, "VV+VH").when(k % 4 == 1, "vh/hv").when(k % 4 == 2, "HH").otherwise("VH")
    ipf = F.when(k % 7 == 0, "none").otherwise(F.concat(F.lit(" 00"), (F.col("p_size") % 4).cast("string"), F.lit(".31")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.burst_track(burst).alias("track"), text.major_version(ipf).alias("major"), text.co_polarised(pol).alias("co_polarised"),
        text.stack_id(F.col("p_size"), F.when(k % 2 == 0, "ASCENDING").otherwise("DESCENDING"), pol).alias("stack"), text.shorten(F.col("p_type"), 6).alias("short"),
    )


def _masked_sql(column: str) -> str:
    out = column
    for pattern, by in masking.rules(r"(?:^|[^\w.])"):
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return f"case when regexp_matches({column}, '{masking.trigger()}') then {out} else {column} end"


@plan(f"select doc_id, sha256({_masked_sql('text')}) as masked_sha256 from documents")
def secret_masking(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(masking.masked(F.col("text")), 256).alias("masked_sha256"))


#: One form of every class that is masked, and some that are left; {} is filled by the row.
SECRET_FORMS = (
    "export EARTH_TOKEN={}abc && run", "AWS_ACCESS_KEY_ID=AKIA{}", "Authorization: Basic dXNlcjpw{}", "Authorization: Bearer short{}", "passphrase='{} x'", "private_key={};rest", "credential={}", "x.api-key : \"{}\"",
    "{'token': '{}'}", "env['A_TOKEN'] = '{}'", "run --api-key {} --depth 3", "run -password={}", "machine h login u password p{}", "curl -H bearer abcdefghijklmnop{}",
    "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT{}", "https://user:pw{}@host/x", "https://host/{}", "tokens are counted {}", "the key of {}", "a.b token={},passwd={}", "secretary: {}", "nothing {}",
)


@plan(f"""with f as (select unnest([{', '.join("'" + f.replace("'", "''") + "'" for f in SECRET_FORMS)}]) as form, generate_subscripts([{', '.join("''" for _ in SECRET_FORMS)}], 1) as n),
    t as (select c_custkey, n, replace(form, '{{}}', cast(c_custkey as varchar)) as text from customer, f)
  select c_custkey, cast(n as int) as n, {_masked_sql('text')} as masked from t""")
def secret_forms(spark, sf_dir):
    """Every class of secret, with a number of its own in every row."""
    forms = F.array(*[F.lit(f) for f in SECRET_FORMS])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(forms).alias("n", "form"))
    return rows.select("c_custkey", (F.col("n") + 1).alias("n"), masking.masked(F.replace("form", F.lit("{}"), F.col("c_custkey").cast("string"))).alias("masked"))


@plan(r"""select c_custkey, case when b >= 1073741824 then printf('%.1f GiB', b / 1073741824.0) when b >= 1048576 then printf('%.1f MiB', b / 1048576.0)
    when b >= 1024 then printf('%.1f KiB', b / 1024.0) else cast(cast(b as bigint) as varchar) || ' B' end as size,
    case when c_custkey = 0 then null when c_acctbal = 0 then 0.0 else round((c_acctbal - c_custkey) / abs(c_custkey) * 100, 6) end as change_pct
    from (select *, floor(abs(c_acctbal) * c_custkey * 3) as b from customer)""")
def size_and_change(spark, sf_dir):
    b = F.floor(F.abs("c_acctbal") * F.col("c_custkey") * 3)
    change = F.when(F.col("c_custkey") != 0, F.when(F.col("c_acctbal") == 0, 0.0).otherwise(F.round((F.col("c_acctbal") - F.col("c_custkey")) / F.abs("c_custkey") * 100, 6)))
    return table(spark, sf_dir, "customer").select("c_custkey", text.binary_size(b).alias("size"), change.alias("change_pct"))


@plan("""select n_nationkey, sha256('{"key":"' || n_nationkey || '","name":"' || n_name || '","region":"' || n_regionkey || '"}')[1:16] as params_hash,
    sha256(n_name || chr(0) || n_regionkey || chr(0)) as combined from nation""")
def parameter_hashes(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    m = F.create_map(F.lit("region"), s("n_regionkey"), F.lit("_note"), F.lit("x"), F.lit("name"), s("n_name"), F.lit("key"), s("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", hashing.params_hash(hashing.public_keys(m)).alias("params_hash"), hashing.combined_hash([s("n_name"), s("n_regionkey")]).alias("combined"))


@plan("""select e.event_id, cast(json_extract(props, '$.k') as int) as k, 'a=1' as a, case when event_id % 2 = 0 then event_type else 'base' end as mode from events e""")
def merged_settings(spark, sf_dir):
    """Right-biased union of settings; values read back from it."""
    e = table(spark, sf_dir, "events")
    base = F.create_map(F.lit("a"), F.lit("a=1"), F.lit("mode"), F.lit("base"))
    over = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("mode"), F.col("event_type")))
    return e.select("event_id", last_wins_maps(base, F.from_json("props", "map<string,string>"), over).alias("m")).select(
        "event_id", F.col("m")["k"].cast("int").alias("k"), F.col("m")["a"].alias("a"), F.col("m")["mode"].alias("mode")
    )


@plan("""with a as (select l_suppkey, 'x' || case when l_suppkey % 2 = 0 then '_fraction' else '' end as name, avg(l_discount) as old, avg(l_discount) + case when l_suppkey % 3 = 0 then 5e-5 when l_suppkey % 3 = 1 then 1e-9 else 0 end as new from lineitem group by 1)
    select l_suppkey, case when name like '%_fraction' then abs(new - old) <= 1e-4 else abs(new - old) <= 1e-9 + 1e-6 * abs(old) end as agrees from a""")
def golden_tolerance(spark, sf_dir):
    k = F.col("l_suppkey")
    a = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("old"))
    a = a.withColumn("new", F.col("old") + F.when(k % 3 == 0, 5e-5).when(k % 3 == 1, 1e-9).otherwise(0.0)).withColumn("name", F.when(k % 2 == 0, "x_fraction").otherwise("x"))
    return a.select("l_suppkey", hashing.within_tolerance(F.col("name"), F.col("old"), F.col("new")).alias("agrees"))


@plan("""with e as (select event_id, user_id, epoch_us(ts) / 1e6 - 1704067200 as t, value as p, lead(epoch_us(ts) / 1e6 - 1704067200) over w as t1, lead(value) over w as p1, lead(event_id) over w as e1
      from events window w as (partition by user_id order by ts, event_id)),
    s as (select *, 0.5 as s, t1 - t as h, 0.001 * (event_id % 5) as v0, 0.001 * (e1 % 5) as v1 from e where t1 > t)
    select event_id, round((2*s*s*s - 3*s*s + 1) * p + (s*s*s - 2*s*s + s) * h * v0 + (3*s*s - 2*s*s*s) * p1 + (s*s*s - s*s) * h * v1, 4) as position from s""")
def hermite_interpolation(spark, sf_dir):
    """Position half way to a user's next event, velocities given."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("t", micros("ts") / 1e6 - 1704067200)
    e = e.select("event_id", "t", F.col("value").alias("p"), F.lead("t").over(w).alias("t1"), F.lead("value").over(w).alias("p1"), F.lead("event_id").over(w).alias("e1")).where("t1 > t")
    v = lambda c: 0.001 * (F.col(c) % 5)
    mid = F.col("t") + (F.col("t1") - F.col("t")) * 0.5
    return e.select("event_id", F.round(ph.hermite(mid, F.col("t"), F.col("t1"), F.col("p"), F.col("p1"), v("event_id"), v("e1")), 4).alias("position"))


#: Credits of a job by looks: (most pairs, credits); the first that holds the job counts.
TIERS = {
    "20x4": ((4, 1), (12, 5), (15, 10)),
    "10x2": ((3, 1), (9, 5), (15, 10)),
    "5x1": ((1, 1), (2, 5), (3, 10), (4, 15), (5, 20), (6, 25), (7, 30), (8, 35), (9, 40), (10, 45), (11, 90), (12, 95), (13, 100), (14, 105), (15, 110)),
}


def job_credits(looks, n):
    out = F.lit(None).cast("long")
    for name, tiers in TIERS.items():
        value = F.lit(None).cast("long")
        for most, credits in reversed(tiers):
            value = F.when(n <= most, F.lit(credits).cast("long")).otherwise(value)
        out = F.when(looks == name, value).otherwise(out)
    return F.when(n >= 1, out)


_TIERS = ", ".join(f"('{k}', {m}, {c})" for k, ts in TIERS.items() for m, c in ts)


@plan(f"""with tiers(looks, most, credits) as (values {_TIERS}), j as (select o_orderkey, case o_orderkey % 4 when 0 then '20x4' when 1 then '10x2' when 2 then '5x1' else '1x1' end as looks, count(*) * 3 - 2 as n
      from orders join lineitem on l_orderkey = o_orderkey group by 1)
    select o_orderkey, looks, n, (select cast(credits as bigint) from tiers t where t.looks = j.looks and t.most >= n order by most limit 1) as credits from j""")
def job_costs(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    j = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count(F.lit(1)) * 3 - 2).alias("n"))
    j = j.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").withColumn("looks", F.when(k == 0, "20x4").when(k == 1, "10x2").when(k == 2, "5x1").otherwise("1x1"))
    return j.select("o_orderkey", "looks", "n", job_credits(F.col("looks"), F.col("n")).alias("credits"))


@plan("""with j as (select l_suppkey, count(*) as n, 2.0 + l_suppkey % 7 as job_gb, 60.0 + l_suppkey % 13 as job_s from lineitem group by 1),
    w as (select *, greatest(1, least(8, n, floor(32 / job_gb))) as workers from j)
    select l_suppkey, n, cast(workers as bigint) as workers, cast(ceil(n / workers) as bigint) as rounds, round(ceil(n / workers) * job_s, 3) as time_s, round(workers * job_gb, 3) as rss_gb from w""")
def resource_model(spark, sf_dir):
    """Workers by cores, jobs and memory; rounds of them; time and memory."""
    k = F.col("l_suppkey")
    j = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).withColumn("job_gb", 2.0 + k % 7).withColumn("job_s", 60.0 + k % 13)
    j = j.withColumn("workers", F.greatest(F.lit(1), F.least(F.lit(8), F.col("n"), F.floor(32 / F.col("job_gb")))).cast("long")).withColumn("rounds", F.ceil(F.col("n") / F.col("workers")).cast("long"))
    return j.select("l_suppkey", "n", "workers", "rounds", F.round(F.col("rounds") * F.col("job_s"), 3).alias("time_s"), F.round(F.col("workers") * F.col("job_gb"), 3).alias("rss_gb"))


LOOKS_TARGET, MAX_ASPECT = 30.0, 2.0


@plan(f"""with s as (select s_suppkey, 2.0 + (s_suppkey % 9) * 0.25 as slant, 13.0 + (s_suppkey % 5) as az, 30.0 + s_suppkey % 16 as inc from supplier),
    g as (select *, slant / sin(radians(inc)) as rg from s),
    c as (select s_suppkey, rg, az, r.n as n_rg, a.n as n_az, rg * r.n as p_rg, az * a.n as p_az from g, (select unnest(generate_series(1, 80)) as n) r, (select unnest(generate_series(1, 20)) as n) a
      where r.n <= greatest(1, ceil(2 * {LOOKS_TARGET} * {MAX_ASPECT} / rg) + 1) and a.n <= greatest(1, ceil(2 * {LOOKS_TARGET} * {MAX_ASPECT} / az) + 1)),
    k as (select *, greatest(p_rg, p_az) / least(p_rg, p_az) as aspect from c)
    select s_suppkey, arg_min(n_rg, (abs(sqrt(p_rg * p_az) - {LOOKS_TARGET}), n_rg * n_az, aspect, n_rg, n_az)) as rg_looks,
      arg_min(n_az, (abs(sqrt(p_rg * p_az) - {LOOKS_TARGET}), n_rg * n_az, aspect, n_rg, n_az)) as az_looks from k where aspect <= {MAX_ASPECT} group by 1""")
def automatic_looks(spark, sf_dir):
    """Looks whose pixel is nearest the target size, nearly square, then fewest."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (2.0 + (k % 9) * 0.25).alias("slant"), (13.0 + k % 5).alias("az"), (30.0 + k % 16).alias("inc"))
    s = s.withColumn("rg", ph.ground_range(F.col("slant"), F.col("inc")))
    most = lambda c: F.greatest(F.lit(1), F.ceil(2 * LOOKS_TARGET * MAX_ASPECT / F.col(c)) + 1)
    c = s.withColumn("n_rg", F.explode(F.sequence(F.lit(1).cast("long"), most("rg")))).withColumn("n_az", F.explode(F.sequence(F.lit(1).cast("long"), most("az"))))
    p, q = F.col("rg") * F.col("n_rg"), F.col("az") * F.col("n_az")
    c = c.withColumn("aspect", F.greatest(p, q) / F.least(p, q)).withColumn("miss", F.abs(F.sqrt(p * q) - LOOKS_TARGET))
    best = F.min(F.struct("miss", (F.col("n_rg") * F.col("n_az")).alias("total"), "aspect", "n_rg", "n_az")).alias("b")
    return c.where(F.col("aspect") <= MAX_ASPECT).groupBy("s_suppkey").agg(best).select("s_suppkey", F.col("b.n_rg").alias("rg_looks"), F.col("b.n_az").alias("az_looks"))
