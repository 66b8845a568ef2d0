"""Precheck rules: each maps stacks, records and pairs to findings.

A finding is (stack, scope, rule, severity, detail).  ``records``: stack,
track, direction, mode, subswath, pol, date, burst, ipf, rg_spacing,
az_spacing, incidence, missing_lines; ``stacks``: stack, track, direction,
pol, coverage, n_bursts, lat; ``pairs``: stack, ref, sec, dt_days, bperp;
``dates`` and ``bursts``: the candidate's own (stack, date) and (stack,
burst).  Everything that rules ask of a stack is brought into one row by one
grouped aggregate over records and one over pairs; a rule is then an
expression over that row, and the registry a dictionary of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import crosses_season, pair_key
from ..functions.phase import ground_range
from ..functions.text import co_polarised, major_version
from .frames import cut

SEVERITIES = ("FAIL", "WARN", "INFO")


@dataclass
class Inputs:
    stacks: DataFrame
    records: DataFrame
    pairs: DataFrame
    dates: DataFrame | None = None  # those with a record, if not given
    bursts: DataFrame | None = None
    max_perp_m: float = 150.0
    max_days: int = 48
    min_coverage: float = 0.9
    spacing_tolerance: float = 0.05
    target_m: float = 30.0
    max_aspect: float = 2.0


def finding(df: DataFrame, rule: str, severity: str | Column, detail: Column, scope: Column | None = None) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("stack", (F.col("stack").cast("string") if scope is None else scope).alias("scope"), F.lit(rule).alias("rule"), level.alias("severity"), detail.cast("string").alias("detail"))


def best_looks(rg: Column, az: Column, target: float, max_aspect: float) -> Column:
    """Struct (miss, total, aspect, n_rg, n_az) of the looks whose pixel is nearest the target and nearly square, then the fewest; null where a spacing is."""
    most = lambda c: F.greatest(F.lit(1), F.ceil(2 * target * max_aspect / c) + 1).cast("int")

    def candidate(n, m):
        p, q = rg * n, az * m
        aspect = F.greatest(p, q) / F.least(p, q)
        return F.when(aspect <= max_aspect, F.struct(F.abs(F.sqrt(p * q) - target).alias("miss"), (n * m).alias("total"), aspect.alias("aspect"), n.alias("n_rg"), m.alias("n_az")))

    grid = F.flatten(F.transform(F.sequence(F.lit(1), most(rg)), lambda n: F.transform(F.sequence(F.lit(1), most(az)), lambda m: candidate(n, m))))
    return F.when(rg.isNotNull() & az.isNotNull(), F.array_min(F.filter(grid, lambda x: x.isNotNull())))


def _set(c: Column) -> Column:
    return F.array_sort(F.collect_set(c))


def about_stacks(x: Inputs) -> DataFrame:
    """One row a stack: what its records, dates and pairs have to say to the rules.

    Sets hold tracks, directions, modes, layouts, channels and versions, a
    few values each.
    """
    r = x.records
    both = (F.col("rg_spacing") > 0) & (F.col("az_spacing") > 0)
    told = lambda c: F.when(both, F.col(c))
    spread = lambda c: (F.max(told(c)) - F.min(told(c))) / F.median(told(c))
    wanted = r.select("stack", "burst").distinct() if x.bursts is None else x.bursts.select("stack", "burst").distinct()
    own = r.join(wanted.withColumn("wanted", F.lit(True)), ["stack", "burst"], "left")
    per_date = own.groupBy("stack", "date").agg(
        F.array_join(_set("subswath"), ", ").alias("layout"), F.count_distinct(F.when(F.col("wanted"), F.col("burst"))).alias("n"), F.max(F.coalesce("missing_lines", F.lit(0))).alias("lines")
    )
    expected = wanted.groupBy("stack").agg(F.count(F.lit(1)).alias("expected"))
    layouts = per_date.groupBy("stack").agg(F.count_distinct("layout").alias("n_layouts"))
    dates = per_date.select("stack", "date") if x.dates is None else x.dates.select("stack", "date").distinct()
    seen = dates.join(per_date.select("stack", "date", "n", "lines"), ["stack", "date"], "left").join(expected, "stack", "left").join(layouts, "stack")
    short = (F.coalesce("n", F.lit(0)) != F.coalesce("expected", F.lit(0))) | (F.coalesce("lines", F.lit(0)) > 0)
    bad = seen.groupBy("stack").agg(F.count_if(short).alias("bad_dates"))
    known = F.when(F.length("ipf") > 0, F.col("ipf"))
    one = r.groupBy("stack").agg(
        _set(F.col("track").cast("string")).alias("tracks"), _set("direction").alias("directions"), _set("mode").alias("modes"), _set("pol").alias("pols"),
        _set(known).alias("versions"), F.count_distinct(major_version(known)).alias("n_versions"), F.count(told("rg_spacing")).alias("n_spacings"),
        F.greatest(spread("rg_spacing"), spread("az_spacing")).alias("deviation"), F.median(told("rg_spacing")).alias("rg"), F.median(told("az_spacing")).alias("az"), F.median("incidence").alias("incidence"),
    )
    north = F.col("lat").isNull() | (F.col("lat") >= 0)
    p = x.pairs.join(x.stacks.select("stack", "lat"), "stack").groupBy("stack").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count("bperp").alias("n_known"), F.count_if(crosses_season(F.col("ref"), F.col("sec"), north)).alias("n_crossing")
    )
    out = x.stacks.join(one, "stack", "left").join(layouts, "stack", "left").join(bad, "stack", "left").join(p, "stack", "left")
    plus = lambda s, c: F.array_sort(F.array_distinct(F.concat(F.coalesce(F.col(s), F.array().cast("array<string>")), F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col(c).cast("string"))))))
    return out.withColumns({"tracks": plus("tracks", "track"), "directions": plus("directions", "direction"), "pols": plus("pols", "pol")})


def _listed(c: str) -> Column:
    return F.array_join(c, ", ")


def _if(due: Column, severity: str | Column, detail: Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(due, F.struct(level.alias("severity"), detail.cast("string").alias("detail")))


def covered(x: Inputs) -> Column:
    none = (F.col("n_bursts") == 0) | (F.col("coverage") <= 0)
    return _if(none | (F.col("coverage") < x.min_coverage), F.when(none, "FAIL").otherwise("WARN"), F.round("coverage", 6))


def looks_told(x: Inputs) -> Column:
    """Always due: the looks that the stack's spacings lead to, or that they are unknown."""
    looks = best_looks(ground_range(F.col("rg"), F.col("incidence")), F.col("az"), x.target_m, x.max_aspect)
    return _if(F.lit(True), "INFO", F.coalesce(F.concat_ws("x", looks["n_rg"].cast("string"), F.when(looks.isNotNull(), looks["n_az"].cast("string"))), F.lit("")))


#: Rules over a stack's row, in order: id, and the expression of its finding (null: none).
RULES: list[tuple[str, Callable[[Inputs], Column]]] = [
    ("SEL-01", lambda x: _if(F.size("tracks") > 1, "FAIL", _listed("tracks"))),
    ("SEL-02", lambda x: _if(F.size("directions") > 1, "FAIL", _listed("directions"))),
    ("SEL-03", lambda x: _if((F.size("modes") > 1) | (F.col("n_layouts") > 1), "FAIL", F.concat_ws("/", _listed("modes"), F.col("n_layouts").cast("string")))),
    ("SEL-04", covered),
    ("SEL-05", lambda x: _if(F.exists("pols", lambda p: ~co_polarised(p)), "FAIL", _listed("pols"))),
    ("SEL-06", lambda x: _if((F.col("n_pairs") > 0) & (F.col("n_known") == 0), "INFO", F.col("n_pairs"))),
    ("SEL-07", lambda x: _if(F.col("n_crossing") > 0, "INFO", F.col("n_crossing"))),
    ("SEL-08", lambda x: _if(F.col("n_versions") > 1, "INFO", _listed("versions"))),
    ("SEL-09", lambda x: _if((F.col("n_spacings") >= 2) & (F.col("deviation") > x.spacing_tolerance), "WARN", F.round("deviation", 6))),
    ("SEL-09", looks_told),
    ("SEL-10", lambda x: _if(F.col("bad_dates") > 0, "WARN", F.col("bad_dates"))),
]


def on_stacks(x: Inputs, about: DataFrame) -> DataFrame:
    """Findings of :data:`RULES`, from one row a stack."""
    made = F.array(*[F.struct(F.lit(name).alias("rule"), rule(x).alias("f")) for name, rule in RULES])
    rows = about.select("stack", F.explode(F.filter(made, lambda e: e["f"].isNotNull())).alias("e"))
    return rows.select("stack", F.col("stack").cast("string").alias("scope"), "e.rule", "e.f.severity", "e.f.detail")


def on_pairs(x: Inputs) -> DataFrame:
    """WARN for each pair too far apart in space or time, in one pass."""
    far = _if(F.abs("bperp") > x.max_perp_m, "WARN", F.round(F.abs("bperp"), 3))
    long = _if(F.col("dt_days") > x.max_days, "WARN", F.col("dt_days"))
    made = F.array(F.struct(F.lit("SEL-06").alias("rule"), far.alias("f")), F.struct(F.lit("SEL-07").alias("rule"), long.alias("f")))
    rows = x.pairs.select("stack", pair_key(F.col("ref"), F.col("sec")).alias("pair"), F.explode(F.filter(made, lambda e: e["f"].isNotNull())).alias("e"))
    return rows.select("stack", F.concat_ws(":", F.col("stack").cast("string"), "pair").alias("scope"), "e.rule", "e.f.severity", "e.f.detail")


def tracks_by_direction(stacks: DataFrame) -> DataFrame:
    """INFO for each direction that several tracks share, across stacks."""
    g = stacks.groupBy("direction").agg(F.count_distinct("track").alias("n")).where("n >= 2")
    return g.select(F.lit(None).cast("long").alias("stack"), F.col("direction").alias("scope"), F.lit("SEL-01").alias("rule"), F.lit("INFO").alias("severity"), F.col("n").cast("string").alias("detail"))


def precheck(x: Inputs) -> DataFrame:
    """All findings: across stacks, of stacks, of pairs.  The inputs are worked out once."""
    x = Inputs(**{**x.__dict__, "stacks": cut(x.stacks), "records": cut(x.records), "pairs": cut(x.pairs)})
    return tracks_by_direction(x.stacks).unionByName(on_stacks(x, about_stacks(x))).unionByName(on_pairs(x))


def severity_rank(c: Column) -> Column:
    return F.when(c == "FAIL", 0).when(c == "WARN", 1).otherwise(2)


def severity_counts(findings: DataFrame, stacks: DataFrame) -> DataFrame:
    """(stack, n_fail, n_warn, n_info), zeros included."""
    g = findings.where("stack is not null").groupBy("stack").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES])
    out = stacks.select("stack").join(g, "stack", "left")
    return out.select("stack", *[F.coalesce(f"n_{s.lower()}", F.lit(0).cast("long")).alias(f"n_{s.lower()}") for s in SEVERITIES])


def recommended(stacks: DataFrame, counts: DataFrame, n: int = 1) -> DataFrame:
    """The best stacks without a FAIL: most coverage, most dates, fewest warnings, smallest id."""
    return stacks.join(counts, "stack").where("n_fail = 0").orderBy(F.desc("coverage"), F.desc("n_dates"), "n_warn", "stack").limit(n)


def precise_orbits(x: Inputs, available: DataFrame) -> DataFrame:
    """INFO where dates are known to lack a precise orbit; ``available``: date, ok (null: unknown)."""
    dates = x.records.select("stack", "date").distinct().join(available, "date").where("ok = false")
    return finding(dates.groupBy("stack").agg(F.count(F.lit(1)).alias("n")), "SEL-11", "INFO", F.col("n"))


def terrain(x: Inputs, stats: DataFrame, most: float) -> DataFrame:
    """WARN where layover and shadow take more than ``most`` of the area, else INFO; ``stats``: direction, layover, shadow."""
    s = x.stacks.join(stats, "direction").withColumn("bad", F.col("layover") + F.col("shadow"))
    return finding(s, "SEL-12", F.when(F.col("bad") > most, "WARN").otherwise("INFO"), F.round("bad", 6))


def credits(x: Inputs, cost: Column, budget: float) -> DataFrame:
    """WARN where the pairs' jobs cost more than the budget, else INFO; unknown costs are told as such."""
    n = x.pairs.groupBy("stack").agg(F.count(F.lit(1)).alias("n_pairs"))
    s = n.join(x.stacks, "stack").withColumn("cost", cost)
    total = F.col("cost") * F.col("n_pairs")
    return finding(s, "SEL-13", F.when(total > budget, "WARN").otherwise("INFO"), F.coalesce(total.cast("long").cast("string"), F.lit("unknown")))
