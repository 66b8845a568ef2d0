"""What shows only on larger tables: large sums, ties of averages, dense catalogues, grids of many tiles."""

import collections
import functools
import math
import operator
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow.functions import text
from fringeflow.operators import catalogue, grids, stats
from fringeflow.plans import ORACLES, QUERIES


def by_sql(folder, name, *tables):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(ORACLES[name]).fetchall())


def test_large_caches_are_listed_as_the_sql_has_them(spark, tmp_path):
    """Stages beyond a GiB stay in MiB; tenths halfway go to the even one."""
    sizes = [5 * 1024**3, 1024**3 - 1, 1024**2 + 1024**2 // 4, 1024 + 768, 1280, 1023]
    rows = [(k, f"s{k}", n / 100) for k, n in enumerate(sizes)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.stage, r.size, r.place) for r in QUERIES["cache_listing"](spark, str(tmp_path)).collect())
    assert got == by_sql(tmp_path, "cache_listing", "events") and got[0] == ("s0", "5120.0 MiB", 1)


def test_sizes_in_units(spark):
    sizes = [0, 1, 1023, 1024, 1280, 1792, 1024**2 - 1, 1024**2, 1024**3 - 1, 1024**3 * 5 // 4, 1024**4 * 7, 1024**5 * 3 + 12345]

    def want(n):
        k = min(4, max(0, n.bit_length() - 1) // 10)
        return f"{n / 1024**k:.1f} {['B', 'KiB', 'MiB', 'GiB', 'TiB'][k]}" if k else f"{n} B"

    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert [r.s for r in df.orderBy("n").select(text.binary_size(F.col("n")).alias("s")).collect()] == [want(n) for n in sizes]


def test_a_mean_of_just_the_limit_is_not_above_it(spark, tmp_path):
    """Discounts of 0.05 on average, exactly: the order in which doubles are added doesn't matter."""
    rng = random.Random(1)
    rows = []
    for k in range(40):
        values = [c / 100 for c in range(11)] * 3
        rng.shuffle(values)
        rows += [(k, v) for v in values] + ([(k, 0.051)] if k % 4 == 0 else [])
    assert any(functools.reduce(operator.add, [v for j, v in rows if j == k]) / 33 * 5 > 0.25 for k in range(40) if k % 4)
    spark.createDataFrame(rows, "l_suppkey long, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.job: r.method for r in QUERIES["unwrap_schedule"](spark, str(tmp_path)).collect()}
    assert got == {k: "defo" if k % 4 else "smooth" for k in range(40)}


def test_means_that_are_no_decimals(spark):
    rows = [("a", float("inf")), ("a", 0.1), ("b", float("nan")), ("c", None), ("d", 0.05), ("d", None), ("e", 0.050000000000000003), ("f", 0.0500000001), ("g", 1e300), ("h", -1e300)]
    got = spark.createDataFrame(rows, "k string, x double").groupBy("k").agg(stats.mean_exceeds(F.col("x"), "0.05").alias("m"))
    assert {r.k: r.m for r in got.collect()} == {"a": True, "b": True, "c": None, "d": False, "e": False, "f": True, "g": True, "h": False}


def test_orbits_of_a_dense_catalogue(spark):
    """Nested, touching and equal validities, several moments an id, ids and moments that are missing, against brute force."""
    rng = random.Random(3)
    rank = {"P": 0, "R": 1}
    orbits = [(rng.randrange(3) or None, rng.choice(["P", "R", "X", None]), a := rng.randrange(60), a + rng.choice([-1, 0, 1, 3, 20, 60]), rng.choice([None, 1.0, 2.0]), f"o{k}") for k in range(400)]
    records = [(rng.choice([None, *range(80)]), rng.choice([None, 1, 2, 3]), rng.choice([None, *range(-5, 130)])) for _ in range(200)]
    score = lambda o: (-rank.get(o[1], 2), o[4] is not None, o[4] or 0, o[5])
    want = {}
    for i, m, t in records:
        met = [score(o) for o in orbits if i is not None and None not in (m, t) and o[0] == m and o[2] <= t <= o[3]]
        want[i] = max([*met, *filter(None, [want.get(i)])], default=None)
    r, o = spark.createDataFrame(records, "id long, mission long, t long"), spark.createDataFrame(orbits, "mission long, kind string, start long, stop long, created double, name string")
    got = catalogue.choose_orbits(r, o, rank, width=10.0).collect()
    assert len(got) == len(want) and {x.id: x.orbit for x in got} == {i: w and w[3] for i, w in want.items()}


def test_orbits_are_chosen_without_a_row_for_each_pair(spark):
    """60,000 records and 60,000 files that are all valid on one mission's day: 3,600,000,000 pairs."""
    n = 60_000
    records = spark.range(n).select("id", F.lit(1).alias("mission"), (F.col("id") * 0.5).alias("t"))
    part = F.col("id") * 0.25
    orbits = spark.range(n).select(F.lit(1).alias("mission"), F.lit("P").alias("kind"), (-part).alias("start"), (part + 30_000).alias("stop"), F.col("id").cast("double").alias("created"), F.col("id").cast("string").alias("name"))
    got = catalogue.choose_orbits(records, orbits, {"P": 0})
    assert got.count() == n and [r.orbit for r in got.select("orbit").distinct().collect()] == [str(n - 1)]


@pytest.mark.parametrize("size, square", [(4, 64), (8, 16), (4, 6)])
def test_adaptive_filter_in_squares(spark, monkeypatch, size, square):
    """Layers larger than a square, with holes, missing values, negative places and an unnamed layer, against one patch after another."""
    monkeypatch.setattr(grids, "SQUARE", square)
    monkeypatch.setattr(grids, "AT_ONCE", 500)
    rng, half, rows = np.random.default_rng(2), size // 2, []
    for layer, (ny, nx) in {"a": (37, 21), "b": (8, 8), None: (5, 70)}.items():
        for y in range(-3, ny - 3):
            rows += [(layer, y, x, *(None if rng.random() < 0.05 else float("nan") if rng.random() < 0.05 else float(v) for v in rng.normal(size=2))) for x in range(nx) if rng.random() > 0.1]
    want = collections.defaultdict(lambda: [0, 0])
    for layer in ("a", "b", None):
        z = {(y, x): complex(*(0 if v is None or math.isnan(v) else v for v in (a, b))) for n, y, x, a, b in rows if n == layer}
        ramp = 1 - np.abs((np.arange(size) + 0.5) / half - 1)
        for py, px in {(y // half - dy, x // half - dx) for y, x in z for dy in (0, 1) for dx in (0, 1)}:
            at = [(i, j) for i in range(size) for j in range(size) if (py * half + i, px * half + j) in z]
            patch = np.zeros((size, size), complex)
            for i, j in at:
                patch[i, j] = z[py * half + i, px * half + j]
            s = np.fft.fft2(patch)
            smooth = sum(np.roll(np.roll(np.abs(s), a, 0), b, 1) for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9
            out = np.fft.ifft2(s * (smooth / smooth.max()) ** 0.5) if smooth.max() else patch
            for i, j in at:
                sums = want[layer, py * half + i, px * half + j]
                sums[0] += out[i, j] * ramp[i] * ramp[j]
                sums[1] += ramp[i] * ramp[j]
    df = spark.createDataFrame(rows, "layer string, row int, col int, a double, b double")
    made = grids.adaptive_filter(df, ["layer"], "a", "b", size=size)
    got = {(r.layer, r.row, r.col): complex(r.re, r.im) for r in made.collect()}
    assert made.columns == ["layer", "row", "col", "re", "im"] and made.count() == len(rows) and set(got) == set(want)
    assert max(abs(got[k] - v / w) for k, (v, w) in want.items()) < 1e-12
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan  # no call for each patch, one shuffle
