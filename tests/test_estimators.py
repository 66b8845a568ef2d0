"""Phase linking on stacks of known covariance; folders, caches and tiles."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow.operators import estimators
from fringeflow.sources import folders, reports, synthetic


def stack(spark, n=5, samples=600, seed=3):
    pixels = spark.range(2).select(F.col("id").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    return synthetic.complex_stack(pixels, ["block", "sample"], synthetic.coherence_matrix(n, 6.0, 0.4), F.col("epoch") * (0.5 + F.col("block") * 0.2) + 1.0, seed)


def test_complex_stack_has_its_covariance(spark):
    p = stack(spark).where("block = 0").toPandas()
    z = np.zeros((5, 600), complex)
    z[p["epoch"], p["sample"]] = p["re"] + 1j * p["im"]
    want = synthetic.coherence_matrix(5, 6.0, 0.4) * np.exp(0.5j * (np.arange(5)[:, None] - np.arange(5)))
    assert np.abs(z @ z.conj().T / 600 - want).max() < 0.15
    assert p[p["epoch"] == 0]["phase_true"].abs().max() == 0
    assert p.equals(stack(spark).where("block = 0").toPandas())


@pytest.mark.parametrize("how", [{}, {"method": "emi"}, {"short": 2}, {"method": "emi", "short": 3}, {"short": 9}])
def test_linked_phases_meet_the_truth(spark, how):
    for r in estimators.linked_phase(stack(spark), ["block"], "epoch", "re", "im", "sample", **how).collect():
        off = r.phase - r.epoch * (0.5 + r.block * 0.2)
        assert abs(math.remainder(off, 2 * math.pi)) < 0.15
        assert 0.95 < r.quality <= 1 + 1e-9


def test_linked_phases_refuse(spark):
    for how in ({"method": "x"}, {"beta": 1.0}, {"short": 1}):
        with pytest.raises(ValueError):
            estimators.linked_phase(stack(spark), ["block"], "epoch", "re", "im", "sample", **how)


def test_cache(tmp_path):
    calls = []

    def fetch(folder):
        calls.append(folder)
        (folder / "f").write_text("abc")

    a = folders.fetched(tmp_path, {"b": 1, "a": "x"}, fetch)
    assert folders.fetched(tmp_path, {"a": "x", "b": 1}, fetch, offline=True) == a and len(calls) == 1
    assert json.loads((a / folders.KEY).read_text()) == {"key": {"b": 1, "a": "x"}, "files": ["f"], "bytes": 3}
    with pytest.raises(folders.Offline):
        folders.fetched(tmp_path, {"a": "y"}, fetch, offline=True)
    with pytest.raises(FileNotFoundError):
        folders.fetched(tmp_path, {"a": "y"}, lambda f: None)
    assert [p.name for p in a.parent.iterdir()] == [a.name]
    (a / folders.DONE).unlink()  # a rest of an interrupted fetch
    assert folders.fetched(tmp_path, {"a": "x", "b": 1}, fetch) == a and len(calls) == 2
    (a.parent / (a.name + ".lock")).touch()
    (a / folders.DONE).unlink()
    with pytest.raises(TimeoutError):
        folders.fetched(tmp_path, {"a": "x", "b": 1}, fetch, patience=0.1)


def test_manifest_prunes(tmp_path):
    for n in ("a", "b", ".hidden"):
        (tmp_path / n).write_text(n)
    m = folders.write_manifest(tmp_path, {"p": {"path": "a"}}, keep=["a"])
    assert sorted(p.name for p in tmp_path.iterdir()) == [".hidden", "a", "manifest.json"]
    assert json.loads(m.read_text())["entries"] == {"p": {"path": "a"}}


def test_tiles(spark, tmp_path):
    np.savez(tmp_path / "t.npz", extents=np.array([[0, 2, 0, 2], [0, 2, 1, 3]]), tile_0=np.arange(4.0).reshape(2, 2), tile_1=np.array([[9.0, np.nan], [7, 8]]))
    t = folders.read_tiles(spark, str(tmp_path / "t.npz"))
    assert sorted(((r.tile, r.row, r.col, r.value) for r in t.collect()), key=str) == sorted([(0, 0, 0, 0.0), (0, 0, 1, 1.0), (0, 1, 0, 2.0), (0, 1, 1, 3.0), (1, 0, 1, 9.0), (1, 0, 2, None), (1, 1, 1, 7.0), (1, 1, 2, 8.0)], key=str)
    folders.write_tiles(t, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    np.savez(tmp_path / "u.npz", extents=np.array([[0, 2, 0, 3]]), tile_0=np.zeros((2, 2)))
    with pytest.raises(Exception, match="its extent"):
        folders.read_tiles(spark, str(tmp_path / "u.npz")).collect()


def test_validation_lines(spark):
    s = spark.createDataFrame([("A|b", 1.0, 3), ("c", None, 4)], "site string, rmse double, n int")
    assert {r.line for r in reports.validation_lines(s, ["rmse", "n"]).collect()} == {"| A\\|b | 1.000 | 3 |", "| c | - | 4 |"}
    t = spark.createDataFrame([("x", 3.0), ("x", -4.0)], "net string, v double")
    assert json.loads(reports.closure_dashboard(t, ["net"], "v").first()["value"]) == {"n_triplets": 2, "rms": math.sqrt(12.5), "largest": 4.0}


def test_welch_and_ground_truth(spark):
    from fringeflow.sources import records

    df = spark.createDataFrame([("a", True, 1.0), ("a", True, 3.0), ("a", False, 2.0), ("a", False, 8.0), ("b", True, 1.0), ("b", False, 2.0), ("c", True, 1.0), ("c", True, 1.0), ("c", False, 1.0), ("c", False, 1.0)], "k string, s boolean, v double")
    got = {r.k: (r.t, r.dof) for r in estimators.welch(df, ["k"], "s", "v").collect()}
    assert got["a"] == (pytest.approx(-3 / math.sqrt(10)), pytest.approx(100 / 82))
    assert got["b"] == got["c"] == (None, None)
    assert records.combined_ground_truth(df, df.drop("v")).count() == 20
    with pytest.raises(ValueError, match="VAL-014"):
        records.combined_ground_truth()


def test_zero_doppler_on_curved_arcs(spark):
    from fringeflow.operators import orbits

    rng = np.random.default_rng(5)
    rows, want = [], []
    for i in range(40):
        h = 10.0
        a, va = np.array([7.0e6, rng.normal() * 1e4, rng.normal() * 1e4]), np.array([rng.normal() * 50, 7000.0, 300.0 + rng.normal() * 50])
        b = a + h * va + rng.normal(size=3) * 40
        vb = va + rng.normal(size=3) * 8
        t = np.array([6.3e6, rng.normal() * 3e4, 2e5])
        rows.append((i, (0.0, *a.tolist(), *va.tolist()), (h, *b.tolist(), *vb.tolist()), tuple(t.tolist())))

        def f(x, a=a, va=va, b=b, vb=vb, t=t):
            s = x / h
            p = (2 * s**3 - 3 * s**2 + 1) * a + (s**3 - 2 * s**2 + s) * h * va + (3 * s**2 - 2 * s**3) * b + (s**3 - s**2) * h * vb
            v = ((6 * s**2 - 6 * s) * a + (3 * s**2 - 4 * s + 1) * h * va + (6 * s - 6 * s**2) * b + (3 * s**2 - 2 * s) * h * vb) / h
            return (p - t) @ v

        lo = next((-30.0 * k for k in range(1, 21) if f(-30.0 * k) <= 0), None)
        hi = next((h + 30.0 * k for k in range(1, 21) if f(h + 30.0 * k) >= 0), None)
        if lo is not None and hi is not None:
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
        want.append(None if lo is None or hi is None else lo)
    rows.append((40, None, rows[0][2], rows[0][3]))
    vector = "struct<t:double,x:double,y:double,z:double,vx:double,vy:double,vz:double>"
    df = spark.createDataFrame(rows, f"i int, a {vector}, b {vector}, t struct<x:double,y:double,z:double>")
    got = [r.z for r in df.select("i", orbits.zero_doppler(F.col("a"), F.col("b"), F.col("t")).alias("z")).orderBy("i").collect()]
    assert got[40] is None and any(w is not None for w in want)
    assert [g is None for g in got[:40]] == [w is None for w in want]
    assert all(abs(g - w) < 1e-6 for g, w in zip(got, want) if w is not None)
