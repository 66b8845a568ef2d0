"""Readers of YAML settings, settings resolved as columns, manifests and reports."""

import pytest
from pyspark.sql import functions as F

from fringeflow.functions import settings
from fringeflow.operators import artifacts
from fringeflow.sources import configs, reports

KB = r"""
- {id: KB-B-002, engine: b, pattern: 'lost (?P<file>\S+)', extract: [file], severity: FAIL, supersedes: [KB-A-001]}
- {id: KB-A-001, engine: any, pattern: '(open', severity: WARN}
"""


def test_knowledge_base(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(KB)
    (tmp_path / "b.yaml").write_text("- {id: KB-C-1, engine: c, pattern: x, extract: [y], supersedes: [KB-Z-009]}\n- {id: KB-A-001, engine: a, pattern: z}\n")
    kb = configs.read_knowledge_base(spark, str(tmp_path))
    assert sorted((r.id, r.compiles) for r in kb.collect()) == [("KB-A-001", False), ("KB-A-001", True), ("KB-B-002", True), ("KB-C-1", True)]
    assert {(r.id, r.problem) for r in artifacts.entry_problems(kb).collect()} == {("KB-A-001", "repeated"), ("KB-C-1", "form"), ("KB-C-1", "extract"), ("KB-C-1", "supersedes")}
    assert {r.id for r in configs.entries_for(kb, "b").collect()} == {"KB-A-001", "KB-B-002"}
    assert configs.entries_for(kb, None).count() == 4


def test_yaml_that_is_none(spark, tmp_path):
    (tmp_path / "x.yaml").write_text("a: [1\n")
    (r,) = configs.read_yaml(spark, str(tmp_path / "x.yaml")).collect()
    assert r.json is None and r.problem


def test_grid(spark, tmp_path):
    (tmp_path / "g.yaml").write_text("grid:\n  unwrap.tiles: [1, 2]\n  filter.alpha: 0.5\nmax_points: 9\n")
    assert [(r.key, r["values"]) for r in configs.read_grid(spark, str(tmp_path / "g.yaml")).orderBy("position").collect()] == [("unwrap.tiles", ["1", "2"]), ("filter.alpha", ["0.5"])]
    (tmp_path / "h.yaml").write_text("a.b: x\n")
    assert [(r.key, r["values"]) for r in configs.read_grid(spark, str(tmp_path / "h.yaml")).collect()] == [("a.b", ["x"])]
    for text in ("grid: {ab: [1]}", "grid: {a.b: []}"):
        (tmp_path / "i.yaml").write_text(text)
        with pytest.raises(ValueError, match="dotted"):
            configs.read_grid(spark, str(tmp_path / "i.yaml"))


def test_price_tiers_and_experiments(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("burst_insar:\n  20x4: {pixel_m: 80, tiles: 1, tiers: [{max_pairs: 15, credits: 5}, {max_pairs: 4, credits: 1}]}\n")
    assert sorted(map(tuple, configs.read_price_tiers(spark, str(tmp_path / "p.yaml")).collect())) == [("20x4", 4, 1.0, 80), ("20x4", 15, 5.0, 80)]
    (tmp_path / "e.yaml").write_text("name: n\nseeds: [1, 2]\nmethods: [ml, filter]\nmetrics: [rmse]\n")
    read = lambda **k: configs.read_experiments(spark, str(tmp_path / "e.yaml"), **({"methods": ["ml", "filter"], "metrics": ["rmse"]} | k))
    assert sorted((r.method, r.seed) for r in read().collect()) == [("filter", 1), ("filter", 2), ("ml", 1), ("ml", 2)]
    with pytest.raises(ValueError, match="filter"):
        read(methods=["ml"])
    with pytest.raises(ValueError, match="rmse"):
        read(metrics=[])


def test_boxes_dates_workers(spark):
    rows = [("1,2, 3 4", None, None), (None, "5 6 7 8", "POLYGON((0 0,1 0,1 1,0 0))"), (None, None, "POLYGON((0 0,2 0,2 1,0 0))"), ("1 2 3", None, "POLYGON((0 0,2 0,2 1,0 0))"), ("a b c d", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, w string")
    got = [r.x and tuple(r.x) for r in df.select(settings.box_snwe(F.col("a"), F.col("b"), F.col("w")).alias("x")).collect()]
    assert got == [(1, 2, 3, 4), (5, 6, 7, 8), (0, 1, 0, 2), (0, 1, 0, 2), None, None]
    one = spark.range(1).select(
        settings.sensing_date(F.lit("S1A_IW_SLC__1SDV_20240102T030405_20240102T030432_0.SAFE")).alias("d"), settings.sensing_date(F.lit("none")).alias("n"),
        settings.workers(F.lit("x"), F.lit("3")).alias("w"), settings.workers(F.lit(None).cast("string"), F.lit("-2")).alias("v"),
        settings.given_overlap(F.lit(100), F.lit(4), F.lit(30)).alias("g"), settings.given_overlap(F.lit(100), F.lit(1), F.lit(0)).alias("h"),
    ).first()
    assert (one.d, one.n, one.w, one.v, tuple(one.g), tuple(one.h)) == ("20240102", None, 3, 1, (24, 30, True), (0, 0, False))
    with pytest.raises(ValueError, match="orbit type"):
        settings.orbit_request(F.lit("a"), F.lit("b"), "other")


def test_manifests_and_sizes(spark):
    df = spark.createDataFrame([("a/1", '{"s": "x"}', 3), ("a/2", "{", 4), ("b/1", "{}", 5), ("b/2", None, 1)], "path string, text string, bytes long")
    assert {r.path: r.record and r.record.s for r in artifacts.manifests(df, "s string", ["s"]).collect()} == {"a/1": "x", "a/2": None, "b/1": None, "b/2": None}
    assert sorted(map(tuple, artifacts.folder_sizes(df, F.split("path", "/")[0]).collect())) == [("a", 7, 2), ("b", 6, 2)]
    assert artifacts.manifests(df.limit(0), "s string", ["s"]).count() == 0


def test_sweep_and_payload(spark):
    rows = spark.createDataFrame([(0, "a=1", 0.5, 2.0, True), (1, "a=2", 0.75, 1.0, True), (2, "a=3", None, 3.0, False)], "i int, params string, rmse double, time double, ok boolean")
    front = rows.where("i < 2").select("i")
    got = [r.line for r in reports.sweep_lines(rows, front, "i", "params", ["rmse", "time"]).orderBy("i").collect()]
    assert got == ["| 0 | a=1 | 0.500 | 2.000 | * | ok |", "| 1 | a=2 | 0.750 | 1.000 | * | ok |", "| 2 | a=3 |  | 3.000 |  | failed |"]
    f = spark.createDataFrame([("s", "WARN", "SEL-10", "token=abcdefgh12345678"), ("s", "FAIL", "SEL-01", "x")], "scope string, severity string, rule string, detail string")
    c = spark.createDataFrame([("s", 3)], "stack string, n int")
    kinds = {(r.kind, r.value.split('"')[3]) for r in reports.precheck_payload(c, f).collect()}
    assert kinds == {("candidate", "s"), ("finding", "FAIL"), ("finding", "WARN")}
    assert not any("abcdefgh" in r.value for r in reports.precheck_payload(c, f).collect())
