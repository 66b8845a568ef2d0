"""Readers on small files, joins and storage on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from fringeflow.operators import frames, grids, joins, network, series, storage
from fringeflow.sources import records


@pytest.mark.parametrize("shape", [lambda r: r, lambda r: {"records": r}, lambda r: {"data": {"records": r}, "schema_version": 1}])
def test_candidates(spark, tmp_path, shape):
    rows = [{"granule_id": "g1", "full_burst_id": "017_034567_IW2", "relative_orbit": 17, "acquisition_time": "2024-01-01T10:00:00Z", "other": 1}, {"granule_id": "g2", "acquisition_time": None}]
    (tmp_path / "c.json").write_text(json.dumps(shape(rows), indent=1))
    got = records.read_candidates(spark, str(tmp_path / "c.json")).orderBy("seq").collect()
    assert [(r.seq, r.granule_id, r.relative_orbit, str(r.acquisition_date)) for r in got] == [(0, "g1", 17, "2024-01-01"), (1, "g2", None, "None")]


def test_ground_truth(spark, tmp_path):
    (tmp_path / "g.csv").write_text("site_id,lat,lon,date,up_m,sigma_m\nA,35,128,2024-01-01,0.1,\n,35,128,2024-01-01,0.1,\nB,95,128,20240101,0.1,\nC,35,128,soon,0.1,\nD,35,128,20240102,,\nE,35,128,20240102,1,-1\n")
    good, bad = records.read_ground_truth(spark, str(tmp_path / "g.csv"))
    assert [(r.site_id, str(r.date), r.up_m, r.method) for r in good.collect()] == [("A", "2024-01-01", 0.1, "leveling")]
    assert sorted(r.rule for r in bad.collect()) == ["VAL-002", "VAL-003", "VAL-005", "VAL-006", "VAL-007"]


def test_orbits_and_names(spark, tmp_path):
    osv = "<OSV><UTC>UTC=2024-01-01T00:00:0{k}</UTC>" + "".join(f'<{c} unit="m">{{k}}.5</{c}>' for c in ("X", "Y", "Z", "VX", "VY", "VZ")) + "</OSV>"
    (tmp_path / "o.xml").write_text("<F><L>" + "".join(osv.format(k=k) for k in (1, 2)) + "</L></F>")
    got = records.read_orbits(spark, str(tmp_path / "o.xml")).orderBy("time").collect()
    assert [(str(r.time), r.x, r.vz) for r in got] == [("2024-01-01 00:00:01", 1.5, 1.5), ("2024-01-01 00:00:02", 2.5, 2.5)]
    names = spark.createDataFrame([("S1A_OPER_AUX_POEORB_OPOD_20240122T070000_V20240101T225942_20240103T005942.EOF",), ("x",)], "n string")
    got = names.select(*records.orbit_file_parts(F.col("n"))).collect()
    assert (got[0].mission, got[0].kind, str(got[0].start)) == ("S1A", "POEORB", "2024-01-01 22:59:42") and got[1].mission is None


def test_job_list_and_logs(spark, tmp_path):
    (tmp_path / "run_03_x").write_text("# c\n\ncmd a &\nwait\ncmd b\n")
    assert [(r.step, r.line_no, r.command) for r in records.read_job_list(spark, str(tmp_path / "run_03_x")).orderBy("line_no").collect()] == [(3, 3, "cmd a"), (3, 5, "cmd b")]
    logs = tmp_path / "logs" / "deep"
    logs.mkdir(parents=True)
    (logs / "a.log").write_bytes(b"xx\ry\rz")
    (logs / "b.log").write_bytes(b"x\0y")
    (logs / "c.dat").write_bytes(b"x")
    (logs / "d.txt").write_bytes(b"0123456789")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in records.read_logs(spark, str(tmp_path / "logs"), tail=4).collect()}
    assert got == {"a.log": "\ny\nz", "d.txt": "6789"}


def test_append_layers(spark, tmp_path):
    path = str(tmp_path / "store")
    a = spark.createDataFrame([("p1", 1.0), ("p2", 2.0)], "pair string, v double")
    assert records.append_layers(spark, a, path) == 0
    assert records.append_layers(spark, a.union(spark.createDataFrame([("p3", 3.0)], "pair string, v double")), path) == 2
    assert sorted((r.pair, r.v) for r in spark.read.parquet(path).collect()) == [("p1", 1.0), ("p2", 2.0), ("p3", 3.0)]


def test_interval_join(spark):
    points = spark.createDataFrame([(1, 5.0), (1, 25.0), (2, 5.0)], "k int, t double")
    spans = spark.createDataFrame([(1, 0.0, 10.0, "a"), (1, 4.0, 30.0, "b"), (1, 9.0, 3.0, "c")], "k int, s double, e double, n string")
    got = joins.interval_join(points, spans, ["k"], F.col("t"), F.col("s"), F.col("e"), 7.0).collect()
    assert sorted((r.t, r.n) for r in got) == [(5.0, "a"), (5.0, "b"), (25.0, "b")]


def test_six_dates_give_fourteen_pairs(spark):
    d = spark.sql("select 1 as stack, explode(sequence(date'2024-01-01', date'2024-03-01', interval 12 days)) as date, cast(null as double) as bperp")
    assert network.build_pairs(d, ["stack"], max_days=48).count() == 14
    with pytest.raises(ValueError):
        network.build_pairs(d, ["stack"], method="other")


def test_reference_points_are_apart(spark):
    px = spark.createDataFrame([(r, c, 1.0 / (1 + abs(r - 5) + abs(c - 5))) for r in range(12) for c in range(12)], "row long, col long, score double")
    got = [(r.row, r.col) for r in series.top_separated(px, 3, 4).orderBy("place").collect()]
    assert got[0] == (5, 5) and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) >= 4 for i, a in enumerate(got) for b in got[:i])


def test_axis_tiles():
    assert grids.axis_tiles(10, 3, 3) == [(0, 5, 0, 3), (2, 9, 3, 7), (6, 10, 7, 10)]
    with pytest.raises(ValueError):
        grids.axis_tiles(3, 4, 0)


def test_running_totals_over_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 101).alias("o"), "id", F.lit(2).cast("long").alias("v"))
    got = sorted((r.o, r.id, r.c) for r in storage.running(df, ["o", "id"], {"c": "v"}).collect())
    assert [c for _, _, c in got] == list(range(2, 2002, 2))


def test_first_wins(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "k int, seq int, v string")
    assert sorted((r.k, r.v) for r in frames.first_wins(df, ["k"], ["seq"]).collect()) == [(1, "a"), (2, "c")]
