"""Readers of products, annotations, arrays; reports."""

import datetime
import json

import numpy as np
from pyspark.sql import functions as F

from fringeflow.sources import arrays, products, reports

POINT = "<geolocationGridPoint><line>{}</line><pixel>{}</pixel><incidenceAngle>{}</incidenceAngle></geolocationGridPoint>"


def content(swath, points):
    return (
        f"<adsHeader><missionId>S1A</missionId><polarisation>VV</polarisation><mode>IW</mode><swath>{swath}</swath><startTime>2024-04-08T01:50:45.343649</startTime><absoluteOrbitNumber>53336</absoluteOrbitNumber></adsHeader>"
        "<generalAnnotation><productInformation><pass>Ascending</pass><platformHeading>-12.9</platformHeading></productInformation></generalAnnotation>"
        "<imageAnnotation><imageInformation><rangePixelSpacing>2.33e+00</rangePixelSpacing><azimuthPixelSpacing>13.97</azimuthPixelSpacing></imageInformation></imageAnnotation>"
        '<swathTiming><linesPerBurst>1497</linesPerBurst><burstList count="10"><burst><azimuthTime>x</azimuthTime></burst></burstList></swathTiming>'
        f"<geolocationGrid><geolocationGridPointList>{''.join(POINT.format(*p) for p in points)}</geolocationGridPointList></geolocationGrid>"
    )


GRID = [(0, 0, 30.0), (0, 10, 33.0), (0, 20, 36.0), (9, 0, 31.0), (9, 20, 38.0)]
SOFTWARE = '<x xmlns:safe="http://s"><safe:software name="L0" version="001.00"/><safe:software name="Sentinel-1 IPF" version="003.71"/><safe:software name="" version=""/></x>'


def test_annotations_and_manifests(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f"<?xml version='1.0'?><product>{content('IW1', GRID)}</product>")
    r = products.read_annotations(spark, str(tmp_path / "a.xml")).collect()
    assert len(r) == 1
    assert (r[0].swath, r[0].incidence_near_deg, r[0].incidence_far_deg, r[0].range_pixel_spacing_m, r[0].n_bursts, r[0].absolute_orbit) == ("IW1", 30.5, 37.0, 2.33, 10, 53336)
    (tmp_path / "m.safe").write_text(SOFTWARE)
    assert products.read_manifests(spark, str(tmp_path / "m.safe")).first().ipf_version == "003.71"
    (tmp_path / "n.safe").write_text('<x><safe:software xmlns:safe="http://s" name="other" version=" 2.0 "/></x>')
    assert products.read_manifests(spark, str(tmp_path / "n.safe")).first().ipf_version == "2.0"


def test_burst_metadata(spark, tmp_path):
    one = lambda s, pol, g: f'<product source_filename="{s}.xml"><swath>{s}</swath><polarisation>{pol}</polarisation><content>{content(s, g)}</content></product>'
    (tmp_path / "b.xml").write_text(f"<burst><manifest>{SOFTWARE}</manifest><metadata>{one('IW1', 'VV', GRID[:1])}{one('IW2', 'VH', GRID)}</metadata></burst>")
    read = lambda **k: products.read_burst_metadata(spark, str(tmp_path / "b.xml"), **k).collect()
    assert [(r.source_filename, r.incidence_far_deg) for r in read()] == [("IW1.xml", 30.0)]
    (r,) = read(subswath="iw2", polarization="vh")
    assert (r.swath, r.incidence_near_deg, r.available_swaths, r.ipf_version) == ("IW2", 30.5, ["IW1", "IW2"], "003.71")
    assert read(subswath="IW3") == []
    rows = spark.createDataFrame([("a", None, 1.0, "9"), ("b", 5.0, None, None)], "k string, range_pixel_spacing_m double, incidence_near_deg double, ipf_version string")
    notes = products.read_burst_metadata(spark, str(tmp_path / "b.xml")).withColumn("k", F.lit("a"))
    got = {r.k: (r.range_pixel_spacing_m, r.incidence_near_deg, r.ipf_version) for r in products.enriched(rows, notes.drop("azimuth_pixel_spacing_m", "incidence_far_deg"), "k").collect()}
    assert got == {"a": (2.33, 30.0, "003.71"), "b": (5.0, None, None)}


def test_products(spark, tmp_path):
    made = lambda name, t, **more: {"properties": {"sceneName": name, "platform": "Sentinel-1A", "pathNumber": 52, "flightDirection": "DESCENDING", "polarization": "VV+VH", "processingLevel": "SLC", "beamModeType": "IW", "startTime": t, "pgeVersion": "003.71", **more}}
    sv = {"stateVectors": {"positions": {"prePosition": [1, 2, 3], "prePositionTime": "2024-01-01T00:00:00Z", "postPosition": [4, 5, 6], "postPositionTime": "2024-01-01T00:00:10Z"}, "velocities": {"preVelocity": [0, 1, 0], "postVelocity": [0, 1, 0]}}}
    items = [
        made("A", "2024-01-02T09:20:00Z") | {"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "baseline": sv},
        made("A", "2024-01-03T09:20:00Z"), made("B", "2024-01-01T18:20:00+09:00", processingLevel="BURST", burst={"subswath": "IW2", "fullBurstID": "052_109903_IW2"}, flightDirection="sideways"),
        made("C", "2024-01-05T00:00:00") | {"umm": {"AdditionalAttributes": [{"Name": "SUBSWATH_NAME", "Values": ["N/A"]}, {"Name": "BEAM_MODE", "Values": ["EW"]}]}, "baseline": {"stateVectors": {"positions": {"prePosition": [1, 2, 3]}}}},
    ]
    (tmp_path / "p.json").write_text(json.dumps({"products": items}))
    got = {r.granule_id: r for r in products.read_products(spark, str(tmp_path / "p.json"), "vh").collect()}
    assert set(got) == {"A", "B", "C"}
    a, b, c = got["A"], got["B"], got["C"]
    assert (a.acquisition_time, a.polarization, a.platform, a.ipf_version, a.product_type, a.full_burst_id) == (datetime.datetime(2024, 1, 2, 9, 20), "VH", "S1A", "3.71", "SLC", "A")
    assert a.footprint_wkt == "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0))" and a.state_vectors.post.position == [4, 5, 6]
    assert (b.acquisition_time, b.full_burst_id, b.subswath, b.product_type, b.flight_direction) == (datetime.datetime(2024, 1, 1, 9, 20), "052_109903_IW2", "IW2", "BURST", None)
    assert (c.subswath, c.state_vectors, c.footprint_wkt) == ("IW", None, "POLYGON EMPTY")


def test_pair_stacks_and_series(spark, tmp_path):
    w = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    w[0, 0, 0] = np.nan
    np.savez(tmp_path / "s.npz", wrapped=w, coherence=w * 0 + 0.5, mask=np.eye(3, 4, dtype=bool), pairs=np.array(["20240101_20240113", "20240101_20240125"]), dates=np.array(["2024-01-01"]))
    s = arrays.read_pair_stack(spark, str(tmp_path / "s.npz"))
    assert s.count() == 24 and s.where("wrapped is null").count() == 1 and s.where("unw is not null").count() == 0
    assert [r.wrapped for r in arrays.point(s, 2, 1).collect()] == [9.0, 21.0]
    assert arrays.layer(s, "20240101_20240125").count() == 12
    assert sorted(r.wrapped for r in arrays.window(s, (1, 3), (0, 1)).collect()) == [4.0, 8.0, 16.0, 20.0]
    assert s.where("mask").count() == 6
    info = arrays.store_info(s).first()
    assert (info.n_pairs, info.n_pixels, info.n_rows, info.n_wrapped, info.n_unw) == (2, 12, 24, 23, 0)
    np.savez(tmp_path / "t.npz", displacement_m=w, dates=np.array(["2024-01-01", "2024-01-13"]))
    around = arrays.read_time_series(spark, str(tmp_path / "t.npz"))
    assert abs(around.agg(F.avg("lat")).first()[0] - 37.55) < 1e-9
    corner = arrays.read_time_series(spark, str(tmp_path / "t.npz"), corner=(37.6, 126.9)).where("row = 0 and col = 0").first()
    assert (corner.lat, corner.lon) == (37.6, 126.9)
    d = spark.createDataFrame([("2024-01-01", "2024-01-13", 0, 0, 2.0), ("2024-01-13", "2024-01-25", 0, 0, 9.0), ("2024-01-01", "2024-01-25", 0, 0, 3.0)], "ref string, date string, row int, col int, value double")
    got = sorted((r.date, r.displacement_m) for r in arrays.from_first_date(d, -2.0).collect())
    assert got == [("2024-01-01", 0.0), ("2024-01-13", -4.0), ("2024-01-25", -6.0)]


def test_flat_rasters(spark, tmp_path):
    a = (np.arange(24).reshape(2, 3, 4) + 1).astype(np.float64)
    for scheme, order, kind, laid in (("BSQ", "l", "<f4", a), ("BIL", "b", ">f8", a.transpose(1, 0, 2)), ("BIP", "l", "<c8", a.transpose(1, 2, 0) * (1 + 2j))):
        name = {"<f4": "FLOAT", ">f8": "DOUBLE", "<c8": "CFLOAT"}[kind]
        (tmp_path / f"{scheme}.bin").write_bytes(laid.astype(kind).tobytes())
        values = {"WIDTH": 4, "length": 3, "data_type": name.lower(), "scheme": scheme, "number_bands": 2, "byte_order": order}
        (tmp_path / f"{scheme}.bin.xml").write_text("<imageFile>" + "".join(f'<property name="{k}"><value>{v}</value></property>' for k, v in values.items()) + "</imageFile>")
    rows = arrays.read_rasters(spark, str(tmp_path / "*.bin*")).collect()
    assert len(rows) == 72
    for r in rows:
        want = a[r.band, r.row, r.col]
        assert r.re == want and (r.im == 2 * want if "BIP" in r.path else r.im is None)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1.5, 2.0, None, datetime.date(2024, 1, 1), 0.25, None, None, "gnss", 1.0)], "site_id string, lat double, lon double, elev_m double, date date, up_m double, east_m double, north_m double, method string, sigma_mm double")
    assert list(reports.ground_truth_rows(df).first()) == ["s1", "1.5000000", "2.0000000", "", "2024-01-01", "0.250000", "", "", "gnss", "1.000"]
    reports.write_ground_truth(df, str(tmp_path / "g"))
    assert spark.read.csv(str(tmp_path / "g"), header=True).first().lat == "1.5000000"
    f = spark.createDataFrame([("WARN", "B", "x|y", "token=abc\n z"), ("FAIL", "C", "x", None)], "severity string, rule string, scope string, detail string")
    assert [r.line for r in reports.findings_lines(f).orderBy("level", "rule").collect()] == ["| FAIL | C | x |  |", "| WARN | B | x\\|y | token=*** z |"]
    assert json.loads(reports.envelope(f, "check").first().value) == {"ok": False, "command": "check", "n": {"FAIL": 1, "WARN": 1, "INFO": 0}}
    assert json.loads(reports.masked_json(f.where("rule = 'B'")).first().value)["detail"].startswith("token=***")
    codes = spark.createDataFrame([(True, True, True), (False, True, True), (True, False, True), (False, False, True), (True, True, False)], "l boolean, s boolean, v boolean")
    assert [r[0] for r in codes.select(reports.layover_shadow_code(F.col("l"), F.col("s"), F.col("v"))).collect()] == [3, 2, 1, 0, 255]
