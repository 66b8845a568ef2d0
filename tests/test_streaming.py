from fringeflow.streaming import ingest


def test_append_once(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    rows = spark.createDataFrame([("p1", 1.0), ("p2", 2.0)], "pair string, v double")
    rows.coalesce(1).write.parquet(src)
    for k in range(2):
        ingest.append_once(ingest.arriving(spark, src, "pair string, v double"), store, str(tmp_path / f"ck{k}")).awaitTermination(120)
    assert sorted((r.pair, r.v) for r in spark.read.parquet(store).collect()) == [("p1", 1.0), ("p2", 2.0)]


def test_windowed_means(spark, tmp_path):
    src = str(tmp_path / "e")
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as k, 1.0d as v union all select timestamp'2024-01-01 00:50:00', 'a', 3.0d").coalesce(1).write.parquet(src)
    out = ingest.windowed_means(ingest.arriving(spark, src, "ts timestamp, k string, v double"), "ts", ["k"], "v")
    q = out.writeStream.outputMode("complete").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.k, r["mean"], r.n) for r in spark.table("means").collect()] == [("a", 2.0, 2)]
