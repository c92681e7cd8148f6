from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import calendar
from orbweave.operators import analysis, timeaxis, timeseries
from orbweave.sources import readers, writers
from orbweave.streaming import quadrature as stream


def epochs(spark, n=24, step=30):
    rows = [(k, dt.datetime(2002, 1, 1) + dt.timedelta(days=step * k + k % 2)) for k in range(n)]
    return spark.createDataFrame(rows, "epoch_id int, ts timestamp_ntz")


def test_midpoint_of_a_model_name(spark):
    row = timeaxis.from_names(spark.createDataFrame([("GSM-2_2002095-2002120_GRAC_UTCSR_BA01_0600.gfc",), ("other.txt",)], "name string")).orderBy("name").collect()
    assert row[0]["mid"] == dt.datetime(2002, 4, 18) and row[0]["center"] == "UTCSR"
    assert row[1]["mid"] is None and row[1]["product"] is None


def test_headers(spark):
    rows = [("time_period_of_data 20020405 - 20020430 (mid: 20020418)",), ("time_coverage_start 2021-12-01T00:00:00\ntime_coverage_end 2022-01-01T00:00:00",)]
    start, last = calendar.header_period(F.col("h"))
    got = spark.createDataFrame(rows, "h string").select(start.alias("a"), last.alias("b"), calendar.midpoint(start, last)[0].alias("mid")).collect()
    assert got[0]["mid"] == dt.datetime(2002, 4, 18)
    assert got[1]["b"] == dt.date(2021, 12, 31) and got[1]["mid"] == dt.datetime(2021, 12, 16, 12)


def test_numeric_time(spark):
    got = spark.range(1).select(calendar.numeric_time(F.lit(1.5), "days since 2000-01-01").alias("t")).first()["t"]
    assert got == dt.datetime(2000, 1, 2, 12)
    with pytest.raises(ValueError):
        calendar.numeric_time(F.lit(1.0), "months since 2000-01-01")


def test_fit_recovers_terms(spark):
    e = epochs(spark)
    sec = [(r["ts"] - dt.datetime(1970, 1, 1)).total_seconds() for r in e.orderBy("epoch_id").collect()]
    years = (np.array(sec) - (min(sec) + max(sec)) / 2) / (86400 * 365.25)
    rows = [(k, n, 0, 1.0 + 2 * y * n + 0.5 * np.cos(2 * np.pi * y) - 0.3 * np.sin(2 * np.pi * y), 0.0) for k, y in enumerate(years.tolist()) for n in range(3)]
    series = spark.createDataFrame([(k, n, m, float(c), s) for k, n, m, c, s in rows], analysis.COEFFS)
    f = timeseries.fit(series, e, 1, [1.0])
    for n in range(3):
        t = {r["term"]: r["c"] for r in f.frame.where(F.col("n") == n).collect()}
        assert t["const"] == pytest.approx(1.0) and t["trend"] == pytest.approx(2.0 * n, abs=1e-9)
        assert t["cos1"] == pytest.approx(0.5) and t["sin1"] == pytest.approx(-0.3)
    assert f.amplitude_phase(1.0).first()["amplitude_c"] == pytest.approx(np.hypot(0.5, 0.3))
    left = timeseries.anomaly_reduction(series, f).agg(F.max("residual_rms")).first()[0]
    assert left < 1e-9
    with pytest.raises(ValueError, match="epochs for"):
        timeseries.fit(series, e, 1, [1.0], keep=[0, 1, 2])
    holes = series.withColumn("c", F.when((F.col("epoch_id") == 3) & (F.col("n") == 1), float("nan")).otherwise(F.col("c")))
    with pytest.raises(ValueError, match="lacks"):
        timeseries.fit(holes, e)


def test_missing_epochs_weigh_nothing(spark):
    rows = [(k, 0, 0, float("nan") if k == 2 else float(k), 0.0) for k in range(5)]
    series = spark.createDataFrame(rows, analysis.COEFFS)
    assert timeseries.time_mean(series).first()["c"] == pytest.approx((0 + 1 + 3 + 4) / 4)
    out = timeseries.gaussian_in_time(series, epochs(spark, 5), 0.1)
    assert out.count() == 5 and out.where("isnan(c)").count() == 0


def test_epoch_tables(spark):
    e = epochs(spark, 6).unionByName(spark.createDataFrame([(9, dt.datetime(2002, 1, 1, 6)), (10, dt.datetime(2003, 1, 1))], "epoch_id int, ts timestamp_ntz"))
    assert {r["epoch_id"] for r in timeaxis.duplicates(e).collect()} == {0, 9}
    assert [r["epoch_id"] for r in timeaxis.missing(e).collect()] == [10]
    assert {r["epoch_id"] for r in timeaxis.resolve_duplicates(e, "first").collect()} == {0, 1, 2, 3, 4, 5, 10}
    assert {r["epoch_id"] for r in timeaxis.resolve_duplicates(e, "last").collect()} == {9, 1, 2, 3, 4, 5, 10}
    with pytest.raises(ValueError):
        timeaxis.resolve_duplicates(e)
    with pytest.raises(ValueError, match="no epoch"):
        timeaxis.between(e, F.lit("1990-01-01").cast("timestamp_ntz"), F.lit("1991-01-01").cast("timestamp_ntz"))


def test_outliers(spark):
    t = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 1.1, 0.9, 1.05, 9.0, None])], "k int, value double")
    assert {r["k"] for r in timeseries.outliers(t).where("outlier").collect()} == {4, 5}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufefflon,lat,2002-01,2002-02\n-10,5,1,2\n20,6,3,4\n400,95,1,1\n", encoding="utf-8")
    p = readers.read_points(spark, str(tmp_path / "a.csv")).orderBy("lon", "epoch_id").collect()
    assert [(r["lon"], r["lat"], r["label"], r["value"]) for r in p] == [(20.0, 6.0, "2002-01", 3.0), (20.0, 6.0, "2002-02", 4.0), (350.0, 5.0, "2002-01", 1.0), (350.0, 5.0, "2002-02", 2.0)]
    (tmp_path / "b.txt").write_text("1 2 3.5\n4 5 6.5\n")
    assert sorted((r["lon"], r["lat"], r["value"]) for r in readers.read_points(spark, str(tmp_path / "b.txt")).collect()) == [(1.0, 2.0, 3.5), (4.0, 5.0, 6.5)]
    (tmp_path / "g.grd").write_text("\ufeffDSAA\n3 2\n0 240\n-45 45\n1 6\n1 2 3\n4 5 6\n", encoding="utf-8")
    grid = readers.read_surfer(spark, str(tmp_path / "g.grd"))
    assert [(r["lat"], r["lon"], r["value"]) for r in grid.orderBy("ilat", "ilon").collect()] == [(-45.0, 0.0, 1.0), (-45.0, 120.0, 2.0), (-45.0, 240.0, 3.0), (45.0, 0.0, 4.0), (45.0, 120.0, 5.0), (45.0, 240.0, 6.0)]
    (tmp_path / "again.grd").write_text(writers.surfer_text(grid))
    assert readers.read_surfer(spark, str(tmp_path / "again.grd")).exceptAll(grid).count() == 0
    rows = [(0, n, m, n + m / 10, m * 1.5) for n in range(4) for m in range(n + 1)]
    x = spark.createDataFrame([(e, n, m, float(c), float(s)) for e, n, m, c, s in rows], analysis.COEFFS)
    writers.write_lines(writers.triangle_lines(x, 3), str(tmp_path / "t"))
    assert readers.read_triangle(spark, str(tmp_path / "t")).select("n", "m", "c", "s").exceptAll(x.select("n", "m", "c", "s")).count() == 0
    with pytest.raises(ValueError, match="triangle"):
        readers.degree_of(13)
    with pytest.raises(ValueError, match="one epoch"):
        writers.gfc_lines(x.unionByName(x.withColumn("epoch_id", F.lit(1))), 3)


def test_legacy_tables(spark, tmp_path):
    rows = [(k, dt.datetime(2003, k + 1, 1), dt.datetime(2003, k + 1, 20), dt.datetime(2003, k + 1, 10, 12)) for k in range(3)]
    e = spark.createDataFrame(rows, "epoch_id int, start timestamp_ntz, end timestamp_ntz, ts timestamp_ntz")
    table = timeaxis.legacy_table(e).orderBy("idx").collect()
    (tmp_path / "TimeInfo.dat").write_text("\n".join(" ".join(map(str, r)) for r in table))
    back = readers.read_legacy_times(spark, str(tmp_path / "TimeInfo.dat")).orderBy("epoch_id").collect()
    assert all(abs((a["ts"] - b[3]).total_seconds()) < 20 for a, b in zip(back, rows)) and len(back) == 3
    (tmp_path / "s.dat").write_text("a b\n1 2\n3 4\n5 6\n0 0\n0 0\n7 8\n")
    x = readers.read_triangle(spark, str(tmp_path / "s.dat"), skip=1).orderBy("epoch_id", "m", "n").collect()
    assert [(r["epoch_id"], r["n"], r["m"], r["c"], r["s"]) for r in x][:3] == [(0, 0, 0, 1.0, 0.0), (0, 1, 0, 3.0, 0.0), (0, 1, 1, 5.0, 7.0)]


def test_series_of_model_files(spark, tmp_path):
    names = ["GSM-2_2002095-2002120_GRAC_UTCSR_BA01_0600.gfc", "GSM-2_2002123-2002137_GRAC_UTCSR_BA01_0600.gfc", "GAC-2_2002095-2002120_GRAC_UTCSR_BA01_0600.gfc"]
    for k, name in enumerate(names):
        lines = [f"gfc {n} {m} {n + m + k}.5D0 {m}.25 0.1 0.1" for n in range(3 - k % 2) for m in range(n + 1)]
        (tmp_path / name).write_text("\ufeffmax_degree 2\nend_of_head\n" + "\n".join(lines) + "\n", encoding="utf-8")
    x, e = readers.read_series(spark, str(tmp_path), product="GSM")
    assert [r["ts"] for r in e.orderBy("epoch_id").collect()] == [dt.datetime(2002, 4, 18), dt.datetime(2002, 5, 10, 12)]
    assert x.count() == 12 and x.where("epoch_id = 1 and n = 2").agg(F.max(F.abs("c"))).first()[0] == 0
    with pytest.raises(ValueError, match="degrees"):
        readers.read_series(spark, str(tmp_path), product="GSM", strict_nmax=True)
    with pytest.raises(ValueError, match="coincide"):
        readers.read_series(spark, str(tmp_path))


def test_layouts_love_numbers_and_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("max_degree 1\nend_of_head\ngfc 0 0 1 0\ngfc 1 0 2 0\ngfc 1 1 3 4\n")
    (tmp_path / "b.txt").write_text("n,m,C,S,C_t1,S_t1\n0,0,1,0,5,0\n1,0,2,0,6,0\n1,1,3,4,7,8\n")
    (tmp_path / "c.txt").write_text("# title\n1\n2\n3\n0\n0\n4\n")
    assert [readers.detect_layout(spark, str(tmp_path / f"{x}.txt")) for x in "abc"] == ["gfc", "csv", "triangle"]
    for x in "abc":
        got = readers.read_coeffs(spark, str(tmp_path / f"{x}.txt")).where("epoch_id = 0").orderBy("n", "m").collect()
        assert [(r["n"], r["m"], r["c"], r["s"]) for r in got] == [(0, 0, 1.0, 0.0), (1, 0, 2.0, 0.0), (1, 1, 3.0, 4.0)]
    (tmp_path / "love.txt").write_text("n h l k\n0 -0.1 0 0\n1 -0.2 0.1 -0.3\n")
    assert readers.read_love(spark, str(tmp_path / "love.txt")).orderBy("n").collect()[1].asDict() == {"n": 1, "h": -0.2, "l": 0.1, "k": -0.3}
    labels = spark.createDataFrame([(0, "2002"), (1, "2002-03"), (2, "2002-03-04")], "epoch_id int, label string")
    assert [r["ts"] for r in timeaxis.from_labels(labels).orderBy("epoch_id").collect()] == [dt.datetime(2002, 1, 1), dt.datetime(2002, 3, 1), dt.datetime(2002, 3, 4)]
    with pytest.raises(Exception, match="no date"):
        timeaxis.from_labels(labels.withColumn("label", F.lit("spring"))).collect()
    assert timeaxis.from_index(spark, 3).where("ts is null").count() == 3
    p = spark.createDataFrame([(0.0, 1.0), (0.0, 1.0), (2.0, 3.0)], "lat double, lon double")
    assert not readers.looks_tidy(p) and readers.looks_tidy(p.union(p))


def test_delimiters_and_dates():
    assert readers.sniff(["a;b;c", "1,5;2;3"]) == ";" and readers.sniff(["a\tb,c"]) == "\t" and readers.sniff(["1 2 3"]) == " "
    assert readers.look_like_dates(["2002-01", "2002-02"]) and not readers.look_like_dates(["2002-02", "2002-01"])
    assert readers.resolve(["Lat", "Lon"], "lat", ()) == 0 and readers.resolve(["a", "b"], -1, ()) == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, k), 10.0 * (k % 17) - 80, 20.0 * (k % 18), float(k)) for k in range(60)], "ts timestamp, lat double, lon double, value double").withColumn("w", F.lit(1.0))
    rows.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.windowed(s, "ts", "30 minutes", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["n"], r["m"]): r["c"] for r in spark.table("w").collect()}
    batch = stream.low_degrees(rows.withColumn("start", F.window("ts", "30 minutes")["start"]), ["start"]).collect()
    assert len(got) == len(batch) == 12
    assert all(got[(r["start"], r["n"], r["m"])] == pytest.approx(r["c"]) for r in batch)


def test_stream_of_degree_8_restarts_and_leaves_late_rows_out(spark, tmp_path):
    from orbweave.operators import analysis

    rng = np.random.default_rng(6)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=float(t)), float(a), float(b), float(v), 0.5) for t, a, b, v in zip(np.sort(rng.uniform(0, 120, 300)), rng.uniform(-90, 90, 300), rng.uniform(0, 360, 300), rng.normal(size=300))]
    schema = "ts timestamp, lat double, lon double, value double, w double"
    late = [(start + dt.timedelta(minutes=1), 10.0, 10.0, 1e6, 1.0)]
    odd = [(None, 1.0, 1.0, 1.0, 1.0), (start, None, 1.0, 1.0, 1.0), (start, 1.0, 1.0, float("nan"), 1.0)]
    parts = [rows[:140:2] + rows[140:150] + odd, rows[150:] + rows[1:140:2], [(start + dt.timedelta(minutes=400), 0.0, 0.0, 1.0, 1.0)], late]
    out = {}
    for k, part in enumerate(parts):  # each a run of its own: the state comes from the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = stream.windowed_degrees(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 8, 1800, "100 minutes")
        q = s.writeStream.outputMode("append").trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination()
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        assert (r["start"], r["n"], r["m"]) not in out
        out[r["start"], r["n"], r["m"]] = (r["c"], r["s"])
    df = spark.createDataFrame(rows, schema).withColumn("epoch_id", F.floor(F.unix_seconds("ts") / 1800).cast("int"))
    want = {(r["start"], r["n"], r["m"]): (r["c"], r["s"]) for r in analysis.quadrature(df, 8).withColumn("start", F.timestamp_seconds(F.col("epoch_id") * 1800)).collect()}
    assert out.keys() == want.keys() and len(want) == 4 * 45
    assert all(np.allclose(out[k], want[k], atol=1e-10) for k in want)


def test_fit_at_other_dates(spark):
    e = epochs(spark)
    start = dt.datetime(1970, 1, 1)
    sec = np.array([(r["ts"] - start).total_seconds() for r in e.orderBy("epoch_id").collect()])
    years = (sec - (sec.min() + sec.max()) / 2) / (86400 * 365.25)
    kick = [float(k % 3 == 0) for k in range(len(years))]
    series = spark.createDataFrame([(k, 1, 0, float(1 + 2 * y + 0.5 * np.cos(2 * np.pi * y) + 0.7 * z), 0.0) for k, (y, z) in enumerate(zip(years, kick))], analysis.COEFFS)
    extra = spark.createDataFrame([(k, z) for k, z in enumerate(kick)], "epoch_id int, kick double")
    f = timeseries.fit(series, e, 1, [1.0], extra=extra)
    assert f.term("kick").first()["c"] == pytest.approx(0.7)
    later = dt.datetime(2010, 7, 1)
    at = spark.createDataFrame([(1, dt.datetime(2003, 1, 1), 0.0), (2, later, 1.0)], "epoch_id int, ts timestamp_ntz, kick double")
    got = {r["epoch_id"]: r for r in f.evaluate(at).collect()}
    y = ((later - start).total_seconds() - f.tref) / (86400 * 365.25)
    assert got[2]["c"] == pytest.approx(1 + 2 * y + 0.5 * np.cos(2 * np.pi * y) + 0.7) and got[2]["extrapolated"] and not got[1]["extrapolated"]
    text = f.summary()
    assert "kick" in text and "24 of 24" in text and "100.0 %" in text
    with pytest.raises(ValueError, match="extra term"):
        timeseries.fit(series, e, 1, extra=extra.where("epoch_id > 0"))


def test_axes_from_anything(spark):
    assert timeaxis.axis_from(spark, None) is None and timeaxis.axis_from(spark, ["spring"]) is None
    first = lambda x: x.orderBy("epoch_id").first()
    assert first(timeaxis.axis_from(spark, ["2002-03", "2002-04-05T12:00:00Z"]))["ts"] == dt.datetime(2002, 3, 1)
    assert first(timeaxis.axis_from(spark, [dt.date(2002, 3, 4)]))["ts"] == dt.datetime(2002, 3, 4)
    assert first(timeaxis.axis_from(spark, {"values": [129.5], "units": "days since 2002-01-01"}))["ts"] == dt.datetime(2002, 5, 10, 12)
    for values, units in (([1.0, 2.0], None), ([1.0], "months since 2002-01-01")):
        row = first(timeaxis.axis_from(spark, values, units))
        assert row["ts"] is None and row["kind"] == "index" and row["note"]
    e = timeaxis.axis_from(spark, ["2002-03-01", "2002-04-01"])
    again = timeaxis.from_dict(spark, timeaxis.to_dict(e))
    assert again.select("epoch_id", "ts", "kind").exceptAll(e.select("epoch_id", "ts", "kind")).count() == 0
    x = spark.createDataFrame([(k, 0, 0, 1.0, 0.0) for k in range(2)], analysis.COEFFS)
    assert timeaxis.with_times(x, e).count() == 2
    with pytest.raises(ValueError, match="no row"):
        timeaxis.with_times(x, e.where("epoch_id = 0"))
    with pytest.raises(ValueError, match="twice"):
        timeaxis.with_times(x, e.unionByName(e))


def test_headers_sigmas_and_field_series(spark, tmp_path):
    x = spark.createDataFrame([(0, n, m, n + m / 10, m * 1.5, 0.1, 0.2) for n in range(3) for m in range(n + 1)], "epoch_id int, n int, m int, c double, s double, sc double, ss double")
    writers.write_lines(writers.gfc_lines(x, 2, meta={"unit": "ewh"}), str(tmp_path / "g"))
    back = readers.read_gfc(spark, str(tmp_path / "g"))
    assert back.select("n", "m", "c", "s", "sc", "ss").exceptAll(x.drop("epoch_id")).count() == 0
    meta = {r["key"]: r["value"] for r in readers.read_meta(spark, str(tmp_path / "g")).collect()}
    assert meta["unit"] == "ewh" and meta["max_degree"] == "2" and meta["errors"] == "formal"
    two = x.drop("sc", "ss").unionByName(x.drop("sc", "ss").withColumn("epoch_id", F.lit(1)).withColumn("c", F.col("c") * 2))
    for lines, read in ((writers.coeff_csv_lines(two, 2), readers.read_coeff_csv), (writers.triangle_lines(two, 2, {0: "2002 01", 1: "2002 02"}), readers.read_triangle)):
        path = str(tmp_path / read.__name__)
        writers.write_lines(lines, path)
        assert read(spark, path).exceptAll(two).count() == 0
    field = spark.createDataFrame([(e, lat, lon, float(e)) for e in range(2) for lat in (-10.0, 10.0) for lon in (0.0, 190.0)], "epoch_id int, lat double, lon double, value double")
    e = epochs(spark, 2)
    writers.write_field(field, str(tmp_path / "f"), e)
    got, table = readers.read_field_series(spark, str(tmp_path / "f"))
    assert got.exceptAll(field).count() == 0 and table.exceptAll(e).count() == 0
    assert "PartitionFilters: [isnotnull(epoch_id" in got.where("epoch_id = 1")._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="rise"):
        writers.write_field(field, str(tmp_path / "h"), e.withColumn("ts", F.lit("2002-01-01").cast("timestamp_ntz")))


def test_ids_follow_the_rows(spark, tmp_path):
    lines = [f"{k % 360},{k % 90},{k}" for k in range(200)] + ["5,5,1.0", "5,5,1.0"]
    for name, parts in (("a", 1), ("b", 5)):
        spark.createDataFrame([(x,) for x in lines], "value string").repartition(parts).write.text(str(tmp_path / name))
    a, b = (readers.read_points(spark, str(tmp_path / x)).select("point_id", "lat", "lon", "value") for x in "ab")
    assert a.exceptAll(b).count() == 0 and a.select("point_id").distinct().count() == 202


def test_order_gaps_and_conflicts_of_files(spark, tmp_path):
    import warnings as w

    names = ["GSM-2_2002095-2002120_GRAC_UTCSR_BA01_0600.gfc", "GSM-2_2002305-2002334_GRAC_UTCSR_BA01_0600.gfc"]
    for name in names:
        head = "time_period_of_data 20020601 - 20020630\n" if "095" in name else ""
        (tmp_path / name).write_text(f"{head}max_degree 0\nend_of_head\ngfc 0 0 1 0\n")
    with w.catch_warnings(record=True) as said:
        w.simplefilter("always")
        _, e = readers.read_series(spark, str(tmp_path), on_missing="warn", order="name")
    assert [r["label"] for r in e.orderBy("epoch_id").collect()] == names
    assert any("differ" in str(x.message) for x in said) and any("missing" in str(x.message) for x in said)
    with pytest.raises(ValueError, match="missing"), w.catch_warnings():
        w.simplefilter("ignore")
        readers.read_series(spark, str(tmp_path), on_missing="error", epoch_from="filename")
    (tmp_path / "list.txt").write_text("# files\n" + "\n".join(names))
    listed = readers.read_manifest(spark, str(tmp_path / "list.txt"))
    assert readers.read_series(spark, listed, product="GSM", epoch_from="filename")[1].count() == 2
    with pytest.raises(ValueError, match="fit"):
        readers.read_series(spark, listed, product="GAC")


def test_places_in_the_triangle(spark):
    from orbweave.functions import geo

    rows = spark.createDataFrame([(n, m) for n in range(7) for m in range(n + 1)], "n int, m int").withColumn("k", geo.triangle_index(F.col("n"), F.col("m"), 6))
    n, m = geo.degree_and_order(F.col("k"), 6)
    assert rows.where((n != F.col("n")) | (m != F.col("m"))).count() == 0 and rows.select("k").distinct().count() == 28
    cell = float(np.radians(1.0)) ** 2
    got = spark.createDataFrame([(cell / 2,), (cell * 2,), (0.0,)], "w double").select(geo.equivalent_lat_step(F.col("w")).alias("x")).collect()
    assert got[0]["x"] == pytest.approx(60.0) and got[1]["x"] == 0.0 and got[2]["x"] is None


def test_axes_of_grids(spark, tmp_path):
    (tmp_path / "g.csv").write_text("lat,lon,z\n10,350,1\n-10,0,2\n10,0,3\n-10,350,4\n")
    got = {(r["ilat"], r["ilon"]): r["value"] for r in readers.read_grid_csv(spark, str(tmp_path / "g.csv")).collect()}
    assert got == {(0, 0): 2.0, (0, 1): 4.0, (1, 0): 3.0, (1, 1): 1.0}
