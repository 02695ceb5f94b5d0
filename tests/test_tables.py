from panel_helpers import t, values
from pyspark.sql import functions as F

from panelweave.functions import names
from panelweave.operators import ingest, worklist
from panelweave.schemas import RAW_COLUMNS
from panelweave.sources import raw_csv, tables
from panelweave.streaming import incremental


def raw_line(**values):
    base = {c: "x" for c in RAW_COLUMNS} | {
        "AirQualityStationEoICode": "S1", "SamplingPoint": "SPO-1", "AirPollutant": "NO", "AveragingTime": "hour",
        "Concentration": "1.0", "DatetimeBegin": "2020-01-01 00:00:00 +01:00", "DatetimeEnd": "2020-01-01 01:00:00 +01:00",
        "Validity": "1", "Verification": "1"}
    return ",".join(str((base | values)[c]) for c in RAW_COLUMNS)


def write_raw(path, *lines):
    path.write_text("\n".join([",".join(RAW_COLUMNS), *lines]) + "\n", encoding="utf-16")


def test_ingest_raw_files(spark, tmp_path):
    import os
    raw = tmp_path / "raw"
    raw.mkdir()
    write_raw(raw / "a.csv", raw_line(), raw_line(SamplingPoint="X_BULK_1", Concentration="99"),
              raw_line(SamplingPoint="", DatetimeEnd="2020-01-01 02:00:00 +01:00", Concentration="2"),
              raw_line(DatetimeEnd="2020-01-01 03:00:00 +01:00", Concentration="1.0"),
              raw_line(DatetimeEnd="2020-01-01 03:00:00 +01:00", Concentration="3.0"),
              raw_line(DatetimeEnd="2020-01-01 04:00:00 +01:00", Concentration="4"))
    write_raw(raw / "b.csv", raw_line(Concentration="10"), raw_line(DatetimeEnd="2020-01-01 04:00:00 +01:00", Concentration=""))
    write_raw(raw / "empty.csv")
    os.utime(raw / "a.csv", (1_600_000_000, 1_600_000_000))
    os.utime(raw / "b.csv", (1_700_000_000, 1_700_000_000))
    out = ingest.ingest(raw_csv.read_raw(spark, str(raw)))
    assert values(out, "NO", "ts") == [t("2020-01-01 00:00:00"), t("2020-01-01 01:00:00"), t("2020-01-01 02:00:00"), t("2020-01-01 03:00:00")]
    assert values(out, "NO") == [10, 2, 2, 4]
    assert out.first().rate == "H"

    target, checkpoint = str(tmp_path / "m"), str(tmp_path / "c")
    incremental.ingest_new_raw_files(spark, str(raw), target, checkpoint)
    assert values(tables.read_measurements(spark, target)) == [10, 2, 2, 4]
    write_raw(raw / "late.csv", raw_line(DatetimeEnd="2020-01-01 02:00:00 +01:00", Concentration="7"))
    incremental.ingest_new_raw_files(spark, str(raw), target, checkpoint)
    assert values(tables.read_measurements(spark, target)) == [10, 7, 2, 4]


def test_merge_is_idempotent(spark, panel, tmp_path):
    path = str(tmp_path / "m")
    first = panel({"a": [("2020-01-01 00:00:00", 1), ("2020-01-01 01:00:00", 2)]})
    other = panel({"a": [("2020-01-01 00:00:00", 5)]}, station="S2")
    second = panel({"a": [("2020-01-01 01:00:00", None), ("2020-01-01 02:00:00", 3)], "b": [("2020-01-01 00:00:00", 9)]})
    for part in (first, other, second, second):
        tables.merge_measurements(part, path)
    stored = tables.read_measurements(spark, path, "S1", "H")
    assert values(stored, "a") == [1, 2, 3] and values(stored, "b") == [9]
    assert values(tables.read_measurements(spark, path, "S2")) == [5]
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(station" in plan


def test_density(spark, panel):
    hours = [f"2020-01-{1 + i // 24:02d} {i % 24:02d}:00:00" for i in range(246)]  # to 01-11 05:00, ten whole days
    df = panel({"full": [(h, 1) for h in hours], "edge": [(h, 1) for h in hours[:228]], "thin": [(h, 1) for h in hours[:227]]})
    cover = {r.pollutant: (r.n_values, r.days) for r in ingest.coverage(df).collect()}
    assert cover == {"full": (246, 10), "edge": (228, 10), "thin": (227, 10)}
    kept = ingest.density_filter(df).select("pollutant").distinct().collect()
    assert {r.pollutant for r in kept} == {"full", "edge"}
    assert ingest.density_filter(df.withColumn("rate", F.lit("week"))).count() == 0
    as_days = df.withColumn("rate", F.lit("D")).filter(F.hour("ts") == 0)
    assert ingest.density_filter(as_days.filter("pollutant = 'full'")).count() == 11


def test_pivot_and_back(panel):
    df = panel({"a": [("2020-01-01 00:00:00", 1), ("2020-01-01 00:00:00", 3)], "b": [("2020-01-01 00:00:00", 5)]})
    wide = ingest.pivot_wide(df)
    assert wide.columns[-2:] == ["a", "b"] and wide.first().a == 2
    assert sorted((r.pollutant, r.value) for r in ingest.unpivot_long(wide).collect()) == [("a", 2), ("b", 5)]


def test_station_info_takes_first(spark, panel):
    df = panel({"a": [("2020-01-01 00:00:00", 1)]})
    places = spark.createDataFrame([("S1", 50.0, 8.0), ("S1", 49.0, 9.0)], "station string, latitude double, longitude double")
    row = ingest.with_station_info(df, places).first()
    assert (row.latitude, row.longitude) == (49.0, 9.0)


def test_names(spark):
    df = spark.createDataFrame([
        ("results/S1-H-NO2-distance=3-differenced=True-direct=True-artificial=False.csv",),
        ("results/S1-D-PM2.5-distance=7-differenced=False-direct=False.csv",)], "path string")
    rows = [r.r.asDict() for r in df.select(names.parse_run_name(F.col("path")).alias("r")).collect()]
    assert rows[0] == dict(station="S1", rate="H", pollutant="NO2", distance=3, differenced=True, direct=True, artificial=False)
    assert rows[1] == dict(station="S1", rate="D", pollutant="PM2.5", distance=7, differenced=False, direct=False, artificial=False)
    parsed = df.select(names.parse_run_name(F.col("path")).alias("r"), "path").select("r.*", "path")
    built = parsed.select(names.run_name(*[F.col(c) for c in parsed.columns[:7]]).alias("n"), "path").collect()
    assert all(r.path == "results/" + r.n for r in built)
    files = spark.createDataFrame([("x/station-ignored-day.csv",), ("x/station-ignored-hour.csv",)], "path string")
    assert [tuple(r.s) for r in files.select(names.parse_series_name(F.col("path")).alias("s")).collect()] == [
        ("station", "D"), ("station", "H")]
    one = spark.range(1).select(names.report_name(F.lit(True), F.lit(False), None, F.lit("H")).alias("n"))
    assert one.first().n == "timebased=True-differenced=False-rate=H"


def test_result_files(spark, tmp_path):
    (tmp_path / "S1-H-NO-distance=1-differenced=False-direct=True-artificial=True.csv").write_text(
        ",index,n_neighbors,weights,score,model,normalize\n0,0,4.0,uniform,-1.5,knn,\n1,0,,,-2.5,linear_regression,True\n")
    (tmp_path / "S1-H-NO-distance=24-differenced=False-direct=False.csv").write_text(
        ',index,order,score,model\n0,0,"(1, 0, 2)",3.5,arima\n')
    rows = {r.model: r for r in tables.read_result_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"knn", "linear_regression", "arima", "prophet"}
    assert rows["knn"].params == {"n_neighbors": "4.0", "weights": "uniform"} and rows["knn"].score == -1.5
    assert rows["linear_regression"].params == {"normalize": "True"} and rows["arima"].params == {"order": "(1, 0, 2)"}
    assert rows["prophet"].params == {} and rows["prophet"].distance == 24 and not rows["prophet"].direct


def test_station_files(spark, tmp_path):
    (tmp_path / "S1-hour.csv").write_text("Timestamp,AirQualityStationEoICode,AveragingTime,NO,SO2\n"
                                          "2020-01-01 00:00:00,S1,hour,1.5,\n2020-01-01 01:00:00,S1,hour,2.5,7\n")
    (tmp_path / "S2-day.csv").write_text("Timestamp,AirQualityStationEoICode,AveragingTime,PM10\n2020-01-01 00:00:00,S2,day,3\n")
    out = tables.read_station_files(spark, str(tmp_path))
    assert sorted((r.station, r.rate, r.pollutant, r.value) for r in out.collect()) == [
        ("S1", "H", "NO", 1.5), ("S1", "H", "NO", 2.5), ("S1", "H", "SO2", 7.0), ("S2", "D", "PM10", 3.0)]


def test_work_list(spark, hourly):
    todo = worklist.work_list(hourly)
    assert todo.count() == 3 * 2 * (1 + 7 * 2)
    done = todo.filter("pollutant = 'NO'")
    assert worklist.work_list(hourly, done).count() == 2 * 30
    few = hourly.filter("pollutant <> 'NO'")
    assert worklist.work_list(few).filter("direct and not artificial").count() == 0
    assert worklist.with_results(hourly, done).count() == 9
    assert worklist.with_results(hourly, done.filter("station = 'none'")).count() == 0


def test_first_merge_is_a_merge(spark, panel, tmp_path):
    path = str(tmp_path / "store")
    part = panel({"NO": [("2020-01-01 00:00:00", 1), ("2020-01-01 00:00:00", 1), ("2020-01-01 01:00:00", None)]})
    tables.merge_measurements(part, path)
    assert [(r.pollutant, r.value) for r in tables.read_measurements(spark, path).collect()] == [("NO", 1.0)]


def test_density_pass_removes_lost_stations(spark, panel, tmp_path):
    store, target = str(tmp_path / "store"), str(tmp_path / "dense")
    hours = [(f"2020-01-0{d} {h:02}:00:00", 1) for d in (1, 2) for h in range(24)] + [("2020-01-03 00:00:00", 1)]
    tables.merge_measurements(panel({"NO": hours}, station="S1").unionByName(panel({"NO": hours[::3]}, station="S2")), store)
    tables.write_dense(spark, store, target, 0.1)
    assert {r.station for r in tables.read_measurements(spark, target).select("station").collect()} == {"S1", "S2"}
    tables.write_dense(spark, store, target, 0.9)
    assert {r.station for r in tables.read_measurements(spark, target).select("station").collect()} == {"S1"}


def test_a_value_like_a_header_word_is_data(spark, tmp_path):
    name = "S1-hour-NO-distance=1-differenced=False-direct=True-artificial=True.csv"
    (tmp_path / name).write_text("model,n_neighbors,score\nknn,3,0.5\nknn,score,0.6\nknn,5,0.7\n")
    assert tables.read_result_files(spark, str(tmp_path)).count() == 3


def test_evaluation_files_by_header(spark, tmp_path):
    (tmp_path / "S1-hour.csv").write_text("pollutant,distance,model,mean_squared_error\nNO,1,knn,0.5\n")
    (tmp_path / "S2-day.csv").write_text("model,fit_time,pollutant\nets,1.5,PM10\n")
    rows = {r.station: r for r in tables.read_evaluation_files(spark, str(tmp_path)).collect()}
    assert (rows["S1"].rate, rows["S1"].mean_squared_error, rows["S1"].fit_time) == ("H", 0.5, None)
    assert (rows["S2"].rate, rows["S2"].model, rows["S2"].fit_time, rows["S2"].distance) == ("D", "ets", 1.5, None)


def test_merge_of_more_stations_than_are_named(spark, panel, tmp_path, monkeypatch):
    def merged(path, limit):
        monkeypatch.setattr(tables, "NAMED_STATIONS", limit)
        for when, value in (("2020-01-01 00:00:00", 1), ("2020-01-01 00:00:00", 2), ("2020-01-01 01:00:00", 3)):
            parts = [panel({"a": [(when, value * k)]}, station=f"S{k}") for k in range(4) if k != value]
            new = parts[0]
            for part in parts[1:]:
                new = new.unionByName(part)
            tables.merge_measurements(new, path)
        return sorted(tuple(r) for r in tables.read_measurements(spark, path).collect())

    named, joined = merged(str(tmp_path / "named"), 10), merged(str(tmp_path / "joined"), 2)
    assert named == joined and len(named) == 7
