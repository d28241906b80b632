"""Files, catalogue, streams and inference."""

import datetime
import json
import os
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terrametric import schema
from terrametric.functions import geo
from terrametric.ml import inference
from terrametric.sources import catalog, files
from terrametric.streaming import feed


@pytest.mark.parametrize("name", sorted(schema.TABLES))
def test_schemas_parse(spark, name):
    assert spark.createDataFrame([], schema.schema(name)).count() == 0


def test_route_csv(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('﻿displayName,origin,destination\nA b!,"(40.1, -73)","(40.2, -73.1)"\nbad,"x","(1, 2)"\n,"(1, 2)","(3, 4)"\nfar,"(95, 0)","(1, 2)"\n', encoding="utf-8")
    good, bad = files.read_route_csv(spark, str(p), files.RouteColumns(origin="origin", destination="destination"))
    assert [r["origin"]["lat"] for r in good.collect()] == [40.1, 1.0]
    assert sorted(r["displayName"] for r in bad.collect()) == ["bad", "far"]
    sent = files.registration_requests(good, "town").collect()
    assert sent[0]["selected_route_id"] == "a-b" and sent[1]["selected_route_id"].startswith("town-")
    assert json.loads(sent[0]["body"])["dynamicRoute"]["origin"] == {"latitude": 40.1, "longitude": -73.0}
    q = tmp_path / "s.csv"
    q.write_text("id,ax,ay,bx,by\n1,-73,40,-72,41\n2,-73,,1,1\n")
    good, bad = files.read_route_csv(spark, str(q), files.RouteColumns("id", origin_lng="ax", origin_lat="ay", destination_lng="bx", destination_lat="by"))
    assert (good.count(), bad.count()) == (1, 1)


def test_geojson_plain_and_zipped(spark, tmp_path):
    features = [{"type": "Feature", "properties": {"name": "R", "tag": "t", "n": 3}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [0, 1], [1, 1]]}}, {"type": "Feature", "properties": {}, "geometry": None}]
    text = json.dumps({"type": "FeatureCollection", "features": features})
    (tmp_path / "a.json").write_text(text)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("b.geojson", text)
    for name in ("a.json", "b.zip"):
        df = files.read_geojson(spark, str(tmp_path / name))
        assert df.count() == 2
        (r,) = files.route_records(df).collect()
        assert (r["display_name"], len(r["waypoints"]), r["bounds"]["east"]) == ("R", 1, 1.0)
        assert abs(r["length_km"] - (110.574 + 111.303)) < 0.2 and r["encoded_polyline"]
    n = files.write_zip(files.route_records(df), str(tmp_path / "out.zip"))
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert n == len(json.loads(z.read("routes.json"))) == 1
    with pytest.raises(ValueError):
        files.write_zip(df, str(tmp_path / "c.zip"), limit=1)


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"asset_id": "x", "observations": [{"observation_id": "1", "camera_pose": {"latitude": 1.0, "longitude": 2.0}}, {"observation_id": "2", "camera_pose": {"latitude": 1.0}}, {"observation_id": "3"}]}]))
    assert [r["observation_id"] for r in files.read_asset_json(spark, str(tmp_path / "a.json")).collect()] == ["1"]
    (tmp_path / "t.jsonl").write_text(json.dumps({"contents": [{"role": "user", "parts": [{"fileData": {"mimeType": "image/png", "fileUri": "u"}}, {"text": "q"}]}]}) + "\n")
    assert [(r["part"], r["text"], r["file_uri"]) for r in files.read_tuning_lines(spark, str(tmp_path / "t.jsonl")).orderBy("part").collect()] == [(0, None, "u"), (1, "q", None)]
    images = spark.createDataFrame([("u", ["a", "b"]), ("v", [])], "gcs_uri string, labels array<string>")
    assert [json.loads(r["value"]) for r in files.annotation_lines(images).collect()] == [{"imageGcsUri": "u", "classificationAnnotations": [{"displayName": "a"}, {"displayName": "b"}]}]
    pages = {None: {"items": [{"a": 1}], "nextPageToken": "n"}, "n": {"items": [{"a": 2}]}}
    assert [r["a"] for r in files.read_paged(spark, pages.get, "a int").collect()] == [1, 2]


def test_catalogue(spark, tmp_path):
    rows = [(f"r{i % 3}", datetime.datetime(2025, 1, 1 + i % 4, 5), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "selected_route_id string, record_time timestamp_ntz, v double").withColumn("record_date", F.to_date("record_time"))
    path = str(tmp_path / "h")
    df.write.partitionBy("record_date").parquet(path)
    stored = spark.read.parquet(path)
    pruned = catalog.scan_between(stored, "2025-01-02 00:00:00", "2025-01-03 00:00:00")
    assert pruned.count() == 5 and "PartitionFilters: [isnotnull(record_date" in pruned._jdf.queryExecution().executedPlan().toString()
    assert catalog.latest_partition(spark, path) == "2025-01-04" and catalog.scan_latest(spark, path).count() == 5
    inventory = catalog.partition_inventory(spark, path, "h", "record_date").orderBy("partition_id").collect()
    assert [(r["partition_id"], r["total_rows"]) for r in inventory] == [(f"2025010{d}", 5) for d in (1, 2, 3, 4)]
    assert catalog.drop_old_partitions(spark, path, "2025-01-03") == ["record_date=2025-01-01", "record_date=2025-01-02"]
    snaps = str(tmp_path / "s")
    now = df.select("selected_route_id", "v")
    catalog.append_snapshot(now, snaps, datetime.datetime(2025, 1, 1))
    assert catalog.append_snapshot(now, snaps, datetime.datetime(2025, 1, 2)).groupBy("snapshot_date").count().count() == 2
    kept, more = catalog.capped(df, 7)
    assert len(kept) == 7 and more
    with pytest.raises(ValueError):
        catalog.places_of(df, "us; drop")


def test_views_and_materialized_tables(spark):
    spark.range(3).createOrReplaceTempView("ids_v")
    spark.sql("CREATE TABLE IF NOT EXISTS road_ids USING parquet AS SELECT id FROM ids_v")
    catalog.create_view(spark, "described", "SELECT id FROM road_ids", {"id": "it's an id"}, "a view")
    assert spark.table("described").count() == 3
    assert [r["comment"] for r in spark.sql("DESCRIBE described").collect()] == ["it's an id"]
    kept = catalog.Materialized(spark, "kept_ids", lambda: spark.table("road_ids"), "id", {"id": "the id"}, "kept")
    assert kept.refresh().count() == 3 and kept.refresh().count() == 3
    assert {"road_ids", "kept_ids"} <= {r["table_name"] for r in catalog.registered(spark).collect()}
    assert catalog.read_only_sql(spark, "SELECT count(*) n FROM road_ids").first()["n"] == 3
    for bad in ("DROP TABLE road_ids", "INSERT INTO road_ids VALUES (1)", "CREATE TABLE x AS SELECT 1", "SET a = b", "FROM road_ids INSERT INTO kept_ids SELECT id"):
        with pytest.raises(Exception):
            catalog.read_only_sql(spark, bad)
    for t in ("VIEW described", "TABLE road_ids", "TABLE kept_ids"):
        spark.sql(f"DROP {t}")


def message(route, time, d=30.0, s=10.0):
    return json.dumps({"selected_route_id": route, "record_time": f"2025-01-01T{time}Z", "duration_in_seconds": d, "static_duration_in_seconds": s})


@pytest.fixture
def feed_dir(tmp_path):
    lines = [[message("smrt-1", "00:00:00"), message("smrt-1", "00:00:00"), "not json", message("x-1", "00:01:00", 10.0)], [message("smrt-1", "00:20:00", 5.0), message("smrt-2", "00:05:00")], [message("smrt-2", "02:00:00")]]
    d = tmp_path / "in"
    d.mkdir()
    for i, ls in enumerate(lines):
        (d / f"{i}.json").write_text("\n".join(ls) + "\n")
        os.utime(d / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in this order
    return d


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_to_table_drops_repeats(spark, feed_dir, tmp_path):
    m = feed.read_messages(spark, str(feed_dir), 1)
    feed.to_table(feed.records(m, "smrt-"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("selected_route_id").count().orderBy("selected_route_id").collect() == [("smrt-1", 2), ("smrt-2", 2)]
    assert [r["value"] for r in run(feed.bad_messages(feed.read_messages(spark, str(feed_dir))), "bad").collect()] == ["not json"]
    feed.upsert_latest(feed.records(feed.read_messages(spark, str(feed_dir), 1)), str(tmp_path / "l"), str(tmp_path / "lc")).awaitTermination(120)
    last = max((tmp_path / "l").iterdir(), key=lambda p: int(p.name[2:]))
    assert {(r["selected_route_id"], r["record_time"].hour * 60 + r["record_time"].minute) for r in spark.read.parquet(str(last)).collect()} == {("smrt-1", 20), ("smrt-2", 120), ("x-1", 1)}


def test_stream_windows_alerts_silence(spark, feed_dir):
    rows = lambda: feed.read_messages(spark, str(feed_dir), 1).where("ok")
    w = run(feed.windowed(rows()), "win").where("selected_route_id = 'smrt-1'").collect()
    assert [(r["samples"], round(r["avg_delay_ratio"], 3)) for r in w] == [(3, 2.167)]
    assert run(feed.windowed(rows(), "30 minutes", "15 minutes"), "slide").where("selected_route_id = 'smrt-2'").count() >= 2
    assert run(feed.sessions(rows(), "15 minutes"), "sess").where("selected_route_id = 'smrt-1'").count() == 2
    assert {r["selected_route_id"] for r in run(feed.alerts(rows()), "alert").collect()} == {"smrt-1", "smrt-2"}
    silent = run(feed.silences(rows(), 10), "silent").select("selected_route_id").distinct().collect()
    assert {"smrt-1", "x-1"} <= {r[0] for r in silent}


def test_inference(spark):
    def factory():
        seen = set()

        def client(prompt, uris):
            if "flaky" in uris and "flaky" not in seen:
                seen.add("flaky")
                raise TimeoutError("again")
            if "broken" in uris:
                raise ValueError("no image")
            return {"good": '```json\n{"width": 4, "height": 3}\n```', "flaky": 'is {"width": 1, "height": 1}', "prose": "I cannot say"}[uris[0]]

        return client

    df = spark.createDataFrame([(u, [u]) for u in ("good", "flaky", "broken", "prose")], "asset_id string, uris array<string>")
    out = {r["asset_id"]: r for r in inference.projected(inference.replies(df, "size?", factory, "uris", 2), "width long, height long").collect()}
    assert (out["good"]["width"], out["good"]["error"], out["good"]["raw"]) == (4, None, None)
    assert out["flaky"]["height"] == 1
    assert out["broken"]["error"] == "ValueError: no image" and out["broken"]["width"] is None
    assert out["prose"]["error"].startswith("no JSON") and out["prose"]["raw"] == "I cannot say"
    judged = spark.createDataFrame([("SAME",), (" same ",), ("DIFFERENT",), ("?",)], "verdict string")
    assert tuple(inference.agreement(judged).first()) == (3, 2, 66.67)
    got = {r["category"]: (r["n"], r["samples"]) for r in inference.categories(spark.createDataFrame([("Yes. A",), ("yes b",), ("No",), ("?",)], "reply string")).collect()}
    assert got["Yes"] == (2, ["Yes. A", "yes b"]) and got["Error"][0] == 1


def test_cascade(spark):
    first = lambda: {"a": "A"}.get
    second = lambda: lambda v: v.upper() + "?" if v != "none" else None
    df = spark.createDataFrame([("a",), ("b",), ("none",), (None,)], "address string")
    got = {r["address"]: (r["resolved"], r["resolved_by"]) for r in inference.cascade(df, "address", [first, second]).collect()}
    assert got == {"a": ("A", 0), "b": ("B?", 1), "none": (None, None), None: (None, None)}


def test_job_log(spark, tmp_path):
    events = [
        {"Event": "SparkListenerApplicationStart", "User": "ann", "App ID": "app-1"},
        {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 3, "description": "SELECT 1", "physicalPlanDescription": "Scan", "time": 1_700_000_000_000},
        {"Event": "SparkListenerJobStart", "Stage IDs": [7, 8], "Properties": {"spark.sql.execution.id": "3"}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 7, "Task Metrics": {"Input Metrics": {"Bytes Read": 10}}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 8, "Task Metrics": {"Input Metrics": {"Bytes Read": 5}}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 9, "Task Metrics": {"Input Metrics": {"Bytes Read": 99}}},
    ]
    (tmp_path / "log").write_text("\n".join(map(json.dumps, events)) + "\n")
    (r,) = catalog.job_log(spark, str(tmp_path / "log")).collect()
    assert (r["job_id"], r["user_email"], r["query"], r["statement_type"], r["total_bytes_processed"]) == ("app-1_3", "ann", "SELECT 1", "SELECT", 15)
    assert r["creation_time"] == datetime.datetime(2023, 11, 14, 22, 13, 20)


def test_inventory_adds_up_to_the_files(spark, tmp_path):
    """Days that share files share their bytes by rows; folders are whole partitions."""
    rows = [(d, i, "x" * (50 * d)) for d in range(1, 4) for i in range(100 * d)]
    df = spark.createDataFrame(rows, "day int, n int, t string").withColumn("at", F.expr("date_add(date'2025-01-01', day)"))
    df.coalesce(2).write.parquet(f"{tmp_path}/flat")
    df.write.partitionBy("day").parquet(f"{tmp_path}/folders")
    size = lambda p: sum(f.stat().st_size for f in Path(p).rglob("*.parquet"))
    for path, column in ((f"{tmp_path}/flat", "at"), (f"{tmp_path}/flat", None), (f"{tmp_path}/folders", "at")):
        found = catalog.partition_inventory(spark, path, "t", column).collect()
        assert abs(sum(r["total_logical_bytes"] for r in found) - size(path)) <= len(found)
        assert sorted(r["total_rows"] for r in found) == ([100, 200, 300] if column else [600])
    by_day = {r["partition_id"]: r["total_logical_bytes"] for r in catalog.partition_inventory(spark, f"{tmp_path}/folders", "t", "at").collect()}
    assert all(abs(by_day[f"2025010{d + 1}"] - size(f"{tmp_path}/folders/day={d}")) <= 1 for d in (1, 2, 3))


def test_lineage_reads_the_definitions_of_views(spark):
    from terrametric.plans.engineering import bqa3_derived_resources

    spark.sql("CREATE TABLE IF NOT EXISTS historical_travel_time (a INT) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS road_copy (a INT) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS other (a INT) USING parquet")
    catalog.create_view(spark, "delays", "SELECT a FROM historical_travel_time WHERE a > 1", {"a": "it's a"}, "no name of a source here")
    catalog.create_view(spark, "unrelated", "SELECT a FROM other", {"a": "a"}, "mentions historical_travel_time")
    try:
        got = {(r["resource_name"], r["type"], r["lineage_detail"]) for r in bqa3_derived_resources(spark, "").collect()}
        assert {("delays", "VIEW", "SELECT a FROM historical_travel_time WHERE a > 1"), ("road_copy", "BASE TABLE", "see the table's own metadata")} == got
    finally:
        for kind, name in (("VIEW", "delays"), ("VIEW", "unrelated"), ("TABLE", "historical_travel_time"), ("TABLE", "road_copy"), ("TABLE", "other")):
            spark.sql(f"DROP {kind} {name}")


def test_datasets_tables_and_copies(spark):
    catalog.create_dataset(spark, "study", "it's a study")
    catalog.create_table(spark, "study.visits", "route STRING, at TIMESTAMP, day DATE", "day", "route", 4)
    spark.sql("INSERT INTO study.visits SELECT 'a', timestamp'2025-01-01 10:00:00', date'2025-01-01'")
    catalog.create_dataset(spark, "kept")
    assert catalog.back_up(spark, ["study.visits"], "kept", "_old") == ["kept.visits_old"]
    assert catalog.back_up(spark, ["study.visits"], "kept", "_old") == ["kept.visits_old"] and spark.table("kept.visits_old").count() == 1
    assert {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED study.visits").collect()}["Num Buckets"] == "4"
    with pytest.raises(Exception, match="(?i)not.empty|cannot"):
        catalog.drop_dataset(spark, "study")
    for name in ("study", "kept"):
        catalog.drop_dataset(spark, name, with_tables=True)
    assert not {"study", "kept"} & {d.name for d in spark.catalog.listDatabases()}


@pytest.mark.parametrize("sql", ["SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'lineSeparator')", "SELECT try_reflect ('java.lang.System', 'lineSeparator')", "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT * FROM json.`x`"])
def test_guard_refuses_files_and_reflection(spark, sql):
    with pytest.raises(PermissionError):
        catalog.read_only_sql(spark, sql)


def test_guard_lets_queries_pass(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert catalog.read_only_sql(spark, "WITH t AS (SELECT id FROM three) SELECT count(*) AS n FROM t JOIN three USING (id)").first()["n"] == 3


def test_csv_with_geometries(spark, tmp_path):
    df = spark.createDataFrame([("s1", 7.5, "POINT(-0.1 51.5)"), ("s, 2", 1.0, "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)))")], "store_id string, score double, location string")
    files.write_csv(df.withColumn("location", geo.from_text("location")), f"{tmp_path}/out")
    Path(f"{tmp_path}/out/bad.csv").write_text("store_id,score,location\ns3,2.0,nowhere\n")
    good, bad = files.read_csv_with_wkt(spark, f"{tmp_path}/out", "store_id string, score double, location string")
    assert sorted((r["store_id"], r["score"], r["location"]["kind"]) for r in good.collect()) == [("s, 2", 1.0, "MultiPolygon"), ("s1", 7.5, "Point")]
    assert [r["store_id"] for r in bad.collect()] == ["s3"]


def test_to_pandas_is_bounded(spark):
    assert catalog.to_pandas(spark.range(5))["id"].tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        catalog.to_pandas(spark.range(5), limit=4)
