"""A directory of growing files: whole segments once each, over restarts; ranges from outer segments alone."""

import time

from pyspark.sql import functions as F

from sigloom.sources import segments
from sigloom.streaming import recordings, watcher


def put(path, rows, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open(mode) as f:
        if mode == "w":
            f.write("timestamp,ch_1,ch_2,ch_3,ch_4\n")
        f.writelines(",".join("" if v is None else str(v) for v in r) + "\n" for r in rows)


def test_whole_segments_once(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")

    def look():
        time.sleep(0.3)
        stream = watcher.watched_segments(spark, f"file://{root}", "raw", f"file://{tmp_path}/log", interval=0.2)  # a new stream each time: a restart
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.session_id, r.segment, r.timestamp) for r in spark.read.schema(stream.schema).parquet(out).collect())

    a = root / "20240102_030405"
    put(a / "EEG_seg0001.csv", [(1, 1, 2, None, 4), (2, 1, 2, 3, 4)])
    put(a / "IMU_seg0001.csv", [(9, 1, 2, 3, 4)])
    (tmp_path / "out").mkdir()
    assert look() == []  # seen once
    put(a / "EEG_seg0001.csv", [(3, 1, 2, 3, 4)], "a")
    assert look() == []  # it has grown
    put(a / "EEG_seg0002.csv", [(4, 1, 2, 3, 4)])
    one = [("20240102_030405", 1, t) for t in (1.0, 2.0, 3.0)]
    assert look() == one  # the next one exists
    two = sorted([*one, ("20240102_030405", 2, 4.0)])
    assert look() == two  # its size stood still
    put(a / "EEG_seg0002.csv", [(5, 1, 2, 3, 4)], "a")
    (root / "b").mkdir()
    (root / "b" / "EEG_seg0001.csv").touch()
    assert look() == two and look() == two  # given out once; an empty file is not whole
    got = spark.read.parquet(out).filter("timestamp = 1").first()
    assert got.ch_3 is None and got.path.endswith("EEG_seg0001.csv")


def test_recordings_layout_and_probed_ranges(spark, tmp_path):
    root = f"file://{tmp_path}/rec"
    rows = spark.createDataFrame([(s, i, 5.0 + i / 4, float(i), None, 1.0, 2.0) for s in ("20240102_030405", "x") for i in range(25)], "session_id string, seq bigint, time double, ch_1 double, ch_2 double, ch_3 double, ch_4 double")
    segments.write_recordings(rows, root, "raw", ["ch_1", "ch_2", "ch_3", "ch_4"], 10)
    back = segments.scan_recordings(spark, root, "raw")
    assert sorted((r.session_id, r.segment, r.timestamp, r.ch_1, r.ch_2) for r in back.collect()) == sorted((r.session_id, r.seq // 10 + 1, r.time, r.ch_1, None) for r in rows.collect())
    probed = segments.probed_range(spark, root, "raw")
    assert {tuple(r) for r in probed.collect()} == {("20240102_030405", 3, 5.0, 11.0), ("x", 3, 5.0, 11.0)}
    assert len(probed.inputFiles()) == 4  # of six files the outer ones
    first = segments.probed_range(spark, root, "raw", anchor=True).filter("session_id <> 'x'").first()
    assert (first.start_ts, first.end_ts) == (1704164645.0, 1704164651.0)
    assert segments.probed_range(spark, root, "imu").count() == 0
    stream = recordings.segment_stream(spark, root, "raw")
    assert recordings.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c")).agg(F.count("timestamp")).first()[0] == 50


def test_marker_tables_append_and_keep_extras(spark, tmp_path):
    from sigloom.sources import marker_files

    schema = "session_id string, id bigint, content string, start_str string, end_str string, duration_s double, start_ts double, end_ts double, extras map<string,string>"
    row = lambda i, text, **extras: ("s", i, text, None, None, 1.5, 10.0, None, extras)
    root, path = f"file://{tmp_path}", tmp_path / "s" / "markers.csv"
    marker_files.write_marker_tables(spark.createDataFrame([row(0, 'a, "b"\nc', note="n"), row(1, "é")], schema), root)
    assert path.read_bytes().startswith(b"\xef\xbb\xbfid,content") and path.read_text("utf-8-sig").splitlines()[0].endswith("end_ts,note")
    more = spark.createDataFrame([row(1, "again"), row(2, "new", colour="red", note="m")], schema)
    for _ in range(2):  # a second run changes nothing
        marker_files.write_marker_tables(more, root, append=True)
    assert path.read_text("utf-8-sig").splitlines()[0].endswith("end_ts,note,colour") and path.read_bytes().count(b"\xef\xbb\xbf") == 1
    got = {r.id: (r.content, r.duration_s, r.end_ts, r.extras) for r in marker_files.scan_marker_tables(spark, root).collect()}
    assert got == {0: ('a, "b"\nc', 1.5, None, {"note": "n"}), 1: ("again", 1.5, None, {}), 2: ("new", 1.5, None, {"note": "m", "colour": "red"})}
    assert marker_files.scan_marker_table(spark, root).count() >= 3
    marker_files.write_marker_tables(spark.createDataFrame([row(7, "alone")], schema), root)
    assert [r.id for r in marker_files.scan_marker_tables(spark, root).collect()] == [7]
