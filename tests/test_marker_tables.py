"""Marker tables on disk are found by one listing and opened by tasks, whatever the sessions are called."""

from sigloom.sources import marker_files

SCHEMA = "session_id string, id bigint, content string, start_str string, end_str string, duration_s double, start_ts double, end_ts double, extras map<string,string>"


def test_every_folder_is_read_and_none_is_listed_by_itself(spark, tmp_path):
    names = ["_a", "b c", "s[1]", "d%20e", *(f"u{i:03d}" for i in range(600))]
    rows = [(s, i, f"{s} {i}", None, None, 1.5, 10.0, None, {"note": s} if i else {}) for s in names for i in range(2)]
    root = f"file://{tmp_path}/markers"
    assert marker_files.scan_marker_tables(spark, root).count() == 0
    marker_files.write_marker_tables(spark.createDataFrame(rows, SCHEMA), root)
    (tmp_path / "markers" / "empty").mkdir()
    back = marker_files.scan_marker_tables(spark, root)
    assert sorted((r.session_id, r.id, r.content, r.extras) for r in back.collect()) == sorted((r[0], r[1], r[2], r[8]) for r in rows)
    assert not back.inputFiles() and back.rdd.getNumPartitions() > 1
