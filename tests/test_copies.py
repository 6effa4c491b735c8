"""Queries over tables that hold copies of all users, who begin at the same times: against their SQL, and by how they are dealt out."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

from sigloom.operators import markers, timebase
from sigloom.plans import registry
from sigloom.sources import segments
from sigloom.streaming import recordings

from test_queries import TABLES, compare


@pytest.fixture(scope="module")
def copies(sf, tmp_path_factory):
    """The smallest scale with three copies of ``events``, keys shifted (those of users by a multiple of 42)."""
    folder = tmp_path_factory.mktemp("copies")
    for t in TABLES:
        if t != "events":
            os.symlink(f"{sf}/{t}.parquet", folder / f"{t}.parquet")
    duckdb.sql(f"copy (select event_id + i * 100000 as event_id, ts, user_id + i * 4200 as user_id, event_type, value, props from '{sf}/events.parquet', range(3) t(i)) to '{folder}/events.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["marker_sessions", "markers_appended", "session_times_patched"])
def test_sessions_named_alike_stay_apart(spark, copies, name):
    compare(spark, copies, registry.queries()[name], registry.oracle_sql()[name])


def test_segments_share_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"a {i // 50} ", i % 50, float(i), i / 7) for i in range(2000)], "session_id string, seq bigint, time double, value double")
    folder = segments.write_segments(rows, str(tmp_path / "out"), "raw", ["value"], 20)
    files = list((tmp_path / "out").rglob("*.csv"))
    assert 0 < len(files) <= 4
    got = sorted((r.session_id, r.segment, r.timestamp, r.value) for r in segments.read_segments(spark, folder, ["value"]).collect())
    assert got == sorted((f"a {i // 50} ", i % 50 // 20 + 1, float(i), round(i / 7, 6)) for i in range(2000))


def made_by_joins(df):
    """Run a query; the most rows that a join of its plan put out."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            p = p.plan()
        if "Join" in p.nodeName():
            found.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return max(found)


def test_matching_makes_no_pairs_and_keeps_its_bounds(spark, copies):
    compare(spark, copies, registry.queries()["recordings_matched"], registry.oracle_sql()["recordings_matched"])
    n = 400
    recordings = spark.range(n).selectExpr("format_string('n%05d', id) as session_id", "1.7e9 + id % 7 * 150 as start")
    sessions = spark.range(n).selectExpr("format_string('m%05d', id) as session_id", "1.7e9 + id % 9 * 149.5 as start_ts")
    got = markers.match_recordings(recordings, sessions)
    assert made_by_joins(got) <= n
    want = {i: max((j for j in range(n) if abs(i % 7 * 150 - j % 9 * 149.5) < 300), default=None) for i in range(n)}
    assert {int(r.session_id[1:]): r.marker_session and int(r.marker_session[1:]) for r in got.collect()} == want


def test_neighbours_are_dealt_out(spark, copies):
    compare(spark, copies, registry.queries()["neighbouring_sessions"], registry.oracle_sql()["neighbouring_sessions"])
    starts = spark.range(2000).selectExpr("id as session", "id * 1.7 as start")
    pairs = timebase.near_sessions(starts, starts, 3600.0)
    tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) >= 3 and max(tasks) < 0.6 * sum(tasks) and sum(tasks) == sum(abs(i - j) * 1.7 < 3600 for i in range(2000) for j in range(2000))


def test_replays_are_dealt_and_make_a_micro_batch_to_a_part(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id % 8 as session_id", "id as seq").repartition(4, "session_id")
    seen, folder, checkpoint = [], str(tmp_path / "in"), str(tmp_path / "checkpoint")
    run = lambda stream: stream.writeStream.foreachBatch(lambda df, n: seen.append((n, df.count()))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    recordings.replayed([rows.filter("seq < 1000"), rows.filter("seq >= 1000")], folder, run)
    assert seen == [(0, 1000), (1, 2000)] and len(list((tmp_path / "in").glob("*.parquet"))) > 2
