"""SQL table functions against the DataFrame form and plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import table_functions
from sigloom.operators import artifacts, clean, optical


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    table_functions.register(spark)
    made = [(s, w, w * 80 + i, (w * 80 + i) / 256, None if w == 2 and i == 7 else float(v)) for s in (1, 2) for w in range(3) for i, v in enumerate(rng.standard_normal(80 if w < 2 or s == 2 else 20).cumsum())]
    df = spark.createDataFrame(made, "session_id bigint, win bigint, seq bigint, time double, value double").withColumn("other", F.lit("x")).repartition(5)
    df.createOrReplaceTempView("windows")
    return df


def shape(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_zero_phase(spark, rows):
    got = spark.sql("SELECT * FROM zero_phase(TABLE(SELECT * FROM windows) PARTITION BY (session_id, win) ORDER BY (seq), 256.0)")
    want = clean.filter_windows(rows.select("session_id", "win", "seq", F.col("value").alias("CH1")), 256.0, ["CH1"], ("session_id", "win"))
    assert shape(got) == shape(want.select("session_id", "win", "seq", "CH1")) and got.filter("value is not null").count() == 320


def test_peaks(spark, rows):
    got = spark.sql("SELECT * FROM window_peaks(TABLE(windows) PARTITION BY (session_id, win) ORDER BY (seq), 5, 0.5)")
    want = []
    for s in (1, 2):
        for w in range(2):
            own = [r for r in rows.orderBy("seq").collect() if (r.session_id, r.win) == (s, w)]
            want += [(s, w, own[i].seq, round(own[i].value, 9)) for i in optical.peaks(np.array([r.value for r in own]), 5, 0.5)]
    assert want and shape(got) == sorted(want, key=repr)


def test_spline(spark, rows):
    rows.withColumn("value", F.when(F.col("seq") % 4 == 0, F.col("value"))).createOrReplaceTempView("sparse")
    got = {(r.session_id, r.win, r.time): r.value for r in spark.sql("SELECT * FROM spline_filled(TABLE(sparse) PARTITION BY (session_id, win) ORDER BY (time))").collect()}
    own = sorted((r.time, r.value if r.seq % 4 == 0 else None) for r in rows.collect() if (r.session_id, r.win) == (1, 0))
    known = np.array([r for r in own if r[1] is not None])
    want = artifacts.spline(known[:, 0], known[:, 1:], np.array([t for t, _ in own]))[:, 0]
    assert np.allclose([got[1, 0, t] for t, _ in own], want) and len(got) == rows.count()
