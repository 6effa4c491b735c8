"""The signal model over the driver's tables: one view per source, in Spark and as SQL of the same meaning.

``events`` is a stream of values in ``event_id`` order.  Four neighbours make a four-channel sample, six an IMU
sample, three an optical sample; sessions are stretches of 1,024 samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pivot(spark: SparkSession, sf_dir: str, parts: list[str], fs: float, session: int = SESSION, value=None) -> DataFrame:
    n = len(parts)
    value = F.col("value") if value is None else value
    events = table(spark, sf_dir, "events").select("event_id", value.alias("v"), F.floor(F.col("event_id") / n).cast("bigint").alias("i"), (F.col("event_id") % n).alias("c"))
    made = events.groupBy("i").agg(*(F.max(F.when(F.col("c") == k, F.col("v"))).alias(p) for k, p in enumerate(parts)), F.count(F.lit(1)).alias("_n"))
    return made.filter(F.col("_n") == n).select(F.floor(F.col("i") / session).cast("bigint").alias("session_id"), (F.col("i") % session).alias("seq"), ((F.col("i") % session) / fs).alias("time"), *parts)


def sig_wide(spark: SparkSession, sf_dir: str, fs: float = 32.0) -> DataFrame:
    return _pivot(spark, sf_dir, ["CH1", "CH2", "CH3", "CH4"], fs)


def sig_gaps(spark: SparkSession, sf_dir: str, fs: float = 256.0) -> DataFrame:
    return _pivot(spark, sf_dir, ["CH1", "CH2", "CH3", "CH4"], fs, value=F.when(F.col("event_id") % 37 != 0, F.col("value")))


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 52 samples, scaled by 0.2, 0.8 or 3.0 in turn so that all motion levels occur."""
    raw = _pivot(spark, sf_dir, ["a", "b", "c", "d", "e", "f"], 52.0)
    k = F.element_at(F.array(F.lit(0.2), F.lit(0.8), F.lit(3.0)), (F.floor(F.col("seq") / 52) % 3 + 1).cast("int"))
    return raw.select("session_id", "seq", "time", *((0.577 + k * (F.col(c) - 50) / 1500).alias(n) for c, n in zip("abc", ["AccX", "AccY", "AccZ"])), *((k * F.col(c) / 12).alias(n) for c, n in zip("def", ["GyrX", "GyrY", "GyrZ"])))


def ppg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pivot(spark, sf_dir, ["ambient", "ir", "red"], 64.0)


def sig_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per user, irregular real times."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("session_id"), (F.row_number().over(w) - 1).cast("bigint").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), "event_type", "value", "props", "event_id")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of a user's session: relative start from the event's JSON, length from its value."""
    u = sig_user(spark, sf_dir)
    start = u.groupBy("session_id").agg(F.min("time").alias("session_start"))
    k = F.get_json_object("props", "$.k").cast("double")
    return u.join(start, "session_id").select("session_id", F.col("seq").alias("id"), F.col("event_type").alias("content"), (F.col("session_start") + k).alias("start_ts"), (F.col("session_start") + k + F.col("value")).alias("end_ts"), "session_start")


def k_of(column: str = "props"):
    """The number that an event's JSON holds."""
    return F.get_json_object(column, "$.k").cast("bigint")


def blinks(spark: SparkSession, sf_dir: str, fs: float = 64.0) -> DataFrame:
    """Calm samples with gaps and rare spikes, in windows of 64 rows."""
    value = F.when(F.col("event_id") % 397 == 0, 4000.0).when(F.col("event_id") % 37 != 0, F.col("value") * 0.4)
    return _pivot(spark, sf_dir, ["CH1", "CH2", "CH3", "CH4"], fs, value=value).withColumn("win", F.floor(F.col("seq") / 16).cast("bigint"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control messages of a user's session, one of eleven malformed."""
    k = F.col("k")
    u = sig_user(spark, sf_dir).withColumn("k", k_of())
    part = lambda n, text: F.when(k % n == 0, text).otherwise("")
    text = F.concat(F.lit('{"rc":0,"ps":'), F.when(k % 11 == 0, "").otherwise((k % 3).cast("string")), part(5, F.concat(F.lit(',"bp":'), k, F.lit(".5"))), part(10, F.concat(F.lit(',"tp":'), k)), part(7, F.lit(',"zz":"q"')), F.lit("}"))
    return u.select("session_id", "seq", "k", text.alias("message"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages in two chunks each, with a length character before and NULs behind, as they come from the device."""
    m = messages(spark, sf_dir)
    at = (1 + F.col("k") % (F.length("message") - 1)).cast("int")
    half = lambda i, text: F.struct((F.col("seq") * 2 + i).alias("seq"), F.concat(F.lit("L"), text, F.lit("\x00\x00")).alias("chunk"))
    return m.select("session_id", F.explode(F.array(half(0, F.substr(F.col("message"), F.lit(1), at)), half(1, F.substr(F.col("message"), at + 1)))).alias("c")).select("session_id", "c.*")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker requests of a user's session in all accepted forms, and two that are not: session_id, start_ts, pos, marker."""
    u = sig_user(spark, sf_dir).withColumn("k", k_of())
    start = u.groupBy("session_id").agg(F.min("time").alias("start_ts"))
    k, kind, form = F.col("k"), F.col("event_type"), F.col("k") % 6
    far = F.format_string("%d", F.lit(1_704_103_200) + k)
    text = (
        F.when(form == 0, F.format_string('{"time_range":[%d,%d],"content":"%s"}', k, k + 7, kind))
        .when(form == 1, F.format_string('{"timeRange":{"start":%d,"end":%d},"label":"%s"}', k, k + 5, kind))
        .when(form == 2, F.format_string('{"range":{"from":%s,"to":%s},"text":"%s","note":"n"}', far, far, kind))
        .when(form == 3, F.format_string('{"range":{"begin":"2024-01-05T10:00:00","stop":"2024-01-05 10:00:%02d.25"},"content":"%s"}', k % 60, kind))
        .when(form == 4, F.lit('"junk"'))
        .otherwise(F.format_string('{"time_range":["bad","worse"],"content":"%s"}', kind))
    )
    return u.join(start, "session_id").select("session_id", "start_ts", F.col("seq").alias("pos"), text.alias("marker"))


def _sql_pivot(name: str, parts: list[str], fs: float, value: str = "value") -> str:
    n = len(parts)
    cols = ", ".join(f"max(v) FILTER (c = {k}) AS {p}" for k, p in enumerate(parts))
    return (
        f"{name} AS (SELECT i // {SESSION} AS session_id, i % {SESSION} AS seq, (i % {SESSION}) / {fs} AS time, {', '.join(parts)} FROM "
        f"(SELECT i, count(*) AS cnt, {cols} FROM (SELECT event_id // {n} AS i, event_id % {n} AS c, {value} AS v FROM events) GROUP BY i) WHERE cnt = {n})"
    )


SQL = {
    "sig": _sql_pivot("sig", ["CH1", "CH2", "CH3", "CH4"], "32.0::DOUBLE"),
    "gaps": _sql_pivot("gaps", ["CH1", "CH2", "CH3", "CH4"], "256.0::DOUBLE", "CASE WHEN event_id % 37 <> 0 THEN value END"),
    "imu": _sql_pivot("imu0", list("abcdef"), "52.0::DOUBLE")
    + ", imu1 AS (SELECT *, CASE (seq // 52) % 3 WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 3.0::DOUBLE END AS k FROM imu0)"
    + ", imu AS (SELECT session_id, seq, time, 0.577::DOUBLE + k * (a - 50) / 1500 AS AccX, 0.577::DOUBLE + k * (b - 50) / 1500 AS AccY, 0.577::DOUBLE + k * (c - 50) / 1500 AS AccZ, k * d / 12 AS GyrX, k * e / 12 AS GyrY, k * f / 12 AS GyrZ FROM imu1)",
    "ppg": _sql_pivot("ppg", ["ambient", "ir", "red"], "64.0::DOUBLE"),
    "usr": "usr AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, epoch_us(ts) / 1e6::DOUBLE AS time, event_type, value, props, event_id FROM events)",
    "blk": _sql_pivot("blk0", ["CH1", "CH2", "CH3", "CH4"], "64.0::DOUBLE", "CASE WHEN event_id % 397 = 0 THEN 4000.0::DOUBLE WHEN event_id % 37 <> 0 THEN value * 0.4::DOUBLE END") + ", blk AS (SELECT *, seq // 16 AS win FROM blk0)",
    "blkl": "blkl AS (SELECT session_id, win, seq, unnest(['CH1','CH2','CH3','CH4']) AS ch, unnest([CH1, CH2, CH3, CH4]) AS v FROM blk), pk0 AS (SELECT session_id, win, ch, max(abs(v)) AS p FROM blkl GROUP BY ALL), pk AS (SELECT session_id, win, max(p) AS peak, median(p) AS typical FROM pk0 GROUP BY ALL)",
    "thr": """pn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY win) AS r FROM pk),
f AS (SELECT session_id, r, win, 200.0::DOUBLE AS threshold, false AS warmed_up, peak <= 200 AS clean, CASE WHEN peak <= 200 AND typical IS NOT NULL THEN [typical] ELSE [] END AS dq FROM pn WHERE r = 1
  UNION ALL SELECT session_id, r, win, t, w, peak <= t, CASE WHEN peak <= t AND typical IS NOT NULL THEN list_slice(list_append(dq, typical), CASE WHEN len(dq) >= 20 THEN 2 ELSE 1 END, 21) ELSE dq END
  FROM (SELECT p.*, dq, (len(dq) >= 20) AS w, CASE WHEN len(dq) >= 20 THEN 5 * list_aggregate(dq, 'median') ELSE 200 END AS t FROM f JOIN pn p ON f.session_id = p.session_id AND p.r = f.r + 1))""",
    "ku": "ku AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM usr)",
    "long": "long AS (UNPIVOT sig ON CH1, CH2, CH3, CH4 INTO NAME ch VALUE value)",
    "glong": "glong AS (SELECT session_id, seq, time, unnest(['CH1','CH2','CH3','CH4']) AS ch, unnest([CH1, CH2, CH3, CH4]) AS value FROM gaps)",
    "mrk": "mrk AS (SELECT u.session_id, seq AS id, event_type AS content, s0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS start_ts, s0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) + value AS end_ts, s0 AS session_start FROM usr u JOIN (SELECT session_id, min(time) AS s0 FROM usr GROUP BY 1) USING (session_id))",
    # spectrum of epochs of 32 samples: every bin from sums of products with cosines and sines
    "ep": "ep0 AS (SELECT session_id, seq // 32 AS epoch, ch, count(*) AS n FROM long GROUP BY ALL HAVING count(*) >= 16), ep AS (SELECT l.session_id, l.seq // 32 AS epoch, l.ch, l.time, l.value, n, row_number() OVER (PARTITION BY l.session_id, l.seq // 32, l.ch ORDER BY l.seq) - 1 AS i FROM long l JOIN ep0 e ON l.session_id = e.session_id AND l.seq // 32 = e.epoch AND l.ch = e.ch)",
    "psd": "ew AS (SELECT *, (value - avg(value) OVER p) * (0.5 - 0.5 * cos(2 * pi() * i / n)) AS y, sum(pow(0.5 - 0.5 * cos(2 * pi() * i / n), 2)) OVER p AS ww FROM ep WINDOW p AS (PARTITION BY session_id, epoch, ch)), "
    "eb AS (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM ew), "
    "psd AS (SELECT session_id, epoch, ch, k, any_value(n) AS n, k * 32.0::DOUBLE / any_value(n) AS f, (pow(sum(y * cos(2 * pi() * k * i / n)), 2) + pow(sum(y * sin(2 * pi() * k * i / n)), 2)) / (32.0::DOUBLE * any_value(ww)) * CASE WHEN k = 0 OR 2 * k = any_value(n) THEN 1 ELSE 2 END AS p FROM eb GROUP BY session_id, epoch, ch, k)",
    "bands": "bb(name, lo, hi) AS (VALUES ('delta', 0.5, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('low', 13.0, 20.0), ('high', 20.0, 30.0), ('gamma', 30.0, 45.0)), "
    "pp AS (SELECT *, lead(p) OVER (PARTITION BY session_id, epoch, ch ORDER BY k) AS p2, lead(f) OVER (PARTITION BY session_id, epoch, ch ORDER BY k) AS f2 FROM psd), "
    "bp0 AS (SELECT session_id, epoch, ch, name, coalesce(sum((p + p2) / 2 * (32.0::DOUBLE / n)) FILTER (f >= lo - 1e-9 AND f2 <= hi + 1e-9), 0) AS v FROM pp, bb GROUP BY ALL), "
    "bp1 AS (SELECT session_id, epoch, ch, max(v) FILTER (name = 'delta') AS delta, max(v) FILTER (name = 'theta') AS theta, max(v) FILTER (name = 'alpha') AS alpha, max(v) FILTER (name = 'low') AS lo, max(v) FILTER (name = 'high') AS hi, max(v) FILTER (name = 'gamma') AS gamma FROM bp0 GROUP BY ALL), "
    "bp AS (SELECT *, lo + greatest(0, least(1, 1 - (hi / (lo + 1e-10) - 1.5) / 1.5)) * hi AS beta FROM bp1)",
    "idx": "cm AS (SELECT session_id, epoch, avg(theta) AS theta, avg(alpha) AS alpha, avg(beta) AS beta FROM bp GROUP BY ALL), ts AS (SELECT session_id, epoch, min(time) AS timestamp FROM ep GROUP BY ALL), "
    "idx AS (SELECT session_id, epoch, timestamp, theta / (alpha + 1e-10) AS tar, beta / (alpha + theta + 1e-10) AS ei, 1 / (1 + exp(-3 * (beta / (alpha + theta + 1e-10) - 1))) AS att, 1 / (1 + exp(-2 * (theta / (alpha + 1e-10) - 1.5))) AS cog FROM cm JOIN ts USING (session_id, epoch))",
    "att": "att0 AS (SELECT session_id, epoch, timestamp, row_number() OVER w AS k, avg(att) OVER f AS attention_score, avg(ei) OVER f AS engagement_index, avg(tar) OVER f AS theta_alpha_ratio, avg(cog) OVER f AS cog_load_score FROM idx WINDOW w AS (PARTITION BY session_id ORDER BY epoch), f AS (PARTITION BY session_id ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), "
    "att AS (SELECT *, CASE WHEN attention_score >= 0.65 THEN 'high' WHEN attention_score >= 0.4 THEN 'medium' ELSE 'low' END AS level, CASE WHEN cog_load_score >= 0.65 THEN 'high' WHEN cog_load_score >= 0.4 THEN 'medium' ELSE 'low' END AS clevel FROM att0 WHERE k >= 5)",
}
NEEDS = {"blkl": ["blk"], "thr": ["blkl"], "ku": ["usr"], "long": ["sig"], "glong": ["gaps"], "mrk": ["usr"], "ep": ["sig", "long"], "psd": ["ep"], "bands": ["psd"], "idx": ["bands"], "att": ["idx"]}


def sql(names: str, body: str) -> str:
    """A query over the views named, with all they need before it."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    return ("WITH RECURSIVE " if "thr" in order else "WITH ") + ", ".join(SQL[n] for n in order) + " " + body if order else body
