"""Control channel: reassembly of JSON messages from fragments, battery, state changes, unknown keys; stream catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Message keys that are known.
KNOWN_KEYS = ["fw", "hw", "pv", "bp", "ps", "rc", "ln", "tp", "bn", "ap", "sp", "hb", "bl", "be", "hn", "sn", "ma", "hs", "id"]

#: Stream names (or types) in order of precedence, with their default channel labels and whether values show as integers.
STREAMS = [
    ("EEG", ["TP9", "AF7", "AF8", "TP10", "AUX_L", "AUX_R"], False),
    ("PPG", ["Ambient", "IR", "Red"], False),
    ("IMU", ["AccX", "AccY", "AccZ", "GyrX", "GyrY", "GyrZ"], False),
    ("Accelerometer", ["AccX", "AccY", "AccZ"], False),
    ("Gyroscope", ["GyrX", "GyrY", "GyrZ"], False),
    ("Batt", ["Percent%", "Voltage_V", "Temp_C"], False),
    ("Battery", ["Percent%", "Voltage_V", "Temp_C"], False),
    ("Blink", ["Blink"], True),
    ("Jaw_Clench", ["JawClench"], True),
    ("JawClench", ["JawClench"], True),
    ("HSI_PREC", ["TP9", "AF7", "AF8", "TP10"], True),
    ("HSIPrec", ["TP9", "AF7", "AF8", "TP10"], True),
    ("HsiPrec", ["TP9", "AF7", "AF8", "TP10"], True),
    ("IS_GOOD", ["TP9", "AF7", "AF8", "TP10"], True),
    ("HeadOn", ["HeadOn"], True),
    ("Therm", ["Therm"], False),
    *((f"{band}_{kind}", ["TP9", "AF7", "AF8", "TP10"], False) for band in ("Alpha", "Beta", "Gamma", "Delta", "Theta") for kind in ("Relative", "Absolute")),
]


def messages(chunks: DataFrame) -> DataFrame:
    """Rows ``session_id, seq, chunk`` to one row per complete and valid message: session_id, msg, body (map of strings).

    A chunk's first character is its length and NULs pad it.  Messages end at the first closing brace and
    begin at the first opening one after the last message; what does not parse is skipped.  The pieces of a
    message meet by a running count of closing braces, so no session is ever gathered in one place.
    """
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    text = F.replace(F.substr(F.col("chunk"), F.lit(2)), F.lit("\x00"), F.lit(""))
    cut = chunks.select("session_id", "seq", F.split(text, r"\}", -1).alias("p")).withColumn("n", (F.size("p") - 1).cast("bigint"))
    placed = cut.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    pieces = placed.select("session_id", "seq", "n", "before", F.posexplode("p").alias("i", "piece"))
    own = pieces.groupBy("session_id", (F.col("before") + F.col("i")).alias("msg")).agg(F.max((F.col("i") < F.col("n")).cast("int")).alias("closed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "i", "piece"))), lambda s: s["piece"]), "").alias("t"))
    body = F.concat(F.regexp_extract("t", r"(?s)(\{.*)", 1), F.lit("}"))
    return own.filter("closed = 1").select("session_id", "msg", F.from_json(body, "map<string,string>").alias("body")).filter("body is not null")


def battery(found: DataFrame) -> DataFrame:
    """Percent, voltage (unknown: 0) and temperature (0 if absent) of the messages that tell the battery's state."""
    number = lambda k: F.col("body")[k].try_cast("double")
    return found.filter(F.map_contains_key("body", F.lit("bp"))).select("session_id", "msg", number("bp").alias("percent"), F.lit(0.0).alias("voltage"), F.coalesce(number("tp"), F.lit(0.0)).alias("temperature"))


def state_changes(states: DataFrame, keys: tuple[str, ...] = ("session_id",), order: str = "seq", state: str = "state") -> DataFrame:
    """Rows whose state differs from the one before, with the bits that changed; rows without a state do not count."""
    known = states.filter(F.col(state).isNotNull())
    return known.withColumn("was", F.lag(state).over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("was") != F.col(state)).withColumn("changed", F.col(state).bitwiseXOR(F.col("was")))


def unknown_keys(found: DataFrame) -> DataFrame:
    """Messages that hold keys outside ``KNOWN_KEYS``, with those entries."""
    left = F.map_filter("body", lambda k, v: ~k.isin(KNOWN_KEYS))
    return found.withColumn("unknown", left).filter(F.size("unknown") > 0).select("session_id", "msg", "unknown")


def catalogue(spark: SparkSession) -> DataFrame:
    """The stream catalogue: rank, key, labels, whole."""
    return spark.createDataFrame([(i, *s) for i, s in enumerate(STREAMS)], "rank int, key string, labels array<string>, whole boolean")


def describe_streams(streams: DataFrame) -> DataFrame:
    """Rows ``name, type`` with the first catalogue entry whose key begins the name or the type; labels are empty without one.

    The catalogue has 26 rows, so it is broadcast.
    """
    c = catalogue(streams.sparkSession)
    met = streams.distinct().join(F.broadcast(c), F.startswith("name", c["key"]) | F.startswith("type", c["key"]), "left")
    first = met.groupBy("name", "type").agg(F.min_by(F.struct("key", "labels", "whole"), "rank").alias("m"))
    return first.select("name", "type", F.col("m.key").alias("key"), F.coalesce("m.labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("m.whole", F.lit(False)).alias("whole"))


def channel_labels(n: Column, custom: Column, own: Column, fallback: Column) -> Column:
    """Names of a stream's channels: the configured ones if their number fits, else the stream's own, else the catalogue's, else numbers."""
    fits = lambda a: F.when(F.size(a) == n, a)
    numbered = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("channel_"), i.cast("string")))
    return F.coalesce(fits(custom), fits(own), fits(fallback), numbered)


def throttled(rows: DataFrame, keys: tuple[str, ...], seconds: float = 1.0, time: str = "time", order: str = "seq") -> DataFrame:
    """The latest row of each key in every stretch of ``seconds``."""
    rest = [c for c in rows.columns if c not in keys]
    made = rows.groupBy(*keys, F.floor(F.col(time) / seconds).alias("_s")).agg(F.max_by(F.struct(*rest), F.struct(time, order)).alias("r"))
    return made.select(*keys, "r.*")
