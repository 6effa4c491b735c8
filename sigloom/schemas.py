"""Schemas and fixed names of the signal model.

Channels are parameters everywhere; these are the defaults.  A missing or bad sample is NULL inside
the engine; NaN and infinities become NULL at every scan (``functions.scalars.finite``).
"""

from pyspark.sql import types as T

CHANNELS = ["CH1", "CH2", "CH3", "CH4"]
IMU_AXES = ["AccX", "AccY", "AccZ", "GyrX", "GyrY", "GyrZ"]
LEVELS = {"low": 0, "medium": 1, "high": 2}

#: File-name prefix of each data type on disk, in catalogue order.
PREFIXES = {"raw": "EEG", "processed": "EEG_processed", "features": "features", "attention": "attention", "cognitive_load": "cognitive_load", "imu": "IMU"}

#: Closed frequency bands in Hz.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}
LOW_BETA, HIGH_BETA = (13.0, 20.0), (20.0, 30.0)


def doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


RAW_SEGMENT = T.StructType(doubles("timestamp", "ch_1", "ch_2", "ch_3", "ch_4"))
IMU_SEGMENT = T.StructType(doubles("timestamp", *IMU_AXES))
PROCESSED_SEGMENT = T.StructType(doubles("timestamp", *CHANNELS))
ATTENTION_SEGMENT = T.StructType(doubles("timestamp", "attention_score", "engagement_index", "theta_alpha_ratio", "level"))
LOAD_SEGMENT = T.StructType(doubles("timestamp", "cog_load_score", "cognitive_load_index", "level"))
SEGMENTS = {"raw": RAW_SEGMENT, "processed": PROCESSED_SEGMENT, "attention": ATTENTION_SEGMENT, "cognitive_load": LOAD_SEGMENT, "imu": IMU_SEGMENT}

MARKER = T.StructType([T.StructField("id", T.LongType()), T.StructField("content", T.StringType()), *doubles("start_ts", "end_ts"), T.StructField("start_str", T.StringType()), T.StructField("end_str", T.StringType()), *doubles("duration_s")])
MARKER_SESSION = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("received_at", T.StringType()), T.StructField("start_time", T.StringType()), *doubles("start_ts"), T.StructField("end_time", T.StringType()), *doubles("end_ts", "duration_seconds"), T.StructField("marker_count", T.LongType()), T.StructField("markers", T.ArrayType(MARKER))])
