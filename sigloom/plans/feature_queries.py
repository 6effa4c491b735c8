"""Queries of epochs, features and indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import features as feat
from ..operators import indices
from . import views as V

FS, SIZE = 32.0, 32


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for the comparison; plain means keep eight digits, as means of short decimals tie at six."""
    return df.select(*(F.round(c, 8 if c.endswith("mean") else digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _long(spark, d):
    return feat.to_long(V.sig_wide(spark, d, FS))


def _features(spark, d, **switch):
    return feat.epoch_features(_long(spark, d), FS, SIZE, **switch)


def epoch_split(spark, d):
    return rounded(feat.epochs(_long(spark, d), SIZE).select("session_id", "epoch", "ch", "timestamp", "n", F.get("x", F.lit(0)).alias("first"), F.element_at("x", -1).alias("last")))


def time_features(spark, d):
    return rounded(_features(spark, d, frequency=False).drop("timestamp", "n"))


def band_powers(spark, d):
    return rounded(_features(spark, d, time=False).select("session_id", "epoch", "ch", *feat.FREQUENCY))


def feature_table(spark, d):
    """The 88-column wide table; a few columns of each family are compared."""
    wide = feat.to_wide(_features(spark, d), feat.TIME + feat.FREQUENCY)
    return rounded(wide)


def channel_subset(spark, d):
    return rounded(_features(spark, d, frequency=False, channels=["CH2", "CH3"]).select("session_id", "epoch", "ch", "mean", "ptp"))


def attention_raw(spark, d):
    return rounded(indices.attention(_features(spark, d, time=False)).drop("n_valid_ch"))


def attention_level(spark, d):
    out = indices.smooth(indices.attention(_features(spark, d, time=False)), ["attention_score", "engagement_index", "theta_alpha_ratio"], "attention_score")
    return rounded(out.drop("n_valid_ch"))


def cognitive_load_level(spark, d):
    out = indices.smooth(indices.cognitive_load(_features(spark, d, time=False)), ["cog_load_score", "cognitive_load_index"], "cog_load_score")
    return rounded(out.select("session_id", "epoch", "timestamp", "cog_load_score", "level"))


def level_codec(spark, d):
    score = F.col("value") / 100
    u = V.sig_user(spark, d).select("event_id", X.level(score).alias("level"), score.alias("score"))
    return u.select("event_id", "level", X.level_code(F.col("level")).alias("code"), X.level_name(X.level_code(F.col("level")).cast("double")).alias("decoded"))


def array_epochs(spark, d):
    """Embeddings as one epoch each: the array form of the same operators."""
    e = V.table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.size("embedding").cast("bigint").alias("n"))
    out = feat.frequency_domain(feat.time_domain(e), 64.0)
    return rounded(out.select("vec_id", "label", "mean", "std", "ptp", "zcr", "skew", "hjorth_mobility", "total_power"), 4)


def quality_hf(spark, d):
    win = feat.to_long(V.sig_wide(spark, d, 256.0)).withColumn("win", F.floor(F.col("seq") / 512).cast("bigint"))
    return rounded(feat.hf_ratio(win, 256.0, ["session_id", "win", "ch"]), 4)


QUERIES = {f.__name__: f for f in (epoch_split, time_features, band_powers, feature_table, channel_subset, attention_raw, attention_level, cognitive_load_level, level_codec, array_epochs, quality_hf)}

_TD = """, d1 AS (SELECT *, value - lag(value) OVER w AS d FROM ep WINDOW w AS (PARTITION BY session_id, epoch, ch ORDER BY i)),
d2 AS (SELECT *, d - lag(d) OVER w AS dd, lag(value) OVER w AS pv FROM d1 WINDOW w AS (PARTITION BY session_id, epoch, ch ORDER BY i)),
mm AS (SELECT *, avg(value) OVER (PARTITION BY session_id, epoch, ch) AS mu FROM d2),
td AS (SELECT session_id, epoch, ch, any_value(mu) AS mean, stddev_pop(value) AS std, var_pop(value) AS var, avg(pow(value - mu, 3)) / pow(var_pop(value), 1.5) AS skew, avg(pow(value - mu, 4)) / pow(var_pop(value), 2) - 3 AS kurtosis,
  max(value) - min(value) AS ptp, count(*) FILTER (sign(value) <> sign(pv)) / count(*) AS zcr, var_pop(value) AS hjorth_activity, stddev_pop(d) / stddev_pop(value) AS hjorth_mobility,
  stddev_pop(dd) / stddev_pop(d) / (stddev_pop(d) / stddev_pop(value)) AS hjorth_complexity FROM mm GROUP BY ALL)"""
_FQ = """, en AS (SELECT session_id, epoch, ch, -sum(p / (s + 1e-12) * log2(p / (s + 1e-12) + 1e-12)) AS spectral_entropy FROM (SELECT *, sum(p) OVER (PARTITION BY session_id, epoch, ch) AS s FROM psd) GROUP BY ALL),
fq AS (SELECT session_id, epoch, ch, delta, theta, alpha, beta, gamma, delta + theta + alpha + beta + gamma AS total, spectral_entropy FROM bp JOIN en USING (session_id, epoch, ch))"""
_R = lambda names: ", ".join(f"round({n}, {8 if n.endswith('mean') else 6}) AS {n}" for n in names)
_BANDS = ["delta", "theta", "alpha", "beta", "gamma"]
_FQ_COLS = ", ".join([f"round({b}, 6) AS {b}_power" for b in _BANDS] + [f"round({b} / total, 6) AS {b}_rel" for b in _BANDS] + ["round(total, 6) AS total_power", "round(spectral_entropy, 6) AS spectral_entropy"])
_WIDE = ", ".join(
    [f"round(max({n}) FILTER (ch = '{c}'), {8 if n == 'mean' else 6}) AS {c}_{n}" for c in ("CH1", "CH2", "CH3", "CH4") for n in feat.TIME]
    + [f"round(max({e}) FILTER (ch = '{c}'), 6) AS {c}_{n}" for c in ("CH1", "CH2", "CH3", "CH4") for e, n in [*((b, f"{b}_power") for b in _BANDS), *((f"{b} / total", f"{b}_rel") for b in _BANDS), ("total", "total_power"), ("spectral_entropy", "spectral_entropy")]]
)


def _with(names: str, ctes: str, body: str) -> str:
    return V.sql(names, "@").rsplit(" @", 1)[0] + ctes + " " + body


SQL = {
    "epoch_split": V.sql("ep", "SELECT session_id, epoch, ch, round(min(time), 6) AS timestamp, count(*) AS n, round(min_by(value, i), 6) AS first, round(max_by(value, i), 6) AS last FROM ep GROUP BY ALL"),
    "time_features": _with("ep", _TD, f"SELECT session_id, epoch, ch, {_R(feat.TIME)} FROM td"),
    "band_powers": _with("bands", _FQ, f"SELECT session_id, epoch, ch, {_FQ_COLS} FROM fq"),
    "feature_table": _with("bands", _TD + _FQ, f"SELECT session_id, epoch, round(any_value(timestamp), 6) AS timestamp, {_WIDE} FROM td JOIN fq USING (session_id, epoch, ch) JOIN (SELECT session_id, epoch, min(time) AS timestamp FROM ep GROUP BY ALL) USING (session_id, epoch) GROUP BY session_id, epoch"),
    "channel_subset": V.sql("ep", "SELECT session_id, epoch, ch, round(avg(value), 8) AS mean, round(max(value) - min(value), 6) AS ptp FROM ep WHERE ch IN ('CH2', 'CH3') GROUP BY ALL"),
    "attention_raw": V.sql("idx", "SELECT session_id, epoch, round(timestamp, 6) AS timestamp, round(tar, 6) AS theta_alpha_ratio, round(ei, 6) AS engagement_index, round(att, 6) AS attention_score FROM idx"),
    "attention_level": V.sql("att", "SELECT session_id, epoch, round(timestamp, 6) AS timestamp, round(theta_alpha_ratio, 6) AS theta_alpha_ratio, round(engagement_index, 6) AS engagement_index, round(attention_score, 6) AS attention_score, level FROM att"),
    "cognitive_load_level": V.sql("att", "SELECT session_id, epoch, round(timestamp, 6) AS timestamp, round(cog_load_score, 6) AS cog_load_score, clevel AS level FROM att"),
    "level_codec": "SELECT event_id, CASE WHEN value / 100 >= 0.65 THEN 'high' WHEN value / 100 >= 0.4 THEN 'medium' ELSE 'low' END AS level, CAST(CASE WHEN value / 100 >= 0.65 THEN 2 WHEN value / 100 >= 0.4 THEN 1 ELSE 0 END AS BIGINT) AS code, CASE WHEN value / 100 >= 0.65 THEN 'high' WHEN value / 100 >= 0.4 THEN 'medium' ELSE 'low' END AS decoded FROM events",
    "array_epochs": """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v, len(embedding) AS n FROM embeddings),
m AS (SELECT *, avg(v) OVER p AS mu, lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS pv FROM e WINDOW p AS (PARTITION BY vec_id)),
t AS (SELECT vec_id, label, any_value(mu) AS mean, stddev_pop(v) AS std, max(v) - min(v) AS ptp, count(*) FILTER (sign(v) <> sign(pv)) / count(*) AS zcr, avg(pow(v - mu, 3)) / pow(var_pop(v), 1.5) AS skew, stddev_pop(v - pv) / stddev_pop(v) AS hjorth_mobility FROM m GROUP BY ALL),
y AS (SELECT vec_id, i, n, (v - mu) * (0.5 - 0.5 * cos(2 * pi() * i / n)) AS y, sum(pow(0.5 - 0.5 * cos(2 * pi() * i / n), 2)) OVER (PARTITION BY vec_id) AS ww FROM m),
p AS (SELECT vec_id, k, (pow(sum(y * cos(2 * pi() * k * i / n)), 2) + pow(sum(y * sin(2 * pi() * k * i / n)), 2)) / (64.0::DOUBLE * any_value(ww)) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM y, range(0, 33) r(k) GROUP BY vec_id, k),
b(name, lo, hi) AS (VALUES ('a', 1, 4), ('a', 4, 8), ('a', 8, 13), ('low', 13, 20), ('high', 20, 30), ('a', 30, 45)),
s AS (SELECT vec_id, name, sum((p + p2) / 2) AS v FROM (SELECT *, lead(p) OVER (PARTITION BY vec_id ORDER BY k) AS p2 FROM p) JOIN b ON k >= lo AND k + 1 <= least(hi, 32) GROUP BY ALL),
w AS (SELECT vec_id, max(v) FILTER (name = 'a') AS a, max(v) FILTER (name = 'low') AS lo, max(v) FILTER (name = 'high') AS hi FROM s GROUP BY ALL)
SELECT t.vec_id, label, round(mean, 8) AS mean, round(std, 4) AS std, round(ptp, 4) AS ptp, round(zcr, 4) AS zcr, round(skew, 4) AS skew, round(hjorth_mobility, 4) AS hjorth_mobility, round(a + lo + greatest(0, least(1, 1 - (hi / (lo + 1e-10) - 1.5) / 1.5)) * hi, 4) AS total_power FROM t JOIN w USING (vec_id)""",
    "quality_hf": V.sql(
        "long",
        """@""",
    ).replace(
        "@",
        """, l AS (SELECT session_id, seq // 512 AS win, ch, seq % 512 AS i, value - avg(value) OVER p AS v, count(*) OVER p AS len FROM long WINDOW p AS (PARTITION BY session_id, seq // 512, ch)),
g AS (SELECT *, least(256, len) AS n, unnest(range(0, len - least(256, len) + 1, least(256, len) - least(256, len) // 2)) AS a FROM l WHERE len >= 32),
s AS (SELECT session_id, win, ch, a, n, i - a AS t, v - avg(v) OVER (PARTITION BY session_id, win, ch, a) AS v FROM g WHERE i >= a AND i < a + n),
y AS (SELECT *, v * (0.5 - 0.5 * cos(2 * pi() * t / n)) AS y FROM s),
b AS (SELECT *, unnest(range(0, least(n // 2, 45 * n // 256 + 1) + 1)) AS k FROM y),
p AS (SELECT session_id, win, ch, a, k, k * 256.0::DOUBLE / any_value(n) AS f, (pow(sum(y * cos(2 * pi() * k * t / n)), 2) + pow(sum(y * sin(2 * pi() * k * t / n)), 2)) * CASE WHEN k = 0 OR 2 * k = any_value(n) THEN 1 ELSE 2 END AS p FROM b GROUP BY session_id, win, ch, a, k),
r AS (SELECT session_id, win, ch, coalesce(sum(p) FILTER (f >= 30 AND f <= 45), 0) AS hf, sum(p) FILTER (f >= 1 AND f <= 45) AS total FROM p GROUP BY ALL)
SELECT DISTINCT l.session_id, l.win, l.ch, round(CASE WHEN coalesce(total, 0) < 1e-12 THEN 0 ELSE hf / total END, 4) AS hf_ratio FROM l LEFT JOIN r ON l.session_id = r.session_id AND l.win = r.win AND l.ch = r.ch""",
    ),
}
