"""Scalar expressions: indices, levels, time text, sanitising.  All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def finite(x: Column) -> Column:
    """NaN and infinities to NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    return a / (b + F.lit(EPS))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def attention_score(engagement: Column) -> Column:
    return logistic(3 * (engagement - 1))


def load_score(load_index: Column) -> Column:
    return logistic(2 * (load_index - 1.5))


def level(score: Column) -> Column:
    """high from 0.65, medium from 0.40, else low; NULL for no score."""
    return F.when(score >= 0.65, "high").when(score >= 0.40, "medium").when(score.isNotNull(), "low")


def level_code(name: Column) -> Column:
    return F.when(name == "high", 2).when(name == "medium", 1).otherwise(0).cast("bigint")


def level_name(code: Column) -> Column:
    return F.when(F.rint(code) == 2, "high").when(F.rint(code) == 1, "medium").otherwise("low")


def efficiency(focus: Column, optimal: Column, overload: Column) -> Column:
    """Both halves: clipped mixture; one half alone: that half; none: NULL.  Half-even, three digits."""
    both = F.greatest(F.lit(0.0), F.least(F.lit(1.0), focus * (0.5 + optimal) - overload * 0.5))
    return F.bround(F.when(focus.isNotNull() & optimal.isNotNull(), both).otherwise(F.coalesce(focus, optimal)), 3)


def grade(value: Column) -> Column:
    return F.when(value >= 0.7, "excellent").when(value >= 0.5, "good").when(value >= 0.3, "fair").when(value.isNotNull(), "poor")


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def clock_text(seconds: Column) -> Column:
    """HH:MM:SS.mmm, milliseconds truncated, in the session's time zone."""
    return F.date_format(F.timestamp_micros(F.floor(seconds * 1_000_000).cast("bigint")), "HH:mm:ss.SSS")


def date_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.floor(seconds * 1_000_000).cast("bigint")), "yyyy-MM-dd HH:mm:ss")


def session_seconds(session: Column) -> Column:
    """Epoch seconds of a YYYYMMDD_HHMMSS name, NULL for any other text."""
    return F.when(session.rlike(r"^\d{8}_\d{6}$"), F.unix_micros(F.try_to_timestamp(session, F.lit("yyyyMMdd_HHmmss"))) / 1e6)


def session_text(session: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS of a session name, the name itself if it is none."""
    s = lambda a, n: F.substring(session, a, n)
    made = F.concat(s(1, 4), F.lit("-"), s(5, 2), F.lit("-"), s(7, 2), F.lit(" "), s(10, 2), F.lit(":"), s(12, 2), F.lit(":"), s(14, 2))
    return F.when(session.rlike(r"^\d{8}_\d{6}$"), made).otherwise(session)


#: Fixed value: accepted time texts: date and time with T or a space, a fraction of the second optional; the day may be missing.
TIME_TEXT = r"^(\d{4}-\d{2}-\d{2}[T ])?\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"


def parse_time(text: Column, day: Column | None = None) -> Column:
    """Epoch seconds from a number, a date and time or, attached to ``day`` where one is given, a time of day; NULL otherwise."""
    shaped = F.when(text.rlike(TIME_TEXT), text)
    whole = shaped if day is None else F.when(F.length(F.substring_index(shaped, ".", 1)) == 8, F.concat(day, F.lit(" "), shaped)).otherwise(shaped)
    dated = F.when(F.length(F.substring_index(whole, ".", 1)) == 19, whole)
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(dated)) / 1e6)


def bar_percent(value: Column, most: Column) -> Column:
    return F.least(F.lit(100.0), value / F.greatest(most, F.lit(1e-9)) * 100)


def number_text(value: Column) -> Column:
    """Fewer decimals for larger numbers: one from 100, three from 1, four from 0.001, else exponential."""
    exponent = F.regexp_replace(F.format_string("%.2e", value), r"e([+-])0?(\d+)$", "e$1$2")
    return F.when(value.isNull() | F.isnan(value), "--").when(value >= 100, F.format_string("%.1f", value)).when(value >= 1, F.format_string("%.3f", value)).when(value >= 0.001, F.format_string("%.4f", value)).otherwise(exponent)


def display_mean(values: list[Column]) -> Column:
    """Sum with NULL as 0 over the number of channels present."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
    return total / len(values)


def optional_number(text: Column) -> Column:
    """A number from text; NULL for empty or other text."""
    return finite(F.trim(text).try_cast("double"))


def clock_seconds(text: Column) -> Column:
    """Seconds of the day of HH:MM:SS.mmm; NULL for other text."""
    part = lambda k: F.regexp_extract(text, r"^(\d{2}):(\d{2}):(\d{2}(?:\.\d+)?)$", k)
    return part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double")


def duration_text(first: Column, last: Column, points: Column) -> Column:
    """Minutes and seconds from one clock text to another, past midnight if the second is smaller; unknown below two points."""
    gap = F.round(clock_seconds(last) - clock_seconds(first), 3)
    whole = F.floor(F.when(gap < 0, gap + 86_400).otherwise(gap))
    return F.when((points < 2) | whole.isNull(), "unknown").otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit(" min "), (whole % 60).cast("string"), F.lit(" s")))
