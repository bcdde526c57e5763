"""Intervals, durations and points in time.

Points in time are epoch seconds; ``now`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

MINUTE, HOUR, DAY = 60, 3600, 86400

# Minutes per interval unit.
INTERVAL_UNITS = {"m": 1, "h": 60, "d": 1440, "w": 10080}

# Upper bound in seconds (exclusive), text, and the seconds one
# unit stands for.  {} is the whole number of units, never below 2.
AGE_STEPS = [
    (45, "seconds", None),
    (90, "a minute", None),
    (2700, "{} minutes", 60),
    (5400, "an hour", None),
    (79200, "{} hours", 3600),
    (129600, "a day", None),
    (2592000, "{} days", 86400),
    (3888000, "a month", None),
]
AGE_YEAR_STEPS = [(47304000, "a year", None), (None, "{} years", 31536000)]
AGE_NOW_BELOW, AGE_NOW_TEXT = 10, "just now"
AGE_MONTHS_BELOW, AGE_MONTHS_TEXT = 29808000, "{} months"


def interval_minutes(literal: Column, strict: bool = True) -> Column:
    """``30m``, ``24h``, ``90d``, ``1w`` (any case) as minutes; NULL stays NULL.

    Signs are refused too.  Anything else raises, or becomes NULL when ``strict`` is off.
    """
    pattern = r"\A\s*(\d+)\s*([mhdwMHDW])\z"
    units = F.create_map(*[F.lit(x) for pair in INTERVAL_UNITS.items() for x in pair])
    minutes = F.regexp_extract(literal, pattern, 1).cast("bigint") * units[
        F.lower(F.regexp_extract(literal, pattern, 2))
    ]
    bad = (
        F.raise_error(F.concat(F.lit("Invalid interval: "), literal)).cast("bigint")
        if strict
        else F.lit(None).cast("bigint")
    )
    return F.when(literal.isNull(), None).when(F.rlike(literal, F.lit(pattern)), minutes).otherwise(bad)


def whole_units(seconds: Column, unit: int) -> Column:
    """Whole units in a number of seconds, cut towards zero."""
    return F.call_function("div", seconds.cast("bigint"), F.lit(unit))


def floor_units(amount: Column, unit: int) -> Column:
    """Whole units in an amount, cut downwards, also below zero."""
    return whole_units(amount - F.pmod(amount, F.lit(unit)), unit)


def epoch_micros(df: DataFrame, column: str) -> Column:
    """A time column of ``df`` as epoch microseconds; one without a zone is taken as UTC."""
    if isinstance(df.schema[column].dataType, TimestampNTZType):
        # Undo the session's zone, which the cast applies.
        instant = F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())
        return F.unix_micros(instant)
    return F.unix_micros(column)


def epoch_seconds(df: DataFrame, column: str) -> Column:
    return floor_units(epoch_micros(df, column), 1_000_000)


def _part(amount: Column, unit: str, shown: Column) -> Column:
    return F.when(shown, F.concat(amount.cast("string"), F.lit(unit)))


def minutes_text(seconds: Column) -> Column:
    """``21m 13s``; minutes are not folded into hours; 0 and NULL give an empty text."""
    minutes, rest = whole_units(seconds, MINUTE), F.pmod(seconds, F.lit(MINUTE))
    return F.concat_ws(" ", _part(minutes, "m", minutes != 0), _part(rest, "s", rest != 0))


def duration_text(seconds: Column) -> Column:
    """``1d 2h 11m 13s``; NULL gives an empty text.

    Exactly one day still reads ``24h``; after a number of days the hours are
    shown even if 0, as long as something follows the days.
    """
    in_day = F.pmod(seconds, F.lit(DAY))
    in_hour, in_minute = F.pmod(seconds, F.lit(HOUR)), F.pmod(seconds, F.lit(MINUTE))
    parts = F.concat_ws(
        " ",
        _part(whole_units(seconds, DAY), "d", seconds >= DAY),
        _part(whole_units(in_day, HOUR), "h", (in_day >= HOUR) | ((seconds > DAY) & (in_day > 0))),
        _part(whole_units(in_hour, MINUTE), "m", in_hour >= MINUTE),
        _part(in_minute, "s", in_minute > 0),
    )
    return (
        F.when(seconds.isNull(), "")
        .when(seconds < MINUTE, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds == DAY, "24h")
        .otherwise(parts)
    )


def interval_text(minutes: Column) -> Column:
    return duration_text(minutes.cast("bigint") * MINUTE)


def mean_text(mean: Column) -> Column:
    """A mean in seconds, rounded half to even."""
    return duration_text(F.bround(mean, 0).cast("bigint"))


def delta_text(earlier: Column, later: Column) -> Column:
    return duration_text(later - earlier)


def _shift(epoch: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)


def _wall_clock(epoch: Column, zone: str, pattern: str) -> Column:
    """Format a local time; the outer shift undoes the session's own zone."""
    shown = F.to_utc_timestamp(_shift(epoch, zone), F.current_timezone())
    return F.date_format(shown, pattern)


def long_text(epoch: Column, zone: str = "UTC") -> Column:
    """``Tuesday, March 27, 11:54:58``; NULL gives an empty text."""
    return F.coalesce(_wall_clock(epoch, zone, "EEEE, MMMM dd, HH:mm:ss"), F.lit(""))


def clock_text(epoch: Column, zone: str = "UTC") -> Column:
    """``11:54:58``; NULL gives an empty text."""
    return F.coalesce(_wall_clock(epoch, zone, "HH:mm:ss"), F.lit(""))


def iso_text(epoch: Column, zone: str = "UTC", separator: str = "T") -> Column:
    """``2018-03-27T11:54:58+00:00``; NULL stays NULL."""
    offset = F.unix_seconds(_shift(epoch, zone)) - epoch
    size = F.abs(offset)
    offset_text = F.concat(
        F.when(offset < 0, "-").otherwise("+"),
        F.lpad(whole_units(size, HOUR).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad(whole_units(F.pmod(size, F.lit(HOUR)), MINUTE).cast("string"), 2, "0"),
    )
    return F.concat(_wall_clock(epoch, zone, f"yyyy-MM-dd'{separator}'HH:mm:ss"), offset_text)


def date_text(epoch: Column, zone: str = "UTC") -> Column:
    """``iso_text`` with an empty text for NULL."""
    return F.coalesce(iso_text(epoch, zone), F.lit(""))


def age_text(epoch: Column, now: int | Column) -> Column:
    """``2 hours ago``, ``in 3 days``, ``just now``; NULL gives an empty text."""
    now = now if isinstance(now, Column) else F.lit(now)
    behind = now.cast("bigint") - epoch
    size = F.abs(behind)
    then_day, now_day = F.timestamp_seconds(epoch), F.timestamp_seconds(now)
    months = F.abs(
        (F.year(now_day) * 12 + F.month(now_day)) - (F.year(then_day) * 12 + F.month(then_day))
    )

    def text(words: str, count: Column | None) -> Column:
        if count is None:
            return F.lit(words)
        return F.concat(F.greatest(count, F.lit(2)).cast("string"), F.lit(words.replace("{}", "")))

    ladder = F.when(size < AGE_NOW_BELOW, AGE_NOW_TEXT)
    for below, words, unit in AGE_STEPS:
        ladder = ladder.when(size < below, text(words, unit and whole_units(size, unit)))
    ladder = ladder.when(size < AGE_MONTHS_BELOW, text(AGE_MONTHS_TEXT, months))
    for below, words, unit in AGE_YEAR_STEPS:
        reached = F.lit(True) if below is None else size < below
        ladder = ladder.when(reached, text(words, unit and whole_units(size, unit)))
    before = F.when((behind < 0) & (size >= AGE_NOW_BELOW), "in ").otherwise("")
    after = F.when((behind > 0) & (size >= AGE_NOW_BELOW), " ago").otherwise("")
    return F.when(epoch.isNull(), "").otherwise(F.concat(before, ladder, after))
