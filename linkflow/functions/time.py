"""Time-key column functions (timestamps are wall-clock ``timestamp_ntz``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
SECONDS_PER_WEEK = 7 * SECONDS_PER_DAY

_UNITS = {"s": 1, "sec": 1, "second": 1, "seconds": 1,
          "min": 60, "minute": 60, "minutes": 60,
          "h": 3600, "hour": 3600, "hours": 3600}


def freq_seconds(freq) -> int:
    """'15min' / '5 minutes' / '1h' / 900 -> seconds."""
    if isinstance(freq, (int, float)):
        return int(freq)
    s = str(freq).strip().lower().replace(" ", "")
    num = "".join(ch for ch in s if ch.isdigit()) or "1"
    unit = s[len(num):] if s.startswith(num) else s
    if unit not in _UNITS:
        raise ValueError(f"unsupported frequency {freq!r}")
    return int(num) * _UNITS[unit]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_seconds(col) -> Column:
    """Whole epoch seconds of a wall-clock timestamp (floored; zone independent)."""
    return F.unix_timestamp(_c(col))


def seconds_between(start, end) -> Column:
    """Number of second boundaries crossed from ``start`` to ``end``.

    Same as T-SQL ``datediff(second, start, end)``: both ends are floored to whole
    seconds before subtracting, so 10:00:00.9 -> 10:00:01.1 counts 1.
    """
    return epoch_seconds(end) - epoch_seconds(start)


def _sub_seconds(col: Column, secs: Column) -> Column:
    return col - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def floor_time(col, freq="15min") -> Column:
    """Floor a wall-clock timestamp to a bin of ``freq`` aligned to the epoch (midnight).

    Keeps the ``timestamp_ntz`` type and never consults the session time zone.
    """
    step = freq_seconds(freq)
    c = _c(col)
    frac = F.date_part(F.lit("SECOND"), c) - F.second(c)
    return _sub_seconds(c, (epoch_seconds(c) % F.lit(step)) + frac)


def seconds_of_day(col) -> Column:
    c = _c(col)
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def iso_dow(col) -> Column:
    """Monday = 1 .. Sunday = 7 (T-SQL ``datepart(weekday)`` under ``datefirst 1``)."""
    return (F.weekday(_c(col)) + 1).cast("int")


def day_name(col) -> Column:
    """English day name, e.g. 'Thursday'."""
    return F.date_format(_c(col), "EEEE")


def operating_dow(day_type, planned_arrival) -> Column:
    """Day-of-week of a journey from its timetable type.

    Type 1 (ordinary weekday timetable): weekday of the planned arrival date;
    type 2: 6 (Saturday timetable); type 3: 7 (Sunday timetable). Any other
    type: NULL (CASE without ELSE).
    """
    t = _c(day_type)
    return (F.when(t == 1, iso_dow(F.to_date(_c(planned_arrival))))
            .when(t == 2, F.lit(6)).when(t == 3, F.lit(7))).cast("int")


def slot_of_week(dow, ts, freq="15min") -> Column:
    """0-based slot of the week for a day-of-week (1..7) and the time of day of ``ts``.

    Seconds are dropped (hour and minute only), so ``freq`` must be whole minutes and
    divide a day. 15 minutes gives 672 slots.
    """
    step = freq_seconds(freq)
    if step % 60 or SECONDS_PER_DAY % step:
        raise ValueError("freq must be whole minutes dividing a day")
    c = _c(ts)
    minute_of_day = F.hour(c) * 60 + F.minute(c)
    return ((_c(dow) - 1) * (SECONDS_PER_DAY // step)
            + F.floor(minute_of_day * 60 / F.lit(step))).cast("int")


def slot_timestamp(slot, freq="15min") -> Column:
    """Render a slot number as a 1970-01-01 .. 1970-01-07 wall-clock timestamp."""
    step = freq_seconds(freq)
    return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _c(slot) * F.lit(step)))


def reference_timestamp(dow, ts, year=2007, freq="15min") -> Column:
    """Older variant of the slot key: year/1/dow + floored hour and minute (2007-01-01 is a Monday)."""
    binned = floor_time(ts, freq)
    return F.make_timestamp_ntz(F.lit(year), F.lit(1), _c(dow), F.hour(binned),
                                F.minute(binned), F.lit(0))


def minutes_between(start, end) -> Column:
    """Elapsed minutes (fractional) from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double") / F.lit(60_000_000.0)


def lead_time_bucket(log_time, departure) -> Column:
    """Half-open lead-time buckets of (departure - log time).

    [0,15) -> '15min', [15,30) -> '30min', [30,45) -> '45min', >= 45 -> '45min+';
    negative or missing -> NULL.
    """
    m = minutes_between(log_time, departure)
    return (F.when(m >= 45, "45min+").when(m >= 30, "45min")
            .when(m >= 15, "30min").when(m >= 0, "15min"))


def time_of_day_between(ts, start: str, end: str) -> Column:
    """Inclusive time-of-day range, e.g. ('06:00', '22:00') keeps 22:00 but not 22:15."""
    def secs(hhmm: str) -> int:
        parts = [int(p) for p in hhmm.split(":")]
        while len(parts) < 3:
            parts.append(0)
        return parts[0] * 3600 + parts[1] * 60 + parts[2]
    sod = seconds_of_day(ts) + (F.date_part(F.lit("SECOND"), _c(ts)) - F.second(_c(ts)))
    return (sod >= secs(start)) & (sod <= secs(end))
