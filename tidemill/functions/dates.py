"""Dates: a date carries a time of day, so all functions take and give timestamps."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970, for timestamps with and without a zone (the session's is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def _at(m: Column) -> Column:
    return F.timestamp_micros(m.cast("bigint")).cast("timestamp_ntz")


def plus_days(ts: Column, n: Column) -> Column:
    """Fractional days as well."""
    return _at(micros(ts) + F.round(n * DAY))


def minus(a: Column, b: Column) -> Column:
    """Days between two dates, with their fraction."""
    return (micros(a) - micros(b)) / F.lit(float(DAY))


def time_of_day(ts: Column) -> Column:
    return micros(ts) - micros(F.date_trunc("day", ts))


def add_months(ts: Column, n: Column) -> Column:
    """Keeps the time of day; the last day of a month stays the last day."""
    n = F.floor(n).cast("int")
    day = F.add_months(ts.cast("date"), n)
    day = F.when(ts.cast("date") == F.last_day(ts), F.last_day(day)).otherwise(day)
    return _at(micros(day.cast("timestamp")) + time_of_day(ts))


def last_day(ts: Column) -> Column:
    return _at(micros(F.last_day(ts).cast("timestamp")) + time_of_day(ts))


_DAYS = ("SU", "MO", "TU", "WE", "TH", "FR", "SA")


def next_day(ts: Column, day: str | int) -> Column:
    """The next such weekday: a name, or 1 for Sunday to 7. Keeps the time of day."""
    name = _DAYS[day - 1] if isinstance(day, int) else day
    return _at(micros(F.next_day(ts, name).cast("timestamp")) + time_of_day(ts))


def months_between(a: Column, b: Column) -> Column:
    return F.months_between(a, b, roundOff=False)


_UNITS = {"YYYY": "year", "YY": "year", "YEAR": "year", "Q": "quarter", "MM": "month", "MON": "month", "MONTH": "month", "DD": "day", "DAY": "week", "IW": "week", "HH": "hour", "HH24": "hour", "MI": "minute", "SS": "second"}


def trunc(ts: Column, unit: str = "DD") -> Column:
    return F.date_trunc(_UNITS[unit.upper()], ts).cast("timestamp_ntz")


def round_to(ts: Column, unit: str = "DD") -> Column:
    """Half up: years from July, months from the 16th, days from noon, smaller units from their half."""
    name = _UNITS[unit.upper()]
    low = F.date_trunc(name, ts).cast("timestamp_ntz")
    step = {"year": F.expr("interval 1 year"), "quarter": F.expr("interval 3 months"), "month": F.expr("interval 1 month"), "week": F.expr("interval 7 days"), "day": F.expr("interval 1 day"), "hour": F.expr("interval 1 hour"), "minute": F.expr("interval 1 minute"), "second": F.expr("interval 1 second")}[name]
    half = {"year": F.month(ts) >= 7, "month": F.dayofmonth(ts) >= 16}.get(name)
    if half is None:
        half = 2 * (micros(ts) - micros(low)) >= micros(low + step) - micros(low)
    return F.when(half, low + step).otherwise(low)


#: Elements of format models and what Java calls them, longest first.
_ELEMENTS = (("YYYY", "yyyy"), ("HH24", "HH"), ("HH12", "hh"), ("MONTH", "MMMM"), ("MON", "MMM"), ("DDD", "DDD"), ("DAY", "EEEE"), ("FF6", "SSSSSS"), ("FF3", "SSS"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("DY", "EEE"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("AM", "a"), ("PM", "a"), ("Q", "q"))


def java_format(model: str) -> str:
    """A format model as Java's pattern; text in double quotes is literal."""
    out, i = "", 0
    while i < len(model):
        if model[i] == '"':
            end = model.index('"', i + 1)
            out += "'" + model[i + 1 : end] + "'"
            i = end + 1
            continue
        for name, java in _ELEMENTS:
            if model[i : i + len(name)].upper() == name:
                out += java
                i += len(name)
                break
        else:
            out += f"'{model[i]}'" if re.match(r"[A-Za-z]", model[i]) else model[i]
            i += 1
    return out


def to_char(ts: Column, model: str) -> Column:
    return F.date_format(ts, java_format(model))


def to_date(s: Column, model: str = "YYYY-MM-DD HH24:MI:SS") -> Column:
    return F.to_timestamp_ntz(s, F.lit(java_format(model)))


def timestampdiff(unit: str, a: Column, b: Column) -> Column:
    """Whole units from a to b: a month counts when b's day and time reach a's; weeks follow from days, quarters and years
    from months."""
    unit = unit.upper()
    if unit in ("MONTH", "QUARTER", "YEAR"):
        def months(x, y):
            n = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
            rest = lambda t: F.dayofmonth(t).cast("bigint") * DAY + time_of_day(t)
            return n - F.when(rest(y) < rest(x), 1).otherwise(0)

        whole = F.when(micros(b) >= micros(a), months(a, b)).otherwise(-months(b, a)).cast("bigint")
        per = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[unit]
    else:
        whole = micros(b) - micros(a)
        per = {"MICROSECOND": 1, "SECOND": 10**6, "MINUTE": 6 * 10**7, "HOUR": 36 * 10**8, "DAY": DAY, "WEEK": 7 * DAY}[unit]
    return (F.signum(whole.cast("double")).cast("bigint") * F.floor(F.abs(whole) / per)).cast("bigint")


_SECONDS = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}


def num_to_ds(n: Column, unit: str) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n * _SECONDS[unit.upper()]).cast("decimal(18,6)"))


def num_to_ym(n: Column, unit: str) -> Column:
    months = F.floor(n * (12 if unit.upper() == "YEAR" else 1)).cast("int")
    return F.make_ym_interval(F.lit(0), months)


def _part(s: Column, pattern: str, kind: str = "bigint") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).try_cast(kind), F.lit(0).cast(kind))


def to_ds_interval(s: Column) -> Column:
    """An interval from 'D HH:MI:SS[.F]' or an ISO-8601 duration 'P1DT2H3M4.5S'; null for other text."""
    iso = s.rlike(r"^-?P(\d+D)?(T(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$")
    plain = s.rlike(r"^[+-]?\d+ \d{1,2}:\d{2}:\d{2}(\.\d+)?$")
    whole = F.when(iso, _part(s, r"(\d+)D") * 86400 + _part(s, r"(\d+)H") * 3600 + _part(s, r"T(?:\d+H)?(\d+)M") * 60)
    whole = whole.when(plain, _part(s, r"^[+-]?(\d+) ") * 86400 + _part(s, r" (\d+):") * 3600 + _part(s, r":(\d+):") * 60)
    rest = F.when(iso, _part(s, r"(\d+(?:\.\d+)?)S", "decimal(18,6)")).otherwise(_part(s, r":(\d+(?:\.\d+)?)$", "decimal(18,6)"))
    sign = F.when(s.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (sign * (whole + rest)).cast("decimal(18,6)"))


def to_ym_interval(s: Column) -> Column:
    """An interval from 'Y-M' or an ISO-8601 duration 'P1Y2M'; null for other text."""
    iso, plain = s.rlike(r"^-?P(\d+Y)?(\d+M)?$"), s.rlike(r"^[+-]?\d+-\d+$")
    months = F.when(iso, _part(s, r"(\d+)Y") * 12 + _part(s, r"(\d+)M")).when(plain, _part(s, r"(\d+)-") * 12 + _part(s, r"-(\d+)$"))
    return F.make_ym_interval(F.lit(0), (F.when(s.startswith("-"), F.lit(-1)).otherwise(F.lit(1)) * months).cast("int"))


def seconds(interval: Column) -> Column:
    """Seconds of a day-time interval, with their fraction."""
    return (F.timestamp_micros(F.lit(0)) + interval).cast("decimal(18,6)")


def timestampadd(unit: str, n: Column, ts: Column) -> Column:
    """Whole units added; months keep the day, or take the month's last one."""
    unit = unit.upper()
    if unit in ("MONTH", "QUARTER", "YEAR"):
        return ts.cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), n.cast("int") * {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[unit])
    return _at(micros(ts) + n.cast("bigint") * {"MICROSECOND": 1, "SECOND": 10**6, "MINUTE": 6 * 10**7, "HOUR": 36 * 10**8, "DAY": DAY, "WEEK": 7 * DAY}[unit])


def to_timestamp(s: Column, model: str = "YYYY-MM-DD HH24:MI:SS") -> Column:
    return to_date(s, model)


def from_unixtime(n: Column, model: str | None = None) -> Column:
    """Seconds since 1970 as a timestamp, or as text by a model."""
    at = _at(n.cast("decimal(20,6)") * 10**6)
    return to_char(at, model) if model else at


def from_tz(ts: Column, zone: Column) -> Column:
    """A wall-clock time with its zone: (utc, zone); Spark has no type for it."""
    return F.struct(F.to_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz").alias("utc"), zone.alias("zone"))


def sys_extract_utc(zoned: Column) -> Column:
    return zoned["utc"]


def local_of(zoned: Column) -> Column:
    """The wall-clock time of a time with its zone."""
    return F.from_utc_timestamp(zoned["utc"].cast("timestamp"), zoned["zone"]).cast("timestamp_ntz")


def now() -> Column:
    return F.localtimestamp()


def systimestamp() -> Column:
    return F.current_timestamp()


def utc_timestamp() -> Column:
    """Now, as a wall-clock time in UTC; also getutcdate and utc_date, which carry a time of day too."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
