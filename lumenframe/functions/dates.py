"""Date, time and duration functions over timestamp Columns; weeks begin on Monday, which is day 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "z": "xx", "Z": "z", "%": "%",
}
#: Microseconds of the units of round, floor and ceil.
UNITS = {"D": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1}


def java_pattern(fmt: str) -> str:
    """A strftime pattern in the letters of Spark's formatter; text in between is quoted."""
    out, plain, i = [], "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt) and fmt[i + 1] in _CODES:
            if plain:
                out.append(plain if not any(x.isalpha() for x in plain) else "'" + plain + "'")
                plain = ""
            out.append(_CODES[fmt[i + 1]])
            i += 2
        else:
            plain += fmt[i]
            i += 1
    if plain:
        out.append(plain if not any(x.isalpha() for x in plain) else "'" + plain + "'")
    return "".join(out)


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone (sessions run in UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def from_micros(n: Column) -> Column:
    return F.timestamp_micros(n.cast("bigint")).cast("timestamp_ntz")


def date(c: Column) -> Column:
    return F.to_date(c)


def time(c: Column) -> Column:
    return F.date_format(c, "HH:mm:ss.SSSSSS")


timetz = time
year, month, day, hour, minute, second, quarter, dayofyear = F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second, F.quarter, F.dayofyear
dayofweek = weekday = day_of_week = F.weekday
day_of_year, qyear = F.dayofyear, F.year


def microsecond(c: Column) -> Column:
    return F.pmod(micros(c), F.lit(1_000_000)).cast("int")


def nanosecond(c: Column) -> Column:
    """Always 0: timestamps have microseconds."""
    return F.when(c.isNotNull(), F.lit(0))


def days_in_month(c: Column) -> Column:
    return F.dayofmonth(F.last_day(c))


daysinmonth = days_in_month


def is_leap_year(c: Column) -> Column:
    y = F.year(c)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def is_month_start(c: Column) -> Column:
    return F.dayofmonth(c) == 1


def is_month_end(c: Column) -> Column:
    return F.to_date(c) == F.last_day(c)


def is_quarter_start(c: Column) -> Column:
    return is_month_start(c) & (F.month(c) % 3 == 1)


def is_quarter_end(c: Column) -> Column:
    return is_month_end(c) & (F.month(c) % 3 == 0)


def is_year_start(c: Column) -> Column:
    return F.dayofyear(c) == 1


def is_year_end(c: Column) -> Column:
    return (F.month(c) == 12) & (F.dayofmonth(c) == 31)


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM")


def day_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def strftime(c: Column, fmt: str) -> Column:
    return F.date_format(c, java_pattern(fmt))


def normalize(c: Column) -> Column:
    return F.date_trunc("day", c).cast("timestamp_ntz")


def floor(c: Column, unit: str = "D", every: int = 1) -> Column:
    n, step = micros(c), UNITS[unit] * every
    return from_micros(n - F.pmod(n, F.lit(step)))


def ceil(c: Column, unit: str = "D", every: int = 1) -> Column:
    n, step = micros(c), UNITS[unit] * every
    return from_micros(n + F.pmod(-n, F.lit(step)))


def round_(c: Column, unit: str = "D", every: int = 1) -> Column:
    """To the nearest multiple, a half to the even one."""
    n, step = micros(c), UNITS[unit] * every
    rest = F.pmod(n, F.lit(step))
    low = n - rest
    odd = F.pmod(F.floor(low / step), F.lit(2)) == 1
    return from_micros(F.when((rest * 2 > step) | ((rest * 2 == step) & odd), low + step).otherwise(low))


def isocalendar(c: Column) -> tuple[Column, Column, Column]:
    """ISO year, week and day (Monday is 1)."""
    return F.extract(F.lit("YEAROFWEEK"), c), F.weekofyear(c), F.weekday(c) + 1


def tz_localize(c: Column, zone: str) -> Column:
    """The instant at which clocks of the zone show the time."""
    return F.to_utc_timestamp(c, zone).cast("timestamp_ntz")


def tz_convert(c: Column, zone: str, source: str = "UTC") -> Column:
    """What clocks of the zone show at the instant."""
    return F.convert_timezone(F.lit(source), F.lit(zone), c)


_PERIODS = {"Y": "year", "A": "year", "Q": "quarter", "M": "month", "W": "week", "D": "day", "h": "hour", "min": "minute", "s": "second"}


def to_period(c: Column, freq: str = "M") -> Column:
    """Start of the period that holds the time; periods are kept by their start."""
    return F.date_trunc(_PERIODS[freq], c).cast("timestamp_ntz")


start_time = to_period


def end_time(c: Column, freq: str = "M") -> Column:
    return from_micros(micros(period_add(to_period(c, freq), 1, freq)) - 1)


def period_add(c: Column, n: int, freq: str) -> Column:
    months = {"Y": 12, "A": 12, "Q": 3, "M": 1}
    if freq in months:
        return c + F.make_ym_interval(F.lit(0), F.lit(n * months[freq]))
    days = {"W": 7, "D": 1}
    if freq in days:
        return c + F.make_dt_interval(days=F.lit(n * days[freq]))
    return from_micros(micros(c) + n * UNITS[freq])


def asfreq(c: Column, freq: str = "D", how: str = "E", of: str = "M") -> Column:
    """The first or last period of `freq` in the period of `of` that holds the time."""
    return to_period(end_time(c, of) if how == "E" else to_period(c, of), freq)


def to_timestamp(c: Column, how: str = "S", freq: str = "M") -> Column:
    return to_period(c, freq) if how == "S" else end_time(c, freq)


def duration_micros(a: Column, b: Column) -> Column:
    """Microseconds of a - b."""
    return micros(a) - micros(b)


def interval_micros(c: Column) -> Column:
    """Microseconds of a day-time interval."""
    return micros(F.lit("1970-01-01").cast("timestamp") + c)


def total_seconds(c: Column) -> Column:
    return interval_micros(c) / 1e6


def days(c: Column) -> Column:
    return F.floor(interval_micros(c) / UNITS["D"])


def seconds(c: Column) -> Column:
    return F.floor(F.pmod(interval_micros(c), F.lit(UNITS["D"])) / 1_000_000)


def microseconds(c: Column) -> Column:
    return F.pmod(interval_micros(c), F.lit(1_000_000))


nanoseconds = nanosecond


def components(c: Column) -> Column:
    """A struct of days, hours, minutes, seconds, milliseconds and microseconds."""
    rest = F.pmod(interval_micros(c), F.lit(UNITS["D"]))

    def part(unit: str, most: int) -> Column:
        return (F.floor(rest / UNITS[unit]) % most).cast("bigint")

    return F.struct(days(c).alias("days"), part("h", 24).alias("hours"), part("min", 60).alias("minutes"), part("s", 60).alias("seconds"), part("ms", 1000).alias("milliseconds"), part("us", 1000).alias("microseconds"))


def as_unit(c: Column, unit: str = "us") -> Column:
    """Cut to the unit; the kind of the column stays."""
    return floor(c, unit)


def second_of_day(c: Column) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
