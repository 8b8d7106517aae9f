"""Civil-time arithmetic and sentences, as Column expressions.

Instants are TIMESTAMP_NTZ in UTC, so nothing here depends on the session's zone; the calendar is that of an explicit ``tz``.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

_DURATION = r"^([0-9]+)\s*(d|day|days|m|mo|month|months|y|year|years)\z"


def instant(value: str | dt.datetime) -> Column:
    """A literal instant, from a datetime or an ISO-8601 string in UTC."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is not None:
        value = value.astimezone(dt.UTC).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def parse_instant(iso: Column) -> Column:
    """ISO-8601 text with Z or an offset, or a bare date → UTC instant; null where unreadable."""
    shape = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:T([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)(Z|[+-][0-9]{2}:[0-9]{2})?)?\z"
    text = trim(iso)
    civil = F.concat_ws(" ", F.regexp_extract(text, shape, 1), F.when(F.regexp_extract(text, shape, 2) != "", F.regexp_extract(text, shape, 2)))
    offset = F.regexp_extract(text, shape, 3)
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    minutes = F.when(offset.rlike(r"^[+-]"), sign * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int"))).otherwise(0)
    return F.when(text.rlike(shape), civil.try_cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0).cast("decimal(18,6)")))


def instant_reject(iso: Column) -> Column:
    """Why ``parse_instant`` gives null for a text; null where it doesn't, and for a null."""
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:[0-9]{2})?)?\z"
    text = trim(iso)
    wrong = F.when(text == "", "empty").when(~text.rlike(shape), "not an ISO-8601 instant").when(parse_instant(iso).isNull(), "no such date or time")
    return F.when(iso.isNotNull(), wrong)


def to_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_time(ts: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def add_months(ts: Column, months: Column | int, tz: str = "UTC") -> Column:
    """Calendar months on the local civil time, the day clamped, the wall clock kept across clock changes."""
    months = F.lit(months) if isinstance(months, int) else months
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), local_time(ts, tz) + F.make_ym_interval(F.lit(0), months))


def add_days(ts: Column, days: Column | int) -> Column:
    """Elapsed days of 24 hours."""
    days = F.lit(days) if isinstance(days, int) else days
    return ts + F.make_dt_interval(days)


def parse_duration(text: Column) -> Column:
    """struct(months, days, forever); null for what can't be read or isn't positive."""
    value = F.lower(trim(text))
    amount = F.regexp_extract(value, _DURATION, 1).try_cast("int")
    unit = F.substring(F.regexp_extract(value, _DURATION, 2), 1, 1)
    years = F.when(amount <= (2**31 - 1) // 12, amount * 12)
    parsed = F.struct(F.when(unit == "m", amount).when(unit == "y", years).alias("months"), F.when(unit == "d", amount).alias("days"), F.lit(False).alias("forever"))
    endless = F.struct(F.lit(None).cast("int").alias("months"), F.lit(None).cast("int").alias("days"), F.lit(True).alias("forever"))
    return F.when(value.isin("forever", "never"), endless).when(value.rlike(_DURATION) & (amount > 0) & ((unit != "y") | years.isNotNull()), parsed)


def duration_reject(text: Column) -> Column:
    """Why ``parse_duration`` gives null for a text; null where it doesn't, and for a null."""
    value = F.lower(trim(text))
    amount = F.regexp_extract(value, _DURATION, 1)
    wrong = F.when(value == "", "empty").when(~value.rlike(_DURATION), "not a duration (use 3m, 45d, 1y or forever)").when(amount.rlike(r"^0+\z"), "not positive").when(parse_duration(text).isNull(), "too long")
    return F.when(~value.isin("forever", "never"), wrong)


def read_duration(text: str) -> tuple[int | None, int | None, bool]:
    """The same for one argument on the driver; raises where it can't be read."""
    value = text.strip().lower()
    if value in ("forever", "never"):
        return None, None, True
    m = re.match(_DURATION.replace(r"\z", "$"), value)
    if not m or int(m[1]) <= 0:
        raise ValueError(f"not a positive duration: {text!r} (use 3m, 45d, 1y or forever)")
    n = int(m[1])
    return (None, n, False) if m[2][0] == "d" else (n * (12 if m[2][0] == "y" else 1), None, False)


def apply_duration(ts: Column, duration: Column, tz: str = "UTC") -> Column:
    return F.when(duration["months"].isNotNull(), add_months(ts, duration["months"], tz)).when(duration["days"].isNotNull(), add_days(ts, duration["days"]))


def parse_since(text: str, as_of: dt.datetime) -> dt.datetime:
    """Nd, Nm or Ny back from ``as_of``, or an ISO date; for arguments, on the driver."""
    m = re.fullmatch(r"(\d+)([dmy])", text.strip().lower())
    if not m:
        return dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    n = int(m[1])
    if m[2] == "d":
        return as_of - dt.timedelta(days=n)
    month = as_of.year * 12 + as_of.month - 1 - n * (12 if m[2] == "y" else 1)
    first = as_of.replace(year=month // 12, month=month % 12 + 1, day=1)
    last = (first + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)
    return first.replace(day=min(as_of.day, last.day))


def days_until(start: Column, end: Column, tz: str = "UTC") -> Column:
    """Difference of local calendar dates."""
    return F.datediff(local_time(end, tz).cast("date"), local_time(start, tz).cast("date"))


def hold_length(start: Column, end: Column, tz: str = "UTC") -> Column:
    days = days_until(start, end, tz)
    months = F.floor(days / F.lit(30.44) + 0.5).cast("int")
    return F.when((months >= 12) & (months % 12 == 0), F.concat((months / 12).cast("int"), F.lit("-year"))).when(months >= 1, F.concat(months, F.lit("-month"))).otherwise(F.concat(days, F.lit("-day")))


def format_date(ts: Column, tz: str = "UTC") -> Column:
    """Oct 3, 2026"""
    return F.date_format(local_time(ts, tz), "MMM d, yyyy")


def counted(n: Column, noun: str) -> Column:
    return F.concat(n, F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))
