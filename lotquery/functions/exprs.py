"""Column helpers F1-F14.  All are built-in Spark expressions (whole-stage codegen)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's plate pattern and its text blacklist.
PLATE_PATTERN = r"^[0-9]{2}[A-Z]-[0-9]{3}\.[0-9]{2}$"
UNSAFE_SUBSTRINGS = ("'", '"', ";", "--")
# Java String.trim() removes every char <= U+0020 at both ends, not only spaces.
_JAVA_TRIM_CHARS = "".join(chr(i) for i in range(0x21))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(value: str | dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (no session-zone dependence)."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(value).cast("timestamp_ntz")


def java_trim(c: str | Column) -> Column:
    """Java ``String.trim``: strip every char <= U+0020 from both ends (a plain
    character-set trim, no regex)."""
    return F.trim(col(c), F.lit(_JAVA_TRIM_CHARS))


def on_day(ts: str | Column, day: str | dt.date) -> Column:
    """timestamp falls on date ``day``, as a half-open range so Parquet
    min/max statistics prune row groups (no function wraps the column)."""
    start = F.lit(str(day)).cast("date").cast("timestamp_ntz")
    return (col(ts) >= start) & (col(ts) < start + F.expr("INTERVAL 1 DAY"))


def time_text(ts: str | Column) -> Column:
    """canonical ``yyyy-MM-dd HH:mm:ss`` text."""
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def count_when(cond: Column) -> Column:
    """conditional count, 0 (not null) over no rows."""
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def sum_or_zero(c: str | Column) -> Column:
    """``COALESCE(SUM(x), 0)``."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def floor_zero(c: Column) -> Column:
    """``max(0, x)``."""
    return F.greatest(c, F.lit(0))


def net_amount(amount: str | Column, discount: str | Column) -> Column:
    """final amount = amount - discount, exact decimal."""
    return (col(amount) - col(discount)).cast("decimal(18,2)")


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """F8: whole minutes from start to end, floored (also for negative spans)."""
    return F.floor(F.timestamp_diff("SECOND", col(start), col(end)) / 60).cast("bigint")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("SECOND", col(start), col(end))


def micros_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch (the session zone is UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def day_type(ts: str | Column, holiday_flag: Column) -> Column:
    """Holiday wins over Weekend; ``weekday`` is 0 = Monday."""
    return (F.when(holiday_flag, F.lit("Holiday"))
            .when(F.weekday(col(ts)) >= 5, F.lit("Weekend"))
            .otherwise(F.lit("Weekday")))


def plate_key(c: str | Column) -> Column:
    """upper-case and keep only ``[0-9A-Z]``."""
    return F.regexp_replace(F.upper(col(c)), "[^0-9A-Z]", "")


def safe_int(c: str | Column, default: int | None = None) -> Column:
    """Java ``Integer.parseInt`` semantics: optional sign and digits only
    (no surrounding spaces), overflow -> fallback."""
    text = col(c)
    parsed = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return F.coalesce(parsed, F.lit(default).cast("int")) if default is not None else parsed


def percent(part: Column, whole: Column) -> Column:
    """``Math.round(part / whole * 100)`` (half-up), 0 when whole is 0."""
    rounded = F.floor((200 * part + whole) / (2 * whole))
    return F.when(whole > 0, rounded).otherwise(F.lit(0)).cast("int")


def age_text(ts: str | Column, as_of: Column) -> Column:
    """``~Nh ago``."""
    return F.concat(F.lit("~"), F.timestamp_diff("HOUR", col(ts), as_of).cast("string"), F.lit("h ago"))


def valid_plate(c: str | Column) -> Column:
    """P2 rule: not null / blank, and after trim + upper-case matches the plate pattern."""
    cleaned = F.upper(java_trim(c))
    return F.coalesce((cleaned != "") & cleaned.rlike(PLATE_PATTERN), F.lit(False))


def unsafe_text_reason(c: str | Column, max_len: int) -> Column:
    """P3 rule; null when the text is acceptable."""
    trimmed = java_trim(c)
    unsafe = None
    for token in UNSAFE_SUBSTRINGS:
        cond = trimmed.contains(token)
        unsafe = cond if unsafe is None else (unsafe | cond)
    return (F.when(col(c).isNull(), F.lit("null"))
            .when(trimmed == "", F.lit("blank"))
            .when(F.length(trimmed) > max_len, F.lit("too_long"))
            .when(unsafe, F.lit("unsafe_char")))
