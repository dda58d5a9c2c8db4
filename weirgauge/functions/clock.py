"""Epoch numbers and RFC 3339 text, independent of the session time zone."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY_MS = 86_400_000

# The last second of a minute may be 60, a leap second.
RFC3339 = (
    r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt ]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?"
    r"([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)"
)


def micros_of_ntz(stamp: Column) -> Column:
    """Epoch microseconds of a zone-less timestamp read as UTC."""
    origin = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("MICROSECOND", origin, stamp)


def timestamp_of_ms(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def timestamp_of_us(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def date_of_ms(millis: Column) -> Column:
    """UTC calendar date of epoch milliseconds."""
    days = F.call_function("div", millis, F.lit(DAY_MS)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def _clock_text(seconds: Column) -> Column:
    def two(part: Column) -> Column:
        return F.lpad(part.cast("string"), 2, "0")

    within = seconds % 86400
    return F.concat(
        date_of_ms(seconds * 1000).cast("string"), F.lit("T"),
        two(F.call_function("div", within, F.lit(3600))), F.lit(":"),
        two(F.call_function("div", within, F.lit(60)) % 60), F.lit(":"),
        two(within % 60),
    )


def whole_second_text(millis: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ``, sub-second part dropped."""
    return F.concat(_clock_text(F.call_function("div", millis, F.lit(1000))), F.lit("Z"))


def rfc3339_text(micros: Column, offset: str = "+00:00") -> Column:
    """RFC 3339 text with 0, 3 or 6 fraction digits, whichever is exact."""
    rest = micros % MICROS
    fraction = (
        F.when(rest == 0, F.lit(""))
        .when(rest % 1000 == 0, F.concat(F.lit("."), F.lpad(F.call_function("div", rest, F.lit(1000)).cast("string"), 3, "0")))
        .otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0")))
    )
    return F.concat(_clock_text(F.call_function("div", micros, F.lit(MICROS))), fraction, F.lit(offset))


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of RFC 3339 text; NULL when it does not parse. Second 60 is the
    first of the next minute."""
    leap = F.substring(text, 18, 2) == "60"
    shown = F.upper(F.when(leap, F.overlay(text, F.lit("59"), 18)).otherwise(text)).try_cast("timestamp")
    moment = F.when(leap, shown + F.expr("interval 1 second")).otherwise(shown)
    return F.when(text.rlike(rf"^{RFC3339}\z"), moment)


def rfc3339_argument_ms(text: str | None) -> int | None:
    """Epoch milliseconds of a request argument; ``None`` when absent or malformed."""
    if text is None or not re.fullmatch(RFC3339, text, re.ASCII):
        return None
    leap = text[17:19] == "60"
    text = text[:17] + "59" + text[19:] if leap else text
    body, fraction = text.replace("t", "T").replace(" ", "T"), ""
    found = re.match(r"^(.{19})\.(\d+)(.*)$", body)
    if found:
        body, fraction = found.group(1) + found.group(3), found.group(2)
    try:
        moment = dt.datetime.fromisoformat(body.upper().replace("Z", "+00:00"))
    except ValueError:
        return None
    whole = (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(seconds=1)
    return (whole + leap) * 1000 + int((fraction + "000")[:3])
