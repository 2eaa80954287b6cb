"""Instants and their text."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?(Z|[+-]\d\d:?\d\d)")


def iso_text(ts: Column) -> Column:
    """UTC text: three fractional digits, six if there are microseconds; the session's time zone must be UTC."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1000))
    pattern = "yyyy-MM-dd'T'HH:mm:ss."
    return F.when(micros == 0, F.date_format(ts, pattern + "SSS'Z'")).otherwise(F.date_format(ts, pattern + "SSSSSS'Z'"))


def parse_iso(text: str) -> datetime | None:
    """The instant that an ISO 8601 text with an explicit offset names, in UTC; None for any other text."""
    m = _ISO.fullmatch(text)
    if not m:
        return None
    year, month, day, hour, minute = (int(m[i]) for i in range(1, 6))
    micros = int((m[7] or "").ljust(6, "0")[:6])
    zone = UTC
    if m[8] != "Z":
        h, mi = int(m[8][1:3]), int(m[8][-2:])
        if h > 23 or mi > 59:
            return None
        zone = timezone((1 if m[8][0] == "+" else -1) * timedelta(hours=h, minutes=mi))
    try:
        return datetime(year, month, day, hour, minute, int(m[6] or 0), micros, zone).astimezone(UTC)
    except (ValueError, OverflowError):
        return None


def iso_of(moment: datetime) -> str:
    """``iso_text`` of one instant."""
    moment = moment.astimezone(UTC)
    digits = "milliseconds" if moment.microsecond % 1000 == 0 else "microseconds"
    return moment.replace(tzinfo=None).isoformat(timespec=digits) + "Z"
