"""Timestamp text to zone-less timestamps. Offsets are dropped, never applied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.schema import UNKNOWN_TIME, col

# Month abbreviations of BSD-style log lines.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Accepted shapes of structured timestamps.
ISO_T = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?Z?$"
ISO_SPACE = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
ISO_SPACE_FRACTION = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?$"
ISO_OFFSET = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:?\d{2}|Z)?$"
US_CLOCK = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{1,2}):(\d{1,2}) ([AaPp][Mm])$"
BSD_CLOCK = r"^(\w{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})$"
BSD_CLOCK_YEAR = r"^(\w{3}) +(\d{1,2}) +(\d{4}) +(\d{1,2}):(\d{1,2}):(\d{1,2})$"
OFFSET_TAIL = r"[+-]\d{2}:\d{2}$"


def _ntz(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i)


def _month_number(abbreviation: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.nullif(F.array_position(names, F.lower(abbreviation)), F.lit(0))


def iso_time(text: str | Column, shape: str) -> Column:
    """Timestamp of ``text`` if it has the given ISO-like shape, else NULL."""
    text = col(text)
    return F.when(text.rlike(shape), _ntz(F.regexp_replace(text, "Z$", "")))


def us_clock_time(text: str | Column) -> Column:
    """``MM/dd/yyyy hh:mm:ss AM`` to a timestamp, else NULL."""
    text = col(text)
    hour12 = _group(text, US_CLOCK, 4).try_cast("int")
    hour = hour12 % 12 + F.when(F.lower(_group(text, US_CLOCK, 7)) == "pm", 12).otherwise(0)
    iso = F.format_string(
        "%s-%s-%s %d:%s:%s",
        _group(text, US_CLOCK, 3), _group(text, US_CLOCK, 1), _group(text, US_CLOCK, 2),
        hour, _group(text, US_CLOCK, 5), _group(text, US_CLOCK, 6),
    )
    return F.when(text.rlike(US_CLOCK) & hour12.between(1, 12), _ntz(iso))


def event_time(text: str | Column) -> Column:
    """Timestamp of a structured event record, NULL when no known format fits."""
    return F.coalesce(iso_time(text, ISO_T), iso_time(text, ISO_SPACE), us_clock_time(text))


def bsd_time(text: str | Column, year: int) -> Column:
    """Year-less ``Jan  5 08:30:01`` in the given year, else NULL."""
    text = F.trim(col(text))
    iso = F.concat_ws(
        " ",
        F.concat_ws("-", F.lit(f"{year:04d}"), _month_number(_group(text, BSD_CLOCK, 1)), _group(text, BSD_CLOCK, 2)),
        F.concat_ws(":", *[_group(text, BSD_CLOCK, i) for i in (3, 4, 5)]),
    )
    known = text.rlike(BSD_CLOCK) & _month_number(_group(text, BSD_CLOCK, 1)).isNotNull()
    return F.when(known, _ntz(iso))


def _iso_without_offset(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), OFFSET_TAIL, ""), "Z$", "")
    return F.coalesce(iso_time(bare, ISO_T), iso_time(bare, ISO_SPACE))


def syslog_time(text: str | Column, year: int) -> Column:
    text = col(text)
    return F.coalesce(bsd_time(text, year), _iso_without_offset(text))


def cef_time(text: str | Column, year: int) -> Column:
    """Epoch milliseconds (UTC), BSD clock, ISO, or ``Jan 05 2024 08:30:01``; else NULL."""
    text = F.trim(col(text))
    millis = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    # Interval arithmetic on a zone-less base keeps the result independent of the session zone.
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(millis.cast("decimal(20,0)") / 1000).cast("decimal(18,6)")
    )
    dated = F.concat_ws(
        " ",
        F.concat_ws("-", _group(text, BSD_CLOCK_YEAR, 3), _month_number(_group(text, BSD_CLOCK_YEAR, 1)), _group(text, BSD_CLOCK_YEAR, 2)),
        F.concat_ws(":", *[_group(text, BSD_CLOCK_YEAR, i) for i in (4, 5, 6)]),
    )
    return F.coalesce(
        F.when(millis.isNotNull(), epoch),
        bsd_time(text, year),
        _iso_without_offset(text),
        F.when(text.rlike(BSD_CLOCK_YEAR), _ntz(dated)),
    )


def siem_time(text: str | Column) -> Column:
    """ISO time of a SIEM export; an offset is dropped, the clock reading kept."""
    text = F.trim(col(text))
    bare = F.regexp_replace(F.regexp_replace(text, r"[+-]\d{2}:?\d{2}$", ""), "Z$", "")
    return F.when(text.rlike(ISO_OFFSET), F.coalesce(iso_time(bare, ISO_T), iso_time(bare, ISO_SPACE_FRACTION)))


def or_unknown(ts: Column) -> Column:
    return F.coalesce(ts, F.lit(UNKNOWN_TIME).cast("timestamp_ntz"))
