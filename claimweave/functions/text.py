"""String helpers shared by the transforms and the checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace around a value.
WHITESPACE = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
DIGEST = r"^[0-9a-f]{64}$"
IDENTIFIER = r"^[A-Za-z0-9._-]{1,128}$"


def strip(value: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (plain ``trim`` only removes spaces)."""
    return F.btrim(value, F.lit(WHITESPACE))


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.length(strip(value)) == 0)


def iso_from_ntz(local: Column, offset: Column) -> Column:
    """ISO text of a wall-clock time: microseconds only when they are not zero.

    Null when either part is null.  Formatting goes through the session zone,
    which the sessions here set to UTC.
    """
    text = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.replace(text, F.lit(".000000"), F.lit("")), offset)


def own_offset(raw: Column) -> Column:
    """Offset at the end of a text as ``+hh:mm``, or null when there is none."""
    spelled = F.replace(raw, F.lit("Z"), F.lit("+00:00"))
    hours = F.regexp_extract(spelled, r"([+-]\d{2}):?\d{2}$", 1)
    return F.when(hours != "", F.concat(hours, F.lit(":"), F.right(spelled, F.lit(2))))


def without_offset(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(Z|[+-]\d{2}:?\d{2})$", "")


def wall_clock(raw: Column) -> Column:
    """The timestamp without its offset, or null when it is not a time."""
    return without_offset(raw).try_cast("timestamp_ntz")


def iso_datetime(raw: Column) -> tuple[Column, Column]:
    """``(iso text, error)``: the offset is mandatory and kept.

    The error is derived from the value, so that the parts of a good row are not
    parsed a second time.
    """
    value = iso_from_ntz(wall_clock(raw), own_offset(raw))
    reason = F.when(wall_clock(raw).isNull(), F.lit("must be an ISO 8601 datetime")).otherwise(
        F.lit("no_utc_offset")
    )
    return value, F.when(value.isNull(), reason)


def instant(iso: Column) -> Column:
    """Comparable timestamp of an ISO text that carries its offset."""
    return iso.try_cast("timestamp")


def offset_of_zone(local: Column, zone: str) -> Column:
    """Offset text of an IANA zone at a wall-clock time."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    shift = F.regexp_replace((local - utc).cast("string"), r"^.*'(-?)0 (\d{2}:\d{2}).*$", "$1$2")
    return F.replace(F.concat(F.lit("+"), shift), F.lit("+-"), F.lit("-"))
