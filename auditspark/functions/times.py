"""Time texts. Values without an offset mean UTC; anything unreadable is NULL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let, ref, strip, text_of

# Dates and complete ISO times, by far the most common shapes; the rest takes the slower path.
_COMPLETE = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|z|[+-]\d{2}:\d{2})?)?$"
_ANY = (r"^(\d{4})(-?)(\d{2})\2(\d{2})"
        r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(Z|z|[+-]\d{2}(?::?\d{2})?)?)?$")


def _rebuilt(text: Column) -> Column:
    """Any other ISO shape, written out in full."""
    def part(group: int, default: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, _ANY, group), F.lit("")), F.lit(default))

    zone = F.regexp_replace(F.regexp_replace(part(9, "Z"), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2"), ":$", ":00")
    full = F.concat(part(1, ""), F.lit("-"), part(3, ""), F.lit("-"), part(4, ""), F.lit("T"), part(5, "00"),
                    F.lit(":"), part(6, "00"), F.lit(":"), part(7, "00"), F.lit("."),
                    F.substring(part(8, "0"), 1, 6), zone)
    return F.when(text.rlike(_ANY), F.try_to_timestamp(full))


def parse_time(c: Column) -> Column:
    """ISO text -> TIMESTAMP; the session runs in UTC, so text without an offset means UTC."""
    text = strip(c)
    return F.when(text.rlike(_COMPLETE), F.try_to_timestamp(text)).when(
        text.rlike(r"^\d{4}-?\d{2}-?\d{2}"), let(text, _rebuilt))


def _slashed(text: Column) -> Column:
    return (F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
                   F.try_to_timestamp(text, F.lit("M/d/yyyy H:m:s")))
            .when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
                  F.try_to_timestamp(text, F.lit("yyyy/M/d H:m:s")))
            .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("M/d/yyyy"))))


def parse_sortable_time(c: Column) -> Column:
    """ISO text plus the three slashed shapes that sorting accepts."""
    return F.when(c.contains("/"), let(strip(c), _slashed)).otherwise(parse_time(c))


def time_of(df: DataFrame, name: str) -> Column:
    """A column as TIMESTAMP: typed columns as they are, text parsed."""
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return ref(name).cast("timestamp")
    return parse_time(text_of(df, name))


def literal_time(text: str) -> datetime | None:
    """The same reading for an argument given on the driver."""
    try:
        parsed = datetime.fromisoformat(str(text or "").strip())
    except ValueError:
        return None
    return parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)


def literal_micros(moment: datetime) -> int:
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86400 + delta.seconds) * 1000000 + delta.microseconds
