"""Record encodings: ISO-8601 times, store keys, JSON records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# date, time, optional fraction, and a mandatory zone
RFC3339 = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?"
           r"(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$")


# a whole date and a time, seconds and zone optional; nothing that Spark would fill up from today
ISO_TIME = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?"
            r"(Z|[+-][0-9]{2}(:?[0-9]{2})?)?$")


def parse_iso(text: Column) -> Column:
    """ISO-8601 date and time to timestamp; null when malformed or not complete."""
    return F.when(text.rlike(ISO_TIME), F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("."))))


def event_time(text: Column, record_time: Column) -> Column:
    """Event time from its text, else the record's time, else now."""
    return F.coalesce(parse_iso(text), record_time, F.current_timestamp())


def is_rfc3339(text: Column) -> Column:
    """Strict RFC 3339: the form, and a date and time that exist (Spark knows no zones past 18 h)."""
    plain = F.regexp_replace(F.substring(text, 1, 19), "T", " ")
    return text.rlike(RFC3339) & F.try_to_timestamp(plain).isNotNull()


def format_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def store_key(prefix: str, ticker: Column, window_end: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), ticker, F.lit(":"),
                    F.unix_seconds(window_end).cast("string"))


def latest_key(prefix: str, ticker: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), ticker, F.lit(":latest"))


def last_sent_key(ticker: Column) -> Column:
    return F.concat(F.lit("alert:last_sent:"), ticker)


def to_record(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))


def from_record(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})
