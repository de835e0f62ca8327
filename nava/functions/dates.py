"""Dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_seconds(text: Column) -> Column:
    """Seconds of M:SS or H:MM:SS; minutes may exceed 59; null for anything else."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("long"))
    seconds = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 60 + p)
    return F.when(F.trim(text).rlike(r"^\d+(:\d+){1,2}$"), seconds)


def rfc822(text: Column) -> Column:
    """struct(at, offset) of a mail date; the weekday isn't read, and the offset's text is kept."""
    body = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.struct(F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss Z")).alias("at"), F.regexp_extract(body, r"([+-]\d{4})$", 1).alias("offset"))


def iso_with_offset(text: Column) -> Column:
    """The local time of a mail date as ISO text with its offset."""
    body = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    local = F.try_to_timestamp(F.regexp_replace(body, r"\s*[+-]\d{4}$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.regexp_extract(body, r"([+-]\d{4})$", 1), r"(\d{2})(\d{2})$", "$1:$2"))


def url_date(day: Column) -> Column:
    """M/D/YYYY without zeros in front."""
    return F.concat_ws("/", F.month(day).cast("string"), F.dayofmonth(day).cast("string"), F.year(day).cast("string"))


def run_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd-HHmmss")


def valid_range(first: Column, last: Column, today: Column) -> Column:
    """ISO dates, in order and not in the future."""
    a, b = F.try_to_date(first, "yyyy-MM-dd"), F.try_to_date(last, "yyyy-MM-dd")
    return F.coalesce((a <= b) & (b <= today), F.lit(False))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a header of whole seconds or a mail date, at least 0; null for anything else."""
    at = rfc822(F.regexp_replace(F.trim(header), "GMT$", "+0000"))["at"]
    wait = F.coalesce(F.trim(header).try_cast("double"), (F.unix_seconds(at) - F.unix_seconds(now)).cast("double"))
    return F.when(wait.isNotNull(), F.greatest(wait, F.lit(0.0)))
