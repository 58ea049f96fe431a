"""Instants: parsing, schedules and keys. Every rule takes the moment it is asked about."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Hours between aligned runs; a manual source has none.
SCHEDULE_HOURS = {"Hourly": 1, "Every 4 hours": 4, "Twice daily": 12, "Daily": 24}


def iso_date(text: Column) -> Column:
    """An ISO or RFC 2822 date as an instant; anything else is null."""
    mail = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3}, *", ""), r" (?:GMT|UTC|Z)$", " +0000")
    parsed = F.coalesce(
        text.try_cast("timestamp"),
        F.when(
            mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"),
            F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")),
        ),
    )
    return F.when(text != "", parsed)


def next_slot(schedule: Column, after: Column) -> Column:
    """The next aligned UTC instant strictly after ``after``; null for a manual source."""
    span = F.lit(None).cast("bigint")
    for name, hours in SCHEDULE_HOURS.items():
        span = F.when(schedule == name, F.lit(hours * 3600).cast("bigint")).otherwise(span)
    seconds = F.unix_seconds(after.cast("timestamp"))
    return F.timestamp_seconds(F.floor(seconds / span) * span + span)


def alert_key(job_id: Column, score: Column, evaluated_at: Column) -> Column:
    millis = F.unix_millis(evaluated_at.cast("timestamp"))
    return F.concat(F.lit("match:"), job_id.cast("string"), F.lit(":"), score.cast("string"), F.lit(":"), millis.cast("string"))


def digest_key(at: Column) -> Column:
    return F.concat(F.lit("digest:"), F.date_format(at, "yyyy-MM-dd"), F.lit(":"), F.hour(at).cast("string"))
