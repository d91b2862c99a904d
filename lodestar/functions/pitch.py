"""Pitch windows: when a catalogue entry may be offered."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import ADMIN_ROLES, ADMIN_STATUSES, DEADLINE_LABELS, PUBLIC_STATUSES, VISIBLE_STATUSES


def day(value: str | dt.date) -> Column:
    return F.lit(value if isinstance(value, dt.date) else dt.date.fromisoformat(value))


def visible_for_role(role: str, status: str = "status") -> Column:
    allowed = ADMIN_STATUSES if role.upper() in ADMIN_ROLES else PUBLIC_STATUSES
    return F.col(status).isin(*allowed)


def searchable(status: str = "status") -> Column:
    """Search and pitching also show entries about to expire."""
    return F.col(status).isin(*VISIBLE_STATUSES)


def pitchable(today) -> Column:
    now = day(today)
    return (
        searchable()
        & (F.col("effective_from").isNull() | (F.col("effective_from") <= now))
        & (F.col("pitch_until").isNull() | (F.col("pitch_until") >= now))
        & (F.col("application_deadline").isNull() | (F.col("application_deadline") >= now))
    )


def closing_soon(today, days: int = 30) -> Column:
    now, end = day(today), F.date_add(day(today), days)
    return pitchable(today) & (
        F.col("pitch_until").between(now, end)
        | (F.col("pitch_until").isNull() & F.col("application_deadline").between(now, end))
    )


def pitch_state(today) -> Column:
    """Struct of code, days_remaining, end_date, end_label and pitchable."""
    now = day(today)
    end = F.least("pitch_until", "application_deadline")
    left = F.datediff(end, now)
    upcoming = F.col("effective_from") > now
    code = (
        F.when(upcoming, "UPCOMING")
        .when(end.isNull(), "ACTIVE")
        .when(left < 0, "CLOSED")
        .when(left <= 7, "URGENT")
        .when(left <= 30, "CLOSING")
        .otherwise("ACTIVE")
    )
    label = (
        F.when(upcoming, "Effective From")
        .when(end.isNull(), "No Deadline")
        .when(F.col("pitch_until") == end, "Pitch Until")
        .otherwise("Application Deadline")
    )
    shown = ~F.coalesce(upcoming, F.lit(False))
    return F.struct(
        code.alias("code"),
        F.when(shown, left).alias("days_remaining"),
        F.when(shown, end).alias("end_date"),
        label.alias("end_label"),
        (~code.isin("UPCOMING", "CLOSED")).alias("pitchable"),
    )


def deadline_label() -> Column:
    """Date, else the raw wording, else the status label, else "Not recorded"."""
    labels = F.create_map(*[F.lit(x) for pair in DEADLINE_LABELS.items() for x in pair])
    raw = F.trim("application_deadline_raw")
    status = F.coalesce(F.try_element_at(labels, F.col("deadline_status")), F.col("deadline_status"))
    return F.coalesce(
        F.date_format("application_deadline", "dd MMM yyyy"),
        F.when(raw != "", raw),
        F.when(~F.col("deadline_status").isin("", "UNKNOWN"), status),
        F.lit("Not recorded"),
    )
