"""Calendar parts, durations and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(ts: Column | str = "ts") -> Column:
    return F.to_date(ts)


def year_month(ts: Column | str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM")


def hour(ts: Column | str = "ts") -> Column:
    return F.hour(ts)


def weekday(ts: Column | str = "ts") -> Column:
    """0 = Sunday."""
    return F.dayofweek(ts) - 1


def week_label(ts: Column | str = "ts") -> Column:
    """Year and Monday-based week number; days before the first Monday are week 00."""
    monday_offset = (F.dayofweek(ts) + 5) % 7
    week = F.floor((F.dayofyear(ts) - 1 + 7 - monday_offset) / 7)
    return F.concat_ws("-", F.date_format(ts, "yyyy"), F.lpad(week.cast("string"), 2, "0"))


def micros(ts: Column | str = "ts") -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def effective_ms(duration: Column | str = "duration_ms", played: Column | str = "ms_played") -> Column:
    return F.coalesce(duration, played, F.lit(0).cast("bigint"))


def ms_to_hours(ms: Column | str) -> Column:
    return F.round(F.coalesce(ms, F.lit(0).cast("bigint")) / F.lit(3600000), 1)


def format_duration(ms: Column | str) -> Column:
    """Two largest units: `3d 4h`, `5h 6m`, `7m 8s` or `9s`."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    seconds = F.floor(ms / 1000)
    minutes = F.floor(seconds / 60)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(days > 0, F.format_string("%dd %dh", days, hours % 24))
        .when(hours > 0, F.format_string("%dh %dm", hours, minutes % 60))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, seconds % 60))
        .otherwise(F.format_string("%ds", seconds))
    )


def daypart(hour_of_day: Column | str) -> Column:
    h = F.col(hour_of_day) if isinstance(hour_of_day, str) else hour_of_day
    return (
        F.when(h.between(6, 11), "morning")
        .when(h.between(12, 17), "afternoon")
        .when(h.between(18, 21), "evening")
        .otherwise("night")
    )


def listener_label(hour_of_day: Column | str) -> Column:
    h = F.col(hour_of_day) if isinstance(hour_of_day, str) else hour_of_day
    return (
        F.when(h.between(5, 11), "Morning Person")
        .when(h.between(12, 16), "Afternoon Listener")
        .when(h.between(17, 20), "Evening Vibes")
        .otherwise("Night Owl")
    )
