"""Timestamps as the logs hold them: Unix milliseconds or ISO-8601 text."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def iso_from_millis(ms: Column) -> Column:
    """ISO-8601 in UTC with milliseconds where there are any; null stays null."""
    t = F.timestamp_millis(ms)
    base = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(ms, F.lit(1000))
    return F.concat(base, F.when(part > 0, F.concat(F.lit("."), F.lpad((part * 1000).cast("string"), 6, "0"))).otherwise(F.lit("")), F.lit("+00:00"))


def parse_iso(text: Column) -> Column:
    """A timestamp, or null where the text is none."""
    return F.try_to_timestamp(text)


def delta_seconds(ts: Column, window: Window) -> Column:
    """Seconds since the row before in window; null first, or where either is missing; may be negative."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return (micros - F.lag(micros).over(window)) / F.lit(1_000_000.0)


def week_start(year_week: Column) -> Column:
    """Monday of a "YYYY-WW" week counted from the year's first Monday."""
    year = F.make_date(F.split(year_week, "-")[0].cast("int"), F.lit(1), F.lit(1))
    first = F.date_add(year, F.pmod(F.lit(7) - F.weekday(year), F.lit(7)).cast("int"))
    return F.date_add(first, (7 * (F.split(year_week, "-")[1].cast("int") - 1)).cast("int"))


def period(text: Column) -> Column:
    """What a form's date stands for, as struct of start, end (exclusive) and grain: the week "YYYY-Www", the month "YYYY-MM", or a year from a day.

    Weeks are those of week_start; a year is shown by month, the others by day. Other texts give null dates.
    """
    week = text.rlike(r"^\d{4}-W\d{2}$")
    month = text.rlike(r"^\d{4}-\d{2}$")
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    start = F.when(week, week_start(F.replace(text, F.lit("W"), F.lit("")))).when(month, F.concat(text, F.lit("-01")).try_cast("date")).when(day, text.try_cast("date"))
    end = F.when(week, F.date_add(start, 7)).when(month, F.add_months(start, 1)).when(day, F.add_months(start, 12))
    return F.struct(start.alias("start"), end.alias("end"), F.when(start.isNotNull(), F.when(day, "month").otherwise("day")).alias("grain"))
