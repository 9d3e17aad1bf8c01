"""Calendar periods as column expressions: starts, bounds, labels, windows and guarded dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"weekly": "week", "monthly": "month", "quarterly": "quarter", "annual": "year"}
MONTHS = {"monthly": 1, "quarterly": 3, "annual": 12}


def unit(resolution: str) -> str:
    if resolution not in UNITS:
        raise ValueError(f"{resolution}: not one of {', '.join(UNITS)}")
    return UNITS[resolution]


def as_date(value: Column) -> Column:
    """A date, or null for what is none."""
    return value.try_cast("date")


def period_start(day: Column, resolution: str) -> Column:
    """The first day of day's period (weeks begin on Monday); null for a bad date."""
    return F.trunc(as_date(day), unit(resolution))


def period_end(start: Column, resolution: str) -> Column:
    """The last day of the period that begins at start."""
    if unit(resolution) == "week":
        return F.date_add(start, 6)
    return F.last_day(F.add_months(start, MONTHS[resolution] - 1))


def period_bounds(day: Column, resolution: str, cutoff: str = "1990-01-01") -> Column:
    """A struct of start and end; all days before cutoff fall into one period that begins in 1900."""
    at, edge = as_date(day), F.lit(cutoff).cast("date")
    start = period_start(at, resolution)
    early = F.struct(F.lit("1900-01-01").cast("date").alias("start"), F.date_sub(edge, 1).alias("end"))
    return F.when(at < edge, early).when(at.isNotNull(), F.struct(start.alias("start"), period_end(start, resolution).alias("end")))


def period_label(day: Column, resolution: str, cutoff: str | None = None) -> Column:
    """2020_Q1, 2020_M03, 2020_W09 (the year of the ISO week) or 2020; pre_1990 for days before a cutoff."""
    at, name = as_date(day), unit(resolution)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    made = {
        "year": F.year(at).cast("string"),
        "quarter": F.concat(F.year(at), F.lit("_Q"), F.quarter(at)),
        "month": F.concat(F.year(at), F.lit("_M"), two(F.month(at))),
        "week": F.concat(F.extract(F.lit("YEAROFWEEK"), at), F.lit("_W"), two(F.weekofyear(at))),
    }[name]
    return made if cutoff is None else F.when(at < F.lit(cutoff).cast("date"), F.lit(f"pre_{cutoff[:4]}")).otherwise(made)


def windows(ranges: DataFrame, resolution: str, low: str = "low", high: str = "high") -> DataFrame:
    """ranges with window_start and window_end: the periods that cover low..high, clipped to it."""
    name = unit(resolution)
    step = F.expr(f"INTERVAL 1 {'MONTH' if name == 'month' else 'WEEK' if name == 'week' else 'YEAR' if name == 'year' else 'QUARTER'}") if name != "quarter" else F.expr("INTERVAL 3 MONTH")
    starts = F.explode(F.sequence(F.trunc(F.col(low), name), F.col(high), step))
    out = ranges.withColumn("__start", starts)
    return out.select(*ranges.columns, F.greatest("__start", low).alias("window_start"), F.least(period_end(F.col("__start"), resolution), F.col(high)).alias("window_end"))


def compact_date(text: Column) -> Column:
    """A date of eight digits; null for other lengths and for days that don't exist."""
    return F.when(F.length(text) == 8, F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd"))))


def valid_date(day: Column, low: int = 1800, high: int = 2030) -> Column:
    """day as a date if its year lies in low..high."""
    at = as_date(day)
    return F.when(F.year(at).between(low, high), at)


def epoch_seconds(at: Column) -> Column:
    return F.unix_timestamp(at)
