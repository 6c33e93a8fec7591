"""Calendar and crop-season expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_parts(date: Column) -> dict[str, Column]:
    """Monday is day 0; weeks are ISO weeks."""
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day": F.dayofmonth(date),
        "day_of_week": F.weekday(date),
        "week_of_year": F.weekofyear(date),
        "quarter": F.quarter(date),
        "day_of_year": F.dayofyear(date),
    }


def annual_harmonics(date: Column) -> dict[str, Column]:
    angle = F.dayofyear(date) * (2 * math.pi) / 365.25
    return {"annual_sin": F.sin(angle), "annual_cos": F.cos(angle)}


def weather_season(month: Column) -> Column:
    return (F.when(month.between(6, 11), "Kharif")
            .when(month.isin(12, 1, 2), "Rabi").otherwise("Summer"))


def market_season_year(date: Column) -> Column:
    """Struct(season, year) of a market date; January and February belong to the winter before."""
    m, y = F.month(date), F.year(date)
    season = (F.when(m.between(3, 7), "Summer").when(m.between(8, 10), "Autumn")
              .otherwise("Winter"))
    return F.struct(season.alias("season"), F.when(m <= 2, y - 1).otherwise(y).alias("year"))


# (crop, season) -> start year offset, start month, start day, end month, end day, expected days.
# Rice windows end at the in-season cutoff; wheat and potato have one window each. Fixed values.
SEASON_WINDOWS = {
    ("rice", "Autumn"): (0, 5, 1, 7, 31, 92),
    ("rice", "Winter"): (0, 6, 1, 9, 30, 122),
    ("rice", "Summer"): (-1, 11, 1, 2, 28, 120),
    ("wheat", None): (-1, 11, 15, 1, 31, 78),
    ("potato", None): (-1, 11, 1, 1, 31, 92),
}


def season_window(year: Column, season: Column, crop: str = "rice") -> Column:
    """Struct(start, cutoff, expected_days); NULL fields for an unknown season."""
    crop = crop.strip().lower()
    start = cutoff = days = None

    def chain(acc, cond, value):
        return F.when(cond, value) if acc is None else acc.when(cond, value)

    for (name, wanted), (shift, sm, sd, em, ed, n) in SEASON_WINDOWS.items():
        if name != crop:
            continue
        cond = F.lit(True) if wanted is None else season == wanted
        start = chain(start, cond, F.make_date(year + shift, F.lit(sm), F.lit(sd)))
        cutoff = chain(cutoff, cond, F.make_date(year, F.lit(em), F.lit(ed)))
        days = chain(days, cond, F.lit(n))
    if start is None:
        raise ValueError(f"unknown crop {crop!r}")
    return F.struct(start.alias("start"), cutoff.alias("cutoff"), days.alias("expected_days"))
