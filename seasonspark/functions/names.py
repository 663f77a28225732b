"""Dates, slugs, file and URL names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters of a slug and what they become. Fixed values.
SLUG = ("+- /.", "pm_-p")


def scene_part(name: Column, group: int) -> Column:
    """Year (group 1) or day of year (2) of a granule name ``...A<yyyy><ddd>...``; null if there is none."""
    return F.nullif(F.regexp_extract(name, r"A(\d{4})(\d{3})", group), F.lit("")).cast("int")


def date_of(year: Column, doy: Column) -> Column:
    """The day; null for days that the year does not have."""
    day = F.make_date(year, F.lit(1), F.lit(1)) + (doy - 1).cast("int")
    return F.when((doy >= 1) & (F.year(day) == year), day)


def slug(text: Column) -> Column:
    return F.translate(text, *SLUG)


def coordinate_tag(lat: Column, lon: Column) -> Column:
    return slug(F.format_string("lat%.1f_lon%.1f", lat, lon))


def padded_doy(doy: Column) -> Column:
    return F.lpad(doy.cast("string"), 3, "0")


def url_file(url: Column) -> Column:
    """Last path part without query."""
    return F.regexp_extract(url, r"([^/?]+)(\?.*)?$", 1)
