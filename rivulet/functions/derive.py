"""Levels of a film's category, and bands of what is known of a reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Genres and the families that reports put them in; any other genre is in the family Other.
FAMILIES = {
    "Action": "Action&Adventure",
    "Adventure": "Action&Adventure",
    "War": "Action&Adventure",
    "Western": "Action&Adventure",
    "Sci-Fi": "SciFi&Fantasy",
    "Fantasy": "SciFi&Fantasy",
    "Animation": "SciFi&Fantasy",
    "Drama": "Drama&Romance",
    "Romance": "Drama&Romance",
    "Musical": "Drama&Romance",
    "Comedy": "Comedy",
    "Children": "Comedy",
    "Crime": "Crime&Thriller",
    "Thriller": "Crime&Thriller",
    "Mystery": "Crime&Thriller",
    "Film-Noir": "Crime&Thriller",
    "Horror": "Crime&Thriller",
    "Documentary": "Other",
}
# Lower and upper age of each band, both in it.
AGE_BANDS = ((0, 24, "18-24"), (25, 34, "25-34"), (35, 44, "35-44"), (45, 54, "45-54"), (55, 200, "55+"))
# The region of a ZIP code by its first digit.
ZIP_REGIONS = {
    "0": "Northeast",
    "1": "Northeast",
    "2": "Mid-Atlantic",
    "3": "Southeast",
    "4": "Midwest",
    "5": "Midwest",
    "6": "South-Central",
    "7": "South-Central",
    "8": "Mountain",
    "9": "West",
}


def _lookup(table: dict[str, str], value: Column, other: str) -> Column:
    listed = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(listed, value), F.lit(other))


def genre_list(genres: Column) -> Column:
    """The parts of a list written with commas, trimmed, without blanks; null: none."""
    parts = F.transform(F.split(F.coalesce(genres, F.lit("")), ","), lambda g: F.trim(g))
    return F.filter(parts, lambda g: F.length(g) > 0)


def primary_genre(genres: Column) -> Column:
    """The first of an array of genres; unknown without one."""
    return F.coalesce(F.get(genres, F.lit(0)), F.lit("unknown"))


def secondary_genre(genres: Column) -> Column:
    """The second; none without one."""
    return F.coalesce(F.get(genres, F.lit(1)), F.lit("none"))


def family(genre: Column) -> Column:
    return _lookup(FAMILIES, genre, "Other")


def decade(year: Column) -> Column:
    """1990s for 1994; unknown for what isn't a whole number."""
    number = F.trim(year.cast("string")).try_cast("int")
    return F.coalesce(F.concat(F.floor(number / 10).cast("int") * 10, F.lit("s")), F.lit("unknown"))


def levels(genres: Column, year: Column) -> dict[str, Column]:
    """l1: family of the first genre, l2: the first genre, l3: it and the decade."""
    first = primary_genre(genres)
    return {"l1": family(first), "l2": first, "l3": F.concat(first, F.lit("·"), decade(year))}


def age_band(age: Column) -> Column:
    """The band of an age in whole years; unknown for other text, or beyond the bands."""
    n = F.trim(age.cast("string")).try_cast("int")
    band = F.lit(None).cast("string")
    for low, high, label in reversed(AGE_BANDS):
        band = F.when(n.between(low, high), label).otherwise(band)
    return F.coalesce(band, F.lit("unknown"))


def zip_region(code: Column) -> Column:
    return _lookup(ZIP_REGIONS, F.substring(F.coalesce(code, F.lit("")), 1, 1), "unknown")
