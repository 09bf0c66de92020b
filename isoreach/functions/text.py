"""Text and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their plain forms.
ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def slug(name: Column) -> Column:
    """Lower-case ASCII words joined by underscores."""
    plain = F.lower(F.translate(name, ACCENTS, PLAIN))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def seconds_of(hms: Column) -> Column:
    """Seconds of H:M:S, where hours may pass 24."""
    p = F.split(hms, ":")
    return p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")


def hms_of(seconds: Column) -> Column:
    """HH:MM:SS; negative times are 0."""
    s = F.greatest(seconds.cast("int"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60)


def decimal_comma(text: Column) -> Column:
    """A number written with dots between thousands and a decimal comma."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\.", ""), ",", ".").try_cast("double")


def first_text(*columns: Column) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def multi_match(value: Column, wanted: list[str] | bool) -> Column:
    """Whether one of the parts between semicolons is wanted; True takes any value. Null never matches."""
    if wanted is True:
        return value.isNotNull()
    parts = F.transform(F.split(value, ";"), lambda p: F.trim(p))
    return F.coalesce(F.arrays_overlap(parts, F.array(*map(F.lit, wanted))), F.lit(False))


def digest(*columns: Column) -> Column:
    """SHA-1 of the columns' texts joined by semicolons."""
    return F.sha1(F.concat_ws(";", *(c.cast("string") for c in columns)))


def class_level(score: Column, bounds: list[float]) -> Column:
    """1 and one more for each bound that the score reaches."""
    return F.lit(1) + sum((F.when(score >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def shade(t: Column, colour: tuple[int, int, int]) -> Column:
    """#RRGGBB between white (0) and a colour (1)."""
    return F.format_string("#%02X%02X%02X", *(F.bround(255 - t * (255 - c), 0).cast("int") for c in colour))
