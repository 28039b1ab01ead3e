"""Column functions for quantitative values in triples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triplewright.functions.text import strip

# Relations whose object is a value whatever it looks like; units of a value.
VALUE_RELATIONS = ("has_clinical_threshold", "has_dose_adjustment")
UNITS = "mg/dL|mg|ml|units?|u|%"


def relation_key(r: Column | str) -> Column:
    """Lower snake case."""
    return strip(F.replace(F.lower(r), F.lit(" "), F.lit("_")))


def is_value(relation: Column | str, obj: Column | str) -> Column:
    """The relation says so, or the object starts with a comparator, or holds a number with a unit."""
    o = strip(obj)
    return relation_key(relation).isin(*VALUE_RELATIONS) | o.rlike("^[<>=]") | o.rlike(r"(?i)\d+\s*(?:mg/dL|%|units?|u|mg|ml)")


def _plain(number: Column) -> Column:
    return F.regexp_replace(number, r"\.0$", "")


def clean_value(raw: Column | str) -> Column:
    """Comparator and number, else a signed percentage, else a dose with a short unit, else the text if short."""
    x = strip(raw)
    compared = rf"(?i)([<>]=?|=)\s*(\d+(?:\.\d+)?)\s*(?:{UNITS})?"
    adjusted = r"(?i)(increase|decrease|reduce|raise|up|down)\s+(?:dose\s+)?(?:by\s+)?(\d+(?:\.\d+)?)\s*%"
    dosed = r"(?i)^(\d+(?:\.\d+)?)\s*(units?|u|mg|ml)$"
    part = lambda pattern, n: F.regexp_extract(x, pattern, n)
    sign = F.when(F.lower(part(adjusted, 1)).isin("increase", "raise", "up"), "+").otherwise("-")
    unit = F.when(F.lower(part(dosed, 2)).rlike("^u"), "u").otherwise(F.lower(part(dosed, 2)))
    return (
        F.when(F.length(raw) == 0, None)
        .when(x.rlike(compared), F.concat(part(compared, 1), _plain(part(compared, 2))))
        .when(x.rlike(adjusted), F.concat(sign, _plain(part(adjusted, 2)), F.lit("%")))
        .when(x.rlike(dosed), F.concat(_plain(part(dosed, 1)), unit))
        .when(F.length(x) < 25, x)
    )
