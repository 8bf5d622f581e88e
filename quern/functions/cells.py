"""Catalog cells: categories, amounts, durations, servings, JSON lists."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import non_blank, split_on, strip

INGREDIENT = "array<struct<name:string,quantity:double,unit:string,preparation:string>>"


def _present(cell: Column) -> Column:
    """NULL for a missing cell, including the literal text ``nan``."""
    return F.when((cell != "") & (cell != "nan"), cell)


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def category_list(cell: Column) -> Column:
    parts = non_blank(split_on(_present(cell), ","))
    return F.coalesce(F.transform(parts, capitalize), F.array().cast("array<string>"))


def number_text(quantity: Column) -> Column:
    """Whole numbers print without a fraction."""
    whole = quantity.try_cast("bigint")
    return F.when(whole.cast("double") == quantity, whole.cast("string")).otherwise(quantity.cast("string"))


def amount_text(quantity: Column, unit: Column, preparation: Column) -> Column:
    """Quantity as text, unit and preparation, without what is empty."""
    parts = [F.nullif(part, F.lit("")) for part in (quantity, unit, preparation)]
    return F.trim(F.concat_ws(" ", *parts))


def iso_minutes(cell: Column) -> Column:
    """Minutes of ``PT[xH][yM]``; anything else, and seconds, count as zero."""
    value = strip(_present(cell))
    hours = F.regexp_extract(value, r"^PT([^HM]*)H", 1).try_cast("int")
    minutes = F.regexp_extract(value, r"^PT(?:[^H]*H)?([^HM]*)M", 1).try_cast("int")
    total = F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(minutes, F.lit(0))
    return F.when(F.startswith(value, F.lit("PT")), total).otherwise(F.lit(0))


def first_minutes(*cells: Column) -> Column:
    """The first duration above zero."""
    options = [F.when(iso_minutes(cell) > 0, iso_minutes(cell)) for cell in cells]
    return F.coalesce(*options, F.lit(0))


def servings(cell: Column) -> Column:
    number = strip(_present(cell)).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("int"), F.lit(0))


# Text up to the next bare NaN or Infinity, with whole strings taken as they are.
_NOT_FINITE = (
    r'(?s)\G((?:[^"NI\-]++|"(?:[^"\\]++|\\.)*+"|-(?!Infinity)|N(?!aN)|I(?!nfinity))*+)(?:NaN|-?Infinity)'
)


def parse_json(cell: Column) -> Column:
    """A JSON text as a variant, NULL if it is broken.

    As common readers do, it takes a repeated key (the last one wins, which the session is told here) and bare
    ``NaN`` and ``Infinity``, which read as null.
    """
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    repaired = F.when(cell.rlike("NaN|Infinity"), F.regexp_replace(cell, _NOT_FINITE, "$1null"))
    return F.coalesce(F.try_parse_json(cell), F.try_parse_json(repaired))


def json_strings(cell: Column) -> Column:
    """A JSON list of strings; broken or missing cells give an empty list."""
    return F.coalesce(F.from_json(_present(cell), "array<string>"), F.array().cast("array<string>"))


def json_items(cell: Column) -> Column:
    """A JSON list as variants; broken or missing cells give an empty list."""
    items = F.try_variant_get(parse_json(_present(cell)), "$", "array<variant>")
    return F.coalesce(items, F.from_json(F.lit("[]"), "array<variant>"))


def variant_kind(value: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``BIGINT`` and so on; NULL when there is no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def image_url(record_id: Column, template: str) -> Column:
    """``template`` with ``{id}`` filled in."""
    return F.replace(F.lit(template), F.lit("{id}"), record_id.cast("string"))
