"""Parsing of free-text quantity lines, e.g. ``1 1/2 cups fresh basil, chopped``.

The parser is a list of stages.  A stage takes an accessor for the fields known so far and returns new
fields, so the same stages run on table columns and inside ``transform`` over an array of lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions.text import extract_all, no_strings, replace_all, split_on, squeeze, strip

Fields = Callable[[str], Column]

NUMBER = r"(\d+(?:\.\d+)?)"
MIXED = r"^(\d+)\s+(\d+)\s*/\s*(\d+)\s*"
FRACTION = r"^(\d+)\s*/\s*(\d+)\s*"
RANGE = rf"^{NUMBER}\s*(?:-|to)\s*{NUMBER}\s*"
PLAIN = rf"^{NUMBER}\s*"


def one_of(listed: list[str]) -> str:
    """A pattern for a list of words with shared beginnings factored out, so that most letters fail at once."""
    endings: dict[str, list[str]] = {}
    for word in dict.fromkeys(listed):
        endings.setdefault(word[:1], []).append(word[1:])
    branches = [
        re.escape(first) + (one_of(rest) if len(rest) > 1 else re.escape(rest[0]))
        for first, rest in endings.items() if first
    ]
    return f"(?:{'|'.join(branches)})" + ("?" if "" in endings else "")


KEYWORD = rf"(?U)\b{one_of(fixed.PREPARATION_KEYWORDS)}\b"

OUTPUT = ("original", "quantity", "unit", "name", "preparation", "is_valid")


def unit_table(include_canonical: bool = False) -> dict[str, str]:
    """Spelling to canonical unit."""
    table = dict(fixed.UNIT_SPELLINGS)
    if include_canonical:
        table.update({word: word.replace(" ", "_") for word in fixed.CANONICAL_SINGULARS})
    return table


def _map_literal(table: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in table.items() for part in pair])


def _group(text: Column, pattern: str, group: int) -> Column:
    """A capture group as a number; NULL where the pattern does not match."""
    return F.regexp_extract(text, pattern, group).try_cast("double")


def _joined(first: Column, second: Column) -> Column:
    """``first, second`` where both have content."""
    return F.array_join(F.filter(F.array(first, second), lambda part: part != ""), ", ")


def trim_line(get: Fields) -> dict[str, Column]:
    return {"original": strip(F.coalesce(get("line"), F.lit("")))}


def find_number(get: Fields) -> dict[str, Column]:
    line = get("original")
    numeric = line.rlike(r"^\d")
    matched = F.when(~numeric, F.lit(""))
    for pattern in (MIXED, FRACTION, RANGE, PLAIN):
        matched = matched.when(line.rlike(pattern), F.regexp_extract(line, pattern, 0))
    shape = F.when(~numeric, F.lit("none"))
    for name, pattern in (("mixed", MIXED), ("fraction", FRACTION), ("range", RANGE), ("plain", PLAIN)):
        shape = shape.when(line.rlike(pattern), F.lit(name))
    return {
        "shape": shape,
        "number": matched,
        "glyph": F.element_at(_map_literal(fixed.UNICODE_FRACTIONS), F.substring(line, 1, 1)),
    }


def read_quantity(get: Fields) -> dict[str, Column]:
    line, shape, number = get("original"), get("shape"), get("number")
    first = lambda pattern: _group(number, pattern, 1)
    quantity = (
        F.when(get("glyph").isNotNull(), get("glyph"))
        .when(shape == "mixed", first(MIXED) + F.try_divide(_group(number, MIXED, 2), _group(number, MIXED, 3)))
        .when(shape == "fraction", F.try_divide(first(FRACTION), _group(number, FRACTION, 2)))
        .when(shape == "range", (first(RANGE) + _group(number, RANGE, 2)) / 2)
        .when(shape == "plain", first(PLAIN))
    )
    taken = F.when(get("glyph").isNotNull(), F.lit(1)).otherwise(F.length(number))
    return {"quantity": quantity, "rest": strip(F.substr(line, taken + 1))}


def split_rest(get: Fields) -> dict[str, Column]:
    return {"tokens": F.when(get("quantity").isNotNull(), split_on(get("rest"), f"[{fixed.BLANKS}]+"))}


def find_unit(get: Fields, units: dict[str, str]) -> dict[str, Column]:
    tokens, table = get("tokens"), _map_literal(units)
    first, second = F.lower(F.get(tokens, 0)), F.lower(F.get(tokens, 1))
    return {
        "unit_one": F.coalesce(F.element_at(table, first), F.element_at(table, replace_all(first, "s+$"))),
        "unit_two": F.element_at(table, F.concat(first, F.lit(" "), second)),
    }


def take_unit(get: Fields) -> dict[str, Column]:
    tokens = get("tokens")
    after = lambda n: F.array_join(F.slice(tokens, F.lit(n + 1), F.size(tokens)), " ")
    rest = (
        F.when(get("quantity").isNull(), get("original"))
        .when(get("unit_one").isNotNull(), after(1))
        .when(get("unit_two").isNotNull(), after(2))
        .otherwise(get("rest"))
    )
    return {"unit": F.coalesce(get("unit_one"), get("unit_two"), F.lit("")), "body": rest}


def split_preparation(get: Fields) -> dict[str, Column]:
    """What follows the first comma, then the first bracket of what precedes it."""
    body = get("body")
    has_comma = F.contains(body, F.lit(","))
    left = F.when(has_comma, strip(F.substring_index(body, ",", 1))).otherwise(body)
    right = F.when(has_comma, strip(F.substr(body, F.instr(body, ",") + 1))).otherwise(F.lit(""))
    return {"left": left, "aside": right, "bracket": F.regexp_extract(left, r"\(([^)]+)\)", 0)}


def move_bracket(get: Fields) -> dict[str, Column]:
    left, bracket = get("left"), get("bracket")
    at = F.position(bracket, left)
    before = strip(F.substr(left, F.lit(1), at - 1))
    after = strip(F.substr(left, at + F.length(bracket)))
    together = F.array_join(F.filter(F.array(before, after), lambda part: part != ""), " ")
    inside = F.substr(bracket, F.lit(2), F.length(bracket) - 2)
    return {
        "label": F.when(bracket == "", left).otherwise(together),
        "notes": F.when(bracket == "", get("aside")).otherwise(_joined(get("aside"), inside)),
    }


def drop_articles(get: Fields) -> dict[str, Column]:
    bare = replace_all(get("label"), r"(?iU)^of\s+")
    bare = replace_all(bare, r"(?iU)^(a|an|the)\s+")
    to_taste = F.contains(F.lower(bare), F.lit("to taste"))
    return {
        "plain": F.lower(F.when(to_taste, replace_all(bare, r"(?iU),?\s*to taste\s*$")).otherwise(bare)),
        "taste": F.when(to_taste, F.lit("to taste")).otherwise(F.lit("")),
    }


def find_keywords(get: Fields) -> dict[str, Column]:
    return {"present": extract_all(get("plain"), KEYWORD)}


def move_keywords(get: Fields) -> dict[str, Column]:
    """Keywords move to the preparation in the order of the list, not of the line."""
    plain, present = get("plain"), get("present")
    listed = F.filter(
        F.array(*[F.lit(word) for word in fixed.PREPARATION_KEYWORDS]),
        lambda word: F.array_contains(present, word),
    )
    some = F.size(present) > 0
    ordered = F.when(some, listed).otherwise(no_strings())
    name = squeeze(F.when(some, replace_all(plain, KEYWORD)).otherwise(plain))
    name = F.btrim(replace_all(name, r"\s*,\s*,\s*", ", "), F.lit(", "))
    notes = F.filter(
        F.array(get("notes"), get("taste"), F.array_join(ordered, ", ")), lambda part: part != ""
    )
    return {"bare_name": name, "all_notes": F.array_join(notes, ", ")}


def assemble(get: Fields) -> dict[str, Column]:
    line = get("original")
    header = (line == "") | F.endswith(line, F.lit(":")) | line.rlike(r"^\([A-Z]\)$")
    return {
        "original": line,
        "quantity": F.when(~header, get("quantity")),
        "unit": F.when(header, F.lit("")).otherwise(get("unit")),
        "name": F.when(header, line).otherwise(get("bare_name")),
        "preparation": F.when(header, F.lit("")).otherwise(get("all_notes")),
        "is_valid": ~header & (get("quantity").isNull() | (get("bare_name") != "")),
    }


def stages(units: dict[str, str] | None = None) -> list[Callable[[Fields], dict[str, Column]]]:
    units = unit_table() if units is None else units
    return [
        trim_line, find_number, read_quantity, split_rest, lambda get: find_unit(get, units), take_unit,
        split_preparation, move_bracket, drop_articles, find_keywords, move_keywords, assemble,
    ]


def parse_array(lines: Column, units: dict[str, str] | None = None) -> Column:
    """Array of lines to array of parsed structs, without leaving the row."""
    parsed = F.transform(lines, lambda line: F.struct(line.alias("line")))
    known = ["line"]
    for stage in stages(units):
        parsed = F.transform(parsed, _widen(stage, known))
        known = list(dict.fromkeys(known + _field_names(stage)))
    return F.transform(parsed, lambda item: F.struct(*[item[name].alias(name) for name in OUTPUT]))


def _widen(stage: Callable[[Fields], dict[str, Column]], carried: list[str]) -> Callable[[Column], Column]:
    def widen(item: Column) -> Column:
        fresh = stage(lambda name: item[name])
        kept = [item[name].alias(name) for name in carried if name not in fresh]
        return F.struct(*kept, *[value.alias(name) for name, value in fresh.items()])

    return widen


def _field_names(stage: Callable[[Fields], dict[str, Column]]) -> list[str]:
    return list(stage(lambda name: F.col(name)))


def parse_column(df: DataFrame, line_col: str, units: dict[str, str] | None = None) -> DataFrame:
    """Table form: one parsed line per row, added as the columns named in ``OUTPUT``."""
    prefix = "_line_"
    out = df.withColumn(prefix + "line", F.col(line_col))
    for stage in stages(units):
        fresh = stage(lambda name: F.col(prefix + name))
        out = out.withColumns({prefix + name: value for name, value in fresh.items()})
    return out.select(*df.columns, *[F.col(prefix + name).alias(name) for name in OUTPUT])
