"""Instruction steps: cleaning, splitting of long blocks, and facts read off the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions.text import bind, extract_all, no_strings, replace_all, split_on, strip

STRICT_TEMPERATURE = r"\b(?:" + fixed.TEMPERATURE_PATTERN + r")\b"


def clean_step(text: Column) -> Column:
    """Drop step numbering, collapse blanks, trim blanks and ``-:;``."""
    text = strip(text)
    for pattern in fixed.STEP_PREFIX_PATTERNS:
        text = replace_all(text, f"(?iU){pattern}")
    return F.btrim(replace_all(text, r"(?U)\s+", " "), F.lit(" -:;"))


def split_block(block: Column) -> Column:
    """Steps of one long block: at step markers, else between sentences; short fragments go."""
    marked = split_on(block, f"(?imU){fixed.BLOCK_STEP_PATTERN}")
    sentences = split_on(block, f"(?U){fixed.SENTENCE_BREAK_PATTERN}")
    pieces = bind(
        marked,
        lambda parts: F.when(
            (F.size(parts) == 1) & (F.length(block) > fixed.LONG_BLOCK_CHARS), sentences
        ).otherwise(parts),
    )
    return F.filter(F.transform(pieces, clean_step), lambda step: F.length(step) > fixed.SHORT_STEP_CHARS)


def step_texts(instructions: Column) -> Column:
    """Flat array of cleaned steps in order; blank instructions vanish."""
    cleaned = F.filter(F.transform(instructions, clean_step), lambda step: step != "")
    return F.flatten(
        F.transform(
            cleaned,
            lambda step: F.when(
                (F.length(step) > fixed.LONG_BLOCK_CHARS)
                & (F.contains(step, F.lit(". ")) | F.contains(step, F.lit("; "))),
                split_block(step),
            ).otherwise(F.array(step)),
        )
    )


def temperatures(text: Column, strict_words: bool = False) -> Column:
    pattern = STRICT_TEMPERATURE if strict_words else fixed.TEMPERATURE_PATTERN
    return F.array_distinct(extract_all(text, f"(?iU){pattern}"))


def times(text: Column) -> Column:
    return F.array_distinct(extract_all(text, f"(?iU){fixed.TIME_PATTERN}"))


def equipment(text: Column) -> Column:
    found = extract_all(text, f"(?iU){fixed.EQUIPMENT_PATTERN}")
    return F.array_distinct(F.transform(found, F.lower))


def step_metadata(text: Column, strict_words: bool = False) -> Column:
    return F.struct(
        temperatures(text, strict_words).alias("temperatures"),
        times(text).alias("times"),
        equipment(text).alias("equipment"),
    )


def _metadata_field(field: str):
    return lambda step: step["metadata"][field]


def process_instructions(instructions: Column, strict_words: bool = False) -> Column:
    """``{steps: [{text, metadata}], step_count, metadata}`` of an array of instruction texts."""
    steps = F.transform(
        step_texts(F.coalesce(instructions, no_strings())),
        lambda step: F.struct(step.alias("text"), step_metadata(step, strict_words).alias("metadata")),
    )

    def roll_up(found: Column) -> Column:
        merged = [
            F.array_distinct(F.flatten(F.transform(found, _metadata_field(field)))).alias(field)
            for field in ("temperatures", "times", "equipment")
        ]
        return F.struct(
            found.alias("steps"), F.size(found).alias("step_count"), F.struct(*merged).alias("metadata")
        )

    return bind(steps, roll_up)


def instruction_status(instructions: Column, step_count: Column) -> Column:
    return (
        F.when(F.coalesce(F.size(instructions), F.lit(0)) <= 0, F.lit("no_instructions"))
        .when(step_count > 0, F.lit("success"))
        .otherwise(F.lit("failed"))
    )
