"""Validation of flat records and the split into clean rows and a quarantine table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.cells import parse_json, variant_kind
from quern.functions.text import bind, is_blank, no_strings, shuffled
from quern.operators.harvest import as_text, items, member
from quern.operators.records import kind_name
from quern.operators.skew import BROADCAST_ROWS, at_most, broadcast_if_small, may_hold
from quern.sources.tables import store

SAMPLE_SIZE = 15
JSON_FIELDS = ("instruction_temperatures", "instruction_times", "instruction_equipment")
TEXT_FIELDS = ("cuisine", "category", "prep_time", "cook_time", "servings")


def _checked_list(cell: Column, column: str, check) -> Column:
    """Messages about a JSON cell: syntax, then shape, then each element through ``check``."""
    def problems(parsed: Column) -> Column:
        return (
            F.when(parsed.isNull(), F.array(F.lit(f"Invalid JSON in '{column}' column")))
            .when(
                variant_kind(parsed) != "ARRAY",
                F.array(F.concat(F.lit(f"'{column}' JSON is not an array: "), kind_name(parsed))),
            )
            .otherwise(F.flatten(F.transform(items(parsed), check)))
        )

    return F.when(F.coalesce(cell, F.lit("")) == "", no_strings()).otherwise(bind(parse_json(cell), problems))


def _label(prefix: str, position: Column) -> Column:
    return F.concat(F.lit(f"{prefix} ["), position.cast("string"), F.lit("]"))


def _quoted(value: Column) -> Column:
    """A value as it is shown in a message: strings in quotes."""
    kind = variant_kind(value)
    return F.when(kind == "STRING", F.concat(F.lit("'"), as_text(value), F.lit("'"))).otherwise(as_text(value))


def _check_ingredient(item: Column, position: Column) -> Column:
    quantity, name = member(item, "quantity"), member(item, "name")
    numeric = variant_kind(quantity).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN", "VOID")
    named = (variant_kind(name) == "STRING") & ~is_blank(as_text(name))
    of_item = F.array(
        F.when(
            quantity.isNotNull() & ~numeric,
            F.concat(
                _label("Ingredient", position), F.lit(" '"),
                F.when(variant_kind(name) == "VOID", F.lit("None")).otherwise(F.coalesce(as_text(name), F.lit("?"))),
                F.lit("' has non-numeric quantity: "), _quoted(quantity),
            ),
        ),
        F.when(~F.coalesce(named, F.lit(False)), F.concat(_label("Ingredient", position), F.lit(" has empty name"))),
    )
    wrong_shape = F.concat(_label("Ingredient", position), F.lit(" is not a dict: "), kind_name(item))
    return F.when(variant_kind(item) == "OBJECT", F.array_compact(of_item)).otherwise(F.array(wrong_shape))


def _check_step(item: Column, position: Column) -> Column:
    label = _label("Instruction step", position)
    return (
        F.when(variant_kind(item) != "STRING", F.array(F.concat(label, F.lit(" is not a string: "), kind_name(item))))
        .when(is_blank(as_text(item)), F.array(F.concat(label, F.lit(" is empty or whitespace only"))))
        .otherwise(no_strings())
    )


def ingredient_errors(cell: Column) -> Column:
    return _checked_list(cell, "ingredients", _check_ingredient)


def instruction_errors(cell: Column) -> Column:
    return _checked_list(cell, "instructions", _check_step)


def row_errors(title: Column, ingredients: Column, instructions: Column) -> Column:
    """Title, ingredient and instruction messages, in that order."""
    untitled = F.when(is_blank(title), F.array(F.lit("Empty or missing title"))).otherwise(no_strings())
    return F.concat(untitled, ingredient_errors(ingredients), instruction_errors(instructions))


def later_occurrences(records: DataFrame, key: str, order: str) -> DataFrame:
    """``(key, order)`` of every row after the first with its key.

    First rows are found by a partial aggregation and removed by the pair of key and order, which is
    unique, so even a key that holds most of the table spreads over all tasks.
    """
    pairs = records.select(key, order)
    first = pairs.groupBy(key).agg(F.min(order).alias(order))
    return pairs.join(first, [key, order], "left_anti")


def _marked(records: DataFrame, later: DataFrame, key: str, order: str) -> DataFrame:
    marked = records.join(later.withColumn("is_duplicate", F.lit(True)), [key, order], "left")
    return marked.withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def with_errors(
    records: DataFrame, key: str = "recipe_id", order: str = "ord",
    title: str = "title", ingredients: str = "ingredients", instructions: str = "instructions",
) -> DataFrame:
    """Adds ``errors`` and ``is_duplicate``; a later occurrence counts even if the first is invalid.

    Few later occurrences are broadcast.  Of many, a filter is, and only the rows that it lets through are shuffled, the
    later occurrences and a few others; all the rest stay in place.
    """
    later = store(later_occurrences(records, key, order), "later")
    if at_most(later, BROADCAST_ROWS):
        marked = _marked(records, broadcast_if_small(later), key, order)
    else:
        maybe = F.coalesce(may_hold(records, later, [key, order]), F.lit(False))
        split = records.withColumn("_maybe", maybe)
        rest = split.where(~F.col("_maybe")).drop("_maybe").withColumn("is_duplicate", F.lit(False))
        found = _marked(split.where("_maybe").drop("_maybe"), later, key, order)
        marked = found.select(*rest.columns).unionByName(rest)
    again = F.when(
        F.col("is_duplicate"), F.array(F.concat(F.lit("Duplicate recipe_id: "), F.col(key).cast("string")))
    ).otherwise(no_strings())
    errors = F.concat(row_errors(F.col(title), F.col(ingredients), F.col(instructions)), again)
    return marked.withColumn("errors", errors)


def clean_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors", "is_duplicate")


def anomalies(checked: DataFrame, key: str = "recipe_id", title: str = "title", order: str = "ord") -> DataFrame:
    return checked.where(F.size("errors") > 0).select(key, F.col(title).alias("title"), "errors", order)


def anomaly_counts(checked: DataFrame, title: str = "title") -> DataFrame:
    """Counts by kind of error over all messages; list sizes count clean rows only."""
    clean = F.size("errors") == 0
    mentions = lambda part: F.sum(F.size(F.filter("errors", lambda e: F.contains(e, F.lit(part))))).cast("bigint")
    return checked.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(clean).alias("valid_records"),
        F.count_if(~clean).alias("anomaly_records"),
        F.count_if("is_duplicate").alias("duplicate_ids"),
        F.count_if(is_blank(F.col(title))).alias("empty_titles"),
        mentions("Invalid JSON in 'ingredients'").alias("invalid_ingredients_json"),
        mentions("Invalid JSON in 'instructions'").alias("invalid_instructions_json"),
        mentions("non-numeric quantity").alias("non_numeric_quantities"),
        mentions("empty or whitespace only").alias("empty_instruction_steps"),
        F.count_if(clean & (F.col("ingredient_count") == 0)).alias("zero_ingredients"),
        F.count_if(clean & (F.col("step_count") == 0)).alias("zero_steps"),
    )


def clean_totals(clean: DataFrame) -> DataFrame:
    """Row count, totals and averages of the clean rows."""
    totals = clean.agg(
        F.count(F.lit(1)).alias("valid_records"),
        F.coalesce(F.sum("ingredient_count"), F.lit(0)).cast("bigint").alias("total_ingredients"),
        F.coalesce(F.sum("step_count"), F.lit(0)).cast("bigint").alias("total_steps"),
    )
    return totals.withColumns(
        {
            "average_ingredients": F.try_divide(F.col("total_ingredients").cast("double"), F.col("valid_records")),
            "average_steps": F.try_divide(F.col("total_steps").cast("double"), F.col("valid_records")),
        }
    )


def coverage(clean: DataFrame) -> DataFrame:
    """``(field, present, percent)``: non-empty JSON lists and non-blank texts of the clean rows."""
    present = {
        **{name: F.size(items(parse_json(F.col(name)))) > 0 for name in JSON_FIELDS},
        **{name: ~is_blank(F.col(name)) for name in TEXT_FIELDS},
    }
    totals = clean.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(flag).alias(name) for name, flag in present.items()]
    )
    stacked = ", ".join(f"'{name}', {name}" for name in present)
    return totals.select("rows", F.expr(f"stack({len(present)}, {stacked}) AS (field, present)")).select(
        "field", "present",
        F.coalesce(F.try_divide(F.lit(100.0) * F.col("present"), F.col("rows")), F.lit(0.0)).alias("percent"),
    )


def anomaly_log(found: DataFrame, key: str = "recipe_id") -> DataFrame:
    return found.select(key, F.array_join("errors", "; ").alias("errors"), "ord")


def anomaly_detail(found: DataFrame, order: str = "ord", limit: int = 20) -> DataFrame:
    """The first anomalies in table order with shortened title and messages."""
    shown = found.orderBy(order).limit(limit)
    message = F.array_join("errors", "; ")
    title = F.coalesce("title", F.lit("nan"))
    return shown.select(
        "recipe_id", order,
        F.when(F.length(title) > 40, F.concat(F.substring(title, 1, 40), F.lit("..."))).otherwise(title).alias("title"),
        F.when(F.length(message) > 80, F.concat(F.substring(message, 1, 77), F.lit("..."))).otherwise(message).alias("errors"),
    )


def review_sample(clean: DataFrame, key: str = "recipe_id", size: int = SAMPLE_SIZE, seed: int = 42) -> DataFrame:
    """A reproducible random sample that does not depend on partitioning."""
    return clean.orderBy(shuffled(key, seed), key).limit(size)
