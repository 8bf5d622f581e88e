"""From extracted recipes to flat records: parsing, structure checks, quality flags, first-wins dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import lines, steps
from quern.functions.cells import variant_kind
from quern.operators.harvest import as_text, items, member

# How a value's kind is named in error messages.
KIND_NAMES = {
    "ARRAY": "list", "OBJECT": "dict", "STRING": "str", "BIGINT": "int", "DECIMAL": "float",
    "DOUBLE": "float", "BOOLEAN": "bool", "VOID": "NoneType",
}
METADATA = ("temperatures", "times", "equipment")
RECORD_COLUMNS = [
    "recipe_id", "title", "ingredients", "instructions", "prep_time", "cook_time", "total_time", "servings",
    "cuisine", "category", "extraction_status", "ingredient_count", "step_count", "instruction_temperatures",
    "instruction_times", "instruction_equipment", "has_empty_title", "has_zero_ingredients", "has_zero_steps",
    "has_validation_errors",
]


def kind_name(value: Column) -> Column:
    kind = variant_kind(value)
    named = F.when(kind == "ARRAY", F.lit("list"))
    for label, name in KIND_NAMES.items():
        named = named.when(kind == label, F.lit(name))
    return named


# --- Parsing of the two lists ------------------------------------------------------------------------------
def parse_ingredients(recipes: DataFrame, ingredients_col: str = "ingredients", units: dict[str, str] | None = None) -> DataFrame:
    """Adds the valid parsed lines in order, and whether there are any.  Row-local."""
    parsed = F.filter(lines.parse_array(F.col(ingredients_col), units), lambda item: item["is_valid"])
    out = recipes.withColumn("parsed_ingredients", parsed)
    status = F.when(F.size("parsed_ingredients") > 0, F.lit("success")).otherwise(F.lit("failed"))
    return out.withColumn("ingredient_parse_status", status)


def ingredient_metrics(parsed: DataFrame, ingredients_col: str = "ingredients") -> DataFrame:
    """Line counts with and without quantity, and rates over the raw lines."""
    with_quantity = F.size(F.filter("parsed_ingredients", lambda item: item["quantity"].isNotNull()))
    counts = parsed.select(
        F.size(ingredients_col).alias("raw"), F.size("parsed_ingredients").alias("valid"), with_quantity.alias("numbered")
    ).agg(
        F.count(F.lit(1)).alias("recipes"),
        F.sum("raw").cast("bigint").alias("total_lines"),
        F.sum("numbered").cast("bigint").alias("with_quantity"),
        F.sum(F.col("valid") - F.col("numbered")).cast("bigint").alias("without_quantity"),
    )
    total = F.col("total_lines")
    return counts.withColumns(
        {
            "parse_rate": F.try_divide(F.lit(100.0) * (F.col("with_quantity") + F.col("without_quantity")), total),
            "quantity_rate": F.try_divide(F.lit(100.0) * F.col("with_quantity"), total),
        }
    )


def process_instructions(recipes: DataFrame, instructions_col: str = "instructions", strict_words: bool = False) -> DataFrame:
    """Adds processed steps with their facts, and a status.  Row-local."""
    instructions = F.col(instructions_col)
    out = recipes.withColumn("processed_instructions", steps.process_instructions(instructions, strict_words))
    status = steps.instruction_status(instructions, F.col("processed_instructions.step_count"))
    return out.withColumn("instruction_status", status)


def instruction_metrics(processed: DataFrame) -> DataFrame:
    """Step totals over successful recipes, and how many mention temperatures, times, equipment."""
    success = F.col("instruction_status") == "success"
    done = F.col("processed_instructions")
    counts = processed.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("instruction_status") == "no_instructions").alias("no_instructions"),
        F.coalesce(F.sum(F.when(success, done["step_count"])), F.lit(0)).cast("bigint").alias("total_steps"),
        *[
            F.count_if(success & (F.size(done["metadata"][name]) > 0)).alias(f"with_{name}")
            for name in METADATA
        ],
    )
    return counts.withColumn("average_steps", F.try_divide(F.col("total_steps").cast("double"), F.col("processed")))


# --- Structure of a recipe document --------------------------------------------------------------------------
def _python_text(value: Column) -> Column:
    """How an invalid title is shown in its message."""
    kind = variant_kind(value)
    return (
        F.when(value.isNull(), F.lit("''"))
        .when(kind == "STRING", F.concat(F.lit("'"), as_text(value), F.lit("'")))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(as_text(value)))
        .otherwise(as_text(value))
    )


def structure_errors(doc: Column) -> Column:
    """Messages for parts of a recipe document that have the wrong shape; empty when all is well."""
    ingredients, processed, title = member(doc, "parsed_ingredients"), member(doc, "processed_instructions"), member(doc, "title")
    inner = member(processed, "steps")
    filled = ~F.coalesce(as_text(processed), F.lit("")).isin("", "0", "0.0", "false", "[]", "{}", "null")
    wrong = lambda value, kind: value.isNotNull() & ~variant_kind(value).isin(kind, "VOID")
    of_class = lambda value: F.concat(F.lit("<class '"), kind_name(value), F.lit("'>"))
    messages = F.array(
        F.when(wrong(ingredients, "ARRAY"), F.concat(F.lit("parsed_ingredients is not a list: "), of_class(ingredients))),
        F.when(
            wrong(processed, "OBJECT") & filled,
            F.concat(F.lit("processed_instructions is not a dict: "), of_class(processed)),
        ).when(
            wrong(inner, "ARRAY"),
            F.concat(F.lit("processed_instructions['steps'] is not a list: "), of_class(inner)),
        ),
        F.when(
            F.coalesce((variant_kind(title) != "STRING") | (as_text(title) == ""), F.lit(True)),
            F.concat(F.lit("title is empty or invalid: "), _python_text(title)),
        ),
    )
    return F.array_compact(messages)


def sanitize(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Adds safe typed parts of a recipe document: wrong shapes become empty values."""
    doc = F.col(doc_col)
    processed = member(doc, "processed_instructions")
    metadata = member(processed, "metadata")
    title = member(doc, "title")
    return docs.withColumns(
        {
            "title": F.when(variant_kind(title) == "STRING", as_text(title)).otherwise(F.lit("")),
            "ingredient_items": F.filter(
                items(member(doc, "parsed_ingredients")), lambda item: variant_kind(item) == "OBJECT"
            ),
            "step_items": items(member(processed, "steps")),
            "step_count": F.coalesce(F.try_variant_get(processed, "$.step_count", "int"), F.lit(0)),
            **{name: F.coalesce(member(metadata, name), F.parse_json(F.lit("[]"))) for name in METADATA},
            "errors": structure_errors(doc),
        }
    )


def extraction_status(empty_title: Column, zero_ingredients: Column, zero_steps: Column) -> Column:
    return (
        F.when(empty_title, F.lit("partial"))
        .when(~zero_ingredients & ~zero_steps, F.lit("success"))
        .when(~zero_ingredients | ~zero_steps, F.lit("partial"))
        .otherwise(F.lit("failed"))
    )


def ingredients_json(ingredient_items: Column) -> Column:
    """Compact JSON of the four public ingredient keys; a missing quantity stays as null."""
    text_or = lambda item, key: F.coalesce(member(item, key), F.parse_json(F.lit('""'))).alias(key)
    kept = F.transform(
        ingredient_items,
        lambda item: F.struct(
            text_or(item, "name"), member(item, "quantity").alias("quantity"),
            text_or(item, "unit"), text_or(item, "preparation"),
        ),
    )
    return F.to_json(kept, {"ignoreNullFields": "false"})


def steps_json(step_items: Column) -> Column:
    texts = F.transform(step_items, lambda step: as_text(member(step, "text")))
    return F.to_json(F.filter(texts, lambda step: step != ""))


def document_key(doc: Column, file_name: Column) -> Column:
    """Record id of a document, else the stem of its file name; NULL when that is no whole number."""
    own = as_text(member(doc, "recipe_id"))
    own = F.when(~own.isin("", "0", "null"), own)
    return F.trim(F.coalesce(own, file_stem(file_name))).try_cast("bigint")


def file_stem(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"([^/]+?)(?:\.[^./]*)?$", 1)


def structure_records(docs: DataFrame, doc_col: str = "doc", file_col: str = "file_name") -> DataFrame:
    """Fixed 20-column records of recipe documents, plus the file name; rows without an id keep a NULL id."""
    doc = F.col(doc_col)
    safe = sanitize(docs, doc_col)
    plain = lambda name: F.coalesce(as_text(member(doc, name)), F.lit(""))
    flagged = safe.withColumns(
        {
            "recipe_id": document_key(doc, F.col(file_col)),
            "has_empty_title": F.col("title") == "",
            "has_zero_ingredients": F.size("ingredient_items") == 0,
            "has_zero_steps": F.col("step_count") == 0,
            "has_validation_errors": F.size("errors") > 0,
            "ingredients": ingredients_json(F.col("ingredient_items")),
            "instructions": steps_json(F.col("step_items")),
            "ingredient_count": F.size("ingredient_items"),
            **{f"instruction_{name}": F.to_json(name) for name in METADATA},
            **{name: plain(name) for name in ("prep_time", "cook_time", "total_time", "servings", "cuisine", "category")},
        }
    )
    status = extraction_status(F.col("has_empty_title"), F.col("has_zero_ingredients"), F.col("has_zero_steps"))
    return flagged.withColumn("extraction_status", status).select(*RECORD_COLUMNS, file_col)


def rejected_records(records: DataFrame, file_col: str = "file_name") -> DataFrame:
    """Documents whose id is not a whole number."""
    return records.where(F.col("recipe_id").isNull()).select(file_col)


def keep_first(records: DataFrame, key: str = "recipe_id", order: str = "file_name") -> DataFrame:
    """The first record of each id in the given order; tasks drop later ones before the shuffle."""
    first = Window.partitionBy(key).orderBy(order)
    kept = records.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(first))
    return kept.where(F.col("_nth") == 1).drop("_nth")


def record_metrics(records: DataFrame, kept: DataFrame) -> DataFrame:
    """Totals of the structuring step in one row; ``records`` is before the dedupe, ``kept`` after it."""
    seen = records.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("recipe_id").isNull()).alias("failed")
    )
    status = F.col("extraction_status")
    totals = kept.agg(
        F.count(F.lit(1)).alias("processed"),
        *[F.count_if(status == name).alias(f"status_{name}") for name in ("success", "partial", "failed")],
        F.coalesce(F.sum("ingredient_count"), F.lit(0)).cast("bigint").alias("total_ingredients"),
        F.coalesce(F.sum("step_count"), F.lit(0)).cast("bigint").alias("total_steps"),
        F.count_if("has_empty_title").alias("empty_titles"),
        F.count_if("has_zero_ingredients").alias("zero_ingredients"),
        F.count_if("has_zero_steps").alias("zero_steps"),
        F.count_if("has_validation_errors").alias("validation_errors"),
    )
    both = seen.withColumn("one", F.lit(1)).join(totals.withColumn("one", F.lit(1)), "one").drop("one")
    done = F.col("processed")
    return both.withColumns(
        {
            "duplicate_ids": F.col("total_files") - F.col("failed") - done,
            "average_ingredients": F.try_divide(F.col("total_ingredients").cast("double"), done),
            "average_steps": F.try_divide(F.col("total_steps").cast("double"), done),
            **{
                f"{name}_percent": F.try_divide(F.lit(100.0) * F.col(f"status_{name}"), done)
                for name in ("success", "partial", "failed")
            },
        }
    )


def status_samples(kept: DataFrame, order: str = "file_name", per_status: int = 3) -> DataFrame:
    """The first few successful and partial records."""
    nth = Window.partitionBy("extraction_status").orderBy(order)
    shown = kept.where(F.col("extraction_status").isin("success", "partial"))
    return shown.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= per_status)


def as_documents(recipes: DataFrame, id_col: str = "recipe_id") -> DataFrame:
    """Typed recipes, after both parsing steps, as documents for :func:`structure_records`."""
    fields = F.struct(*[F.col(name) for name in recipes.columns])
    return recipes.select(
        F.to_variant_object(fields).alias("doc"), F.concat(F.col(id_col).cast("string"), F.lit(".json")).alias("file_name")
    )
