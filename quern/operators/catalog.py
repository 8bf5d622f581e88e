"""The catalog table: display fields, facets, lookup, browse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import cells
from quern.functions.text import shuffled
from quern.operators.harvest import as_text, member
from quern.operators.retrieve import matching_categories
from quern.sources.tables import store

BROWSE_LIMIT = 20


def _quantity_text(value: Column) -> Column:
    """A number in its shortest form, a text such as ``1/2`` as it stands."""
    return F.when(cells.variant_kind(value) == "STRING", as_text(value)).otherwise(
        cells.number_text(as_text(value).try_cast("double"))
    )


def display_ingredients(cell: Column) -> Column:
    """``[{name, amount}]`` of a JSON list; elements that are no objects go."""
    objects = F.filter(cells.json_items(cell), lambda item: cells.variant_kind(item) == "OBJECT")
    return F.transform(
        objects,
        lambda item: F.struct(
            F.coalesce(as_text(member(item, "name")), F.lit("")).alias("name"),
            cells.amount_text(
                _quantity_text(member(item, "quantity")),
                as_text(member(item, "unit")), as_text(member(item, "preparation")),
            ).alias("amount"),
        ),
    )


def numbered_steps(cell: Column) -> Column:
    """``[{step, description}]``: texts are numbered from one, objects keep their own number."""
    numbered = F.transform(
        cells.json_items(cell),
        lambda item, at: F.when(
            cells.variant_kind(item) == "STRING",
            F.struct((at + 1).alias("step"), as_text(item).alias("description")),
        ).when(
            cells.variant_kind(item) == "OBJECT",
            F.struct(
                F.coalesce(F.try_variant_get(item, "$.step", "int"), at + 1).alias("step"),
                F.coalesce(as_text(member(item, "description")), F.lit("")).alias("description"),
            ),
        ),
    )
    return F.array_compact(numbered)


def names_text(ingredients: Column) -> Column:
    names = F.transform(ingredients, lambda item: item["name"])
    return F.array_join(F.filter(names, lambda name: name != ""), " ")


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in table order; tasks drop earlier ones before the shuffle."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_nth", F.row_number().over(last)).where(F.col("_nth") == 1).drop("_nth")


def build_catalog(records: DataFrame, image_template: str, key: str = "recipe_id", order: str = "ord") -> DataFrame:
    """Catalog rows of flat records; a later row replaces an earlier one with the same id.

    ``image_template`` is the address of a picture, with ``{id}`` for the record's id.
    """
    ingredients = display_ingredients(F.col("ingredients"))
    shaped = keep_last(records, key, order).select(
        F.col(key).alias("id"),
        F.coalesce("title", F.lit("nan")).alias("title"),
        F.lit("").alias("description"),
        cells.image_url(F.col(key), image_template).alias("image"),
        cells.category_list(F.col("category")).alias("categories"),
        cells.first_minutes(F.col("cook_time"), F.col("prep_time"), F.col("total_time")).alias("cook_time_minutes"),
        cells.servings(F.col("servings")).alias("servings"),
        ingredients.alias("ingredients"),
        numbered_steps(F.col("instructions")).alias("instructions"),
    )
    return shaped.withColumn("ingredients_text", names_text(F.col("ingredients")))


def facet_counts(catalog: DataFrame, category_col: str = "categories") -> DataFrame:
    """``(category, n)`` occurrences, combined before the shuffle."""
    exploded = catalog.select(F.explode(category_col).alias("category"))
    return exploded.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def facets(catalog: DataFrame, category_col: str = "categories") -> DataFrame:
    """Facets with the most records first, then by name."""
    return facet_counts(catalog, category_col).orderBy(F.desc("n"), "category")


def store_by_id(catalog: DataFrame, name: str = "catalog", id_col: str = "id") -> DataFrame:
    """Write a catalog in ranges of its id, sorted, so that a look-up touches few row groups."""
    return store(catalog.repartitionByRange(id_col), name, [id_col])


def lookup(catalog: DataFrame, record_id: int, id_col: str = "id") -> DataFrame:
    return catalog.where(F.col(id_col) == record_id)


def browse(
    catalog: DataFrame, filters: list[str] | None = None, limit: int = BROWSE_LIMIT,
    seed: int | None = None, id_col: str = "id", category_col: str = "categories",
) -> DataFrame:
    """Records in random order, as a blank query shows them; a seed makes the order repeatable."""
    shown = matching_categories(catalog, filters or [], category_col)
    order = [F.rand()] if seed is None else [shuffled(id_col, seed), F.col(id_col)]
    return shown.orderBy(*order).limit(limit)


def responses(catalog: DataFrame) -> DataFrame:
    """The public shape of a record; its title doubles as description."""
    return catalog.select(
        "id", "title", F.col("title").alias("description"), "image", "categories",
        F.col("cook_time_minutes").alias("cookTimeMinutes"), "servings", "ingredients", "instructions",
    )


def search_corpus(catalog: DataFrame) -> DataFrame:
    """Title and ingredient names, as the ranked search indexes them."""
    return catalog.select("id", "title", "ingredients_text")
