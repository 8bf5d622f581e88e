"""Structured data inside web pages: harvest, assessment and recipe extraction.

A harvested document carries ``microdata`` and ``json_ld`` as ``ARRAY<VARIANT>``: the same field may hold a
string, a list or an object from one page to the next.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quern.functions import text, words
from quern.functions.cells import parse_json, variant_kind

VARIANTS = "array<variant>"
SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']?application/ld\+json[^>]*>(.*?)</script>"
META = r"(?is)<meta\s[^>]*property\s*=\s*[\"']og:[^>]*>"
OPTIONAL_FIELDS = {
    "prep_time": "prepTime", "cook_time": "cookTime", "total_time": "totalTime",
    "servings": "recipeYield", "cuisine": "recipeCuisine", "category": "recipeCategory",
}


# --- Variant helpers -------------------------------------------------------------------------------------
def member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def items(value: Column) -> Column:
    """Elements of a list value; empty when it is missing or no list."""
    return F.coalesce(F.try_variant_get(value, "$", VARIANTS), no_items())


def no_items() -> Column:
    return F.from_json(F.lit("[]"), VARIANTS)


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def has_content(value: Column) -> Column:
    """False for what counts as empty: null, ``""``, zero, false, empty list or object."""
    plain = as_text(value)
    return F.coalesce(
        F.when(variant_kind(value) == "STRING", plain != "")
        .otherwise(~plain.isin("0", "0.0", "false", "[]", "{}", "null")),
        F.lit(False),
    )


def texts_of(value: Column) -> Column:
    """A string or a list of strings as an array."""
    kind = variant_kind(value)
    return (
        F.when(kind == "ARRAY", F.transform(items(value), as_text))
        .when(value.isNotNull() & (kind != "VOID"), F.array(as_text(value)))
        .otherwise(text.no_strings())
    )


def length_of(value: Column) -> Column:
    """Number of list elements, object keys, or characters of a string."""
    kind = variant_kind(value)
    return F.coalesce(
        F.when(kind == "ARRAY", F.size(items(value)))
        .when(kind == "OBJECT", F.size(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))))
        .when(kind == "STRING", F.length(as_text(value))),
        F.lit(0),
    )


# --- Pages -------------------------------------------------------------------------------------------------
@arrow_udf(T.StringType())
def _microdata_json(pages: pa.Array) -> pa.Array:
    found = [None if page is None else json.dumps(words.microdata_items(page)) for page in pages.to_pylist()]
    return pa.array(found, pa.string())


def _scoped_part(html: Column) -> Column:
    """The page from its first ``itemscope`` tag on; NULL without one.

    A tag that only stands inside a script does not count as the first; such a page is kept whole, as is one in
    which an item may refer to elements before it.
    """
    at = F.regexp_instr(html, F.lit(r"(?is)<[a-z][^<>]*\sitemscope\b"))
    before = F.substr(html, F.lit(1), at - 1)
    in_script = F.regexp_count(before, F.lit(r"(?i)<script\b")) != F.regexp_count(before, F.lit(r"(?i)</script\b"))
    refers = F.contains(F.lower(html), F.lit("itemref"))
    part = F.when(in_script | refers, html).when(at > 0, F.substr(html, at))
    return F.when(F.contains(F.lower(html), F.lit("itemscope")), part)


def _tolerant(block: Column) -> Column:
    """A script block without comments and markers around it, and without control characters."""
    comment = r"//[^\r\n]*|/\*.*?\*/|<!--.*?-->|<!--|-->|<!\[CDATA\[|\]\]>"
    bare = F.regexp_replace(F.regexp_replace(block, rf"(?s)^(?:\s|{comment})+", ""), r"(?s)(?:\s|//\s*-->|//\s*\]\]>|/\*[^*]*\*/|<!--[^>]*-->|-->|\]\]>|;)+$", "")
    return F.regexp_replace(bare, r"[\x00-\x1F]", " ")


def harvest(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, microdata, json_ld, opengraph, harvested)`` of a page table.

    Only what stands from the first ``itemscope`` tag on is sent to Python, but for pages with references.  A JSON-LD block that does not
    parse is tried again without comments around it and with control characters as blanks; a page with a
    block that is broken even so counts as not harvested.
    """
    html = F.col(html_col)
    found = pages.select(
        id_col,
        text.extract_all(html, SCRIPT, 1).alias("scripts"),
        text.extract_all(html, META).alias("metas"),
        _microdata_json(_scoped_part(html)).alias("scopes"),
    )
    parsed = F.transform("scripts", lambda block: F.coalesce(parse_json(block), parse_json(_tolerant(block))))
    blocks = F.flatten(
        F.transform(
            "blocks", lambda block: F.when(variant_kind(block) == "ARRAY", items(block)).otherwise(F.array(block))
        )
    )
    contents = text.unescape_entities(F.transform("metas", lambda tag: _attribute(tag, "content")))
    found = found.withColumns({"blocks": parsed, "contents": contents})
    ok = F.forall("blocks", lambda block: block.isNotNull())
    properties = F.transform("metas", lambda tag: _attribute(tag, "property"))
    return found.select(
        id_col,
        F.when(ok, items(F.try_parse_json("scopes"))).alias("microdata"),
        F.when(ok, blocks).alias("json_ld"),
        F.when(ok, F.zip_with(properties, "contents", lambda p, c: F.struct(p.alias("property"), c.alias("content"))))
        .alias("opengraph"),
        ok.alias("harvested"),
    )


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))


def open_documents(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Harvest documents stored as one JSON object each (``doc`` VARIANT), as harvested columns."""
    doc = F.col(doc_col)
    return docs.withColumns({"microdata": items(member(doc, "microdata")), "json_ld": items(member(doc, "json-ld"))})


# --- Assessment ----------------------------------------------------------------------------------------------
def schema_types(microdata: Column, json_ld: Column) -> Column:
    """Every schema type a document names, in order, with repetitions."""
    from_micro = F.flatten(F.transform(microdata, lambda item: texts_of(member(item, "type"))))
    from_linked = F.flatten(
        F.transform(
            json_ld,
            lambda block: F.concat(
                texts_of(member(block, "@type")),
                F.flatten(F.transform(items(member(block, "@graph")), lambda node: texts_of(member(node, "@type")))),
            ),
        )
    )
    return F.concat(from_micro, from_linked)


def with_types(harvested: DataFrame) -> DataFrame:
    return harvested.withColumn("types", schema_types(F.col("microdata"), F.col("json_ld")))


def type_histogram(typed: DataFrame) -> DataFrame:
    """``(schema_type, documents)``, most common first."""
    counted = typed.select(F.explode("types").alias("schema_type")).groupBy("schema_type")
    return counted.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "schema_type")


def mentions_recipe(types: Column) -> Column:
    return F.exists(types, lambda name: F.contains(name, F.lit("Recipe")))


def microdata_node(microdata: Column) -> Column:
    """Properties of the first microdata item whose type contains ``Recipe``."""
    wanted = F.filter(
        microdata,
        lambda item: mentions_recipe(texts_of(member(item, "type"))) & member(item, "properties").isNotNull(),
    )
    return member(F.get(wanted, 0), "properties")


def linked_node(json_ld: Column) -> Column:
    """The first ``@graph`` node whose type is, or includes, exactly ``Recipe``."""
    nodes = F.flatten(F.transform(json_ld, lambda block: items(member(block, "@graph"))))
    return F.get(F.filter(nodes, lambda node: F.array_contains(texts_of(member(node, "@type")), "Recipe")), 0)


def _presence(node: Column, ingredient_field: str) -> list[Column]:
    ingredients, instructions = member(node, ingredient_field), member(node, "recipeInstructions")
    return [
        F.coalesce(as_text(member(node, "name")), F.lit("")).alias("name"),
        (length_of(ingredients) > 0).alias("has_ingredients"),
        length_of(ingredients).alias("ingredient_count"),
        (length_of(instructions) > 0).alias("has_instructions"),
        length_of(instructions).alias("instruction_count"),
        *[member(node, field).isNotNull().alias(f"has_{name}") for name, field in OPTIONAL_FIELDS.items()],
    ]


def recipe_info(harvested: DataFrame) -> DataFrame:
    """Adds ``info``: which fields the first recipe of a document has; NULL without a recipe."""
    nodes = harvested.withColumns(
        {"_micro": microdata_node(F.col("microdata")), "_linked": linked_node(F.col("json_ld"))}
    )
    info = F.when(F.col("_micro").isNotNull(), F.struct(*_presence(F.col("_micro"), "ingredients"))).when(
        F.col("_linked").isNotNull(), F.struct(*_presence(F.col("_linked"), "recipeIngredient"))
    )
    return nodes.withColumn("info", info).drop("_micro", "_linked")


def _rate(part: str, whole: str) -> Column:
    return F.try_divide(F.lit(100.0) * F.col(part), F.col(whole))


def assess(harvested: DataFrame, loaded_col: str = "harvested") -> DataFrame:
    """One row of corpus counts, and rates over the documents that could be loaded."""
    seen = recipe_info(with_types(harvested))
    loaded, recipe = F.col(loaded_col), mentions_recipe(F.col("types"))
    info = F.col("info")
    counts = seen.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(loaded).alias("loaded"),
        F.count_if(~loaded).alias("failed"),
        F.count_if(loaded & recipe).alias("with_schema"),
        F.count_if(loaded & recipe & info["has_ingredients"]).alias("with_ingredients"),
        F.count_if(loaded & recipe & info["has_instructions"]).alias("with_instructions"),
        F.count_if(loaded & recipe & info["has_ingredients"] & info["has_instructions"]).alias("with_both"),
    )
    return counts.withColumns(
        {f"{name}_rate": _rate(name, "loaded") for name in ("with_schema", "with_ingredients", "with_instructions", "with_both")}
    )


def field_coverage(harvested: DataFrame) -> DataFrame:
    """``(field, present, percent)`` over documents with a recipe, and the mean list lengths."""
    info = recipe_info(with_types(harvested)).where(mentions_recipe(F.col("types")) & F.col("info").isNotNull())
    names = [f"has_{name}" for name in OPTIONAL_FIELDS]
    totals = info.select("info.*").agg(
        F.count(F.lit(1)).alias("details"),
        *[F.count_if(F.col(name)).alias(name) for name in names],
        F.avg("ingredient_count").alias("mean_ingredients"),
        F.avg("instruction_count").alias("mean_instructions"),
    )
    stacked = ", ".join(f"'{name}', {name}" for name in names)
    return totals.select(
        F.expr(f"stack({len(names)}, {stacked}) AS (field, present)"),
        "details", "mean_ingredients", "mean_instructions",
    ).select(
        "field", "present", _rate("present", "details").alias("percent"), "mean_ingredients", "mean_instructions"
    )


def first_documents(harvested: DataFrame, name_col: str, limit: int = 20) -> DataFrame:
    """The sample that is assessed before a full pass: the first documents by name."""
    return harvested.orderBy(name_col).limit(limit)


# --- Extraction ------------------------------------------------------------------------------------------------
def _join_texts(value: Column) -> Column:
    return F.array_join(texts_of(value), ", ")


def _listed(value: Column) -> Column:
    """Non-empty elements as text; a plain string is a list of one."""
    one = F.when(as_text(value) != "", F.array(as_text(value))).otherwise(text.no_strings())
    many = F.transform(F.filter(items(value), has_content), as_text)
    return F.when(variant_kind(value) == "STRING", one).otherwise(many)


def _piece(value: Column, split: bool) -> Column:
    return F.struct(value.alias("text"), F.lit(split).alias("split"))


def _plain_steps(value: Column) -> Column:
    """Microdata: one string is split later, list elements are steps as they are."""
    return F.when(variant_kind(value) == "STRING", F.array(_piece(as_text(value), True))).otherwise(
        F.transform(F.filter(items(value), has_content), lambda step: _piece(as_text(step), False))
    )


def _mixed_steps(value: Column) -> Column:
    """JSON-LD: objects give their ``text`` unsplit, strings are split later, anything else is skipped."""
    known = F.filter(
        items(value),
        lambda step: (variant_kind(step) == "STRING")
        | ((variant_kind(step) == "OBJECT") & has_content(member(step, "text"))),
    )
    return F.when(variant_kind(value) == "STRING", F.array(_piece(as_text(value), True))).otherwise(
        F.transform(
            known,
            lambda step: F.when(variant_kind(step) == "OBJECT", _piece(as_text(member(step, "text")), False))
            .otherwise(_piece(as_text(step), True)),
        )
    )


def extract_recipes(harvested: DataFrame, id_col: str) -> DataFrame:
    """Recipe of each document, microdata first; documents without one are kept with NULL ``source``.

    Every text of a record is cleaned in one batch, so a document visits Python once.  Each select
    names what the next one uses several times, so that no JSON path is walked twice; plain columns
    instead of one struct keep the optimizer from copying the whole struct per field.
    """
    nodes = harvested.select(
        F.col(id_col).alias("recipe_id"),
        microdata_node(F.col("microdata")).alias("micro"),
        linked_node(F.col("json_ld")).alias("linked"),
    )
    chosen = nodes.select(
        "recipe_id", F.coalesce("micro", "linked").alias("node"),
        F.when(F.col("micro").isNotNull(), F.lit("microdata")).when(F.col("linked").isNotNull(), F.lit("json-ld")).alias("source"),
    )
    node, linked = F.col("node"), F.col("source") == "json-ld"
    named = {"name": "name", "servings": "recipeYield", "cuisine": "recipeCuisine", "category": "recipeCategory"}
    timed = {"prep_time": "prepTime", "cook_time": "cookTime", "total_time": "totalTime"}
    values = chosen.select(
        "recipe_id", "source",
        *[member(node, field).alias(alias) for alias, field in {**named, **timed}.items()],
        F.when(linked, member(node, "recipeIngredient")).otherwise(member(node, "ingredients")).alias("listed"),
        member(node, "recipeInstructions").alias("steps"),
    )
    no_steps = F.array().cast("array<struct<text:string,split:boolean>>")
    steps = F.when(linked, _mixed_steps(F.col("steps"))).otherwise(_plain_steps(F.col("steps")))
    raw = values.select(
        "recipe_id", "source",
        *[F.when(F.col("source").isNotNull(), F.coalesce(as_text(F.col(alias)), F.lit(""))).alias(alias) for alias in timed],
        F.array(
            F.coalesce(as_text(F.col("name")), F.lit("")),
            *[_join_texts(F.col(alias)) for alias in ("servings", "cuisine", "category")],
        ).alias("heads"),
        F.coalesce(_listed(F.col("listed")), text.no_strings()).alias("listed"),
        F.coalesce(steps, no_steps).alias("steps"),
    )
    texts = F.concat("heads", "listed", F.transform("steps", lambda step: step["text"]))
    cleaned = raw.withColumn("clean", F.when(F.col("source").isNotNull(), text.clean_texts(texts)))
    n_heads = F.lit(len(named))
    parted = cleaned.withColumns(
        {
            "ingredients": F.slice("clean", n_heads + 1, F.size("listed")),
            "step_texts": F.slice("clean", n_heads + F.size("listed") + 1, F.size("steps")),
        }
    )
    split = F.zip_with(
        "step_texts", "steps",
        lambda cleaned_text, step: F.when(
            step["split"], F.filter(text.split_steps(cleaned_text), lambda part: part != "")
        ).otherwise(F.array(cleaned_text)),
    )
    return parted.select(
        "recipe_id", F.get("clean", 0).alias("title"), "ingredients", F.flatten(split).alias("instructions"), *timed,
        *[F.get("clean", at).alias(alias) for at, alias in enumerate(("servings", "cuisine", "category"), 1)],
        "source",
    )


def extraction_tallies(extracted: DataFrame) -> DataFrame:
    """Counts by source and completeness; rates over all documents."""
    found = F.col("source").isNotNull()
    lists = {name: found & (F.size(name) > 0) for name in ("ingredients", "instructions")}
    counts = extracted.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(found).alias("processed"),
        F.count_if(~found).alias("failed"),
        F.count_if(F.col("source") == "microdata").alias("from_microdata"),
        F.count_if(F.col("source") == "json-ld").alias("from_jsonld"),
        F.count_if(lists["ingredients"]).alias("with_ingredients"),
        F.count_if(lists["instructions"]).alias("with_instructions"),
        F.count_if(lists["ingredients"] & lists["instructions"]).alias("with_both"),
    )
    return counts.withColumns(
        {f"{name}_rate": _rate(name, "total_files") for name in ("processed", "with_ingredients", "with_instructions", "with_both")}
    )


def failed_documents(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("source").isNull()).select("recipe_id")
