import json

from pyspark.sql import functions as F

from quern.functions import words
from quern.operators import harvest

MICRO = (
    '<div itemscope itemtype="http://schema.org/Recipe"><h1 itemprop="name">Soup &amp; Bread</h1>'
    '<span itemprop="ingredients">1 cup <b>water</b></span><span itemprop="ingredients">salt</span>'
    '<time itemprop="cookTime" datetime="PT10M">ten</time><meta itemprop="recipeYield" content="4">'
    '<div itemprop="author" itemscope itemtype="http://schema.org/Person"><i itemprop="name">Ann</i></div>'
    '<p itemprop="recipeInstructions">Step 1: Boil. Step 2: Serve.</p></div>'
)
GRAPH = {"@graph": [
    {"@type": "WebPage"},
    {"@type": ["Thing", "Recipe"], "name": "Pie", "recipeIngredient": "flour", "recipeCuisine": ["a", "b"],
     "recipeYield": "2", "prepTime": "PT5M",
     "recipeInstructions": [{"@type": "HowToStep", "text": "Mix 1. well"}, "1. Roll 2. Bake", {"text": ""}, 7, " "]},
]}
TOP = {"@type": "Recipe", "name": "Ignored"}


def page(*parts):
    return "<html>" + "".join(parts) + "</html>"


def script(value):
    raw = value if isinstance(value, str) else json.dumps(value)
    return f'<script type="application/ld+json">{raw}</script>'


def pages(spark):
    rows = [
        (1, page(MICRO, script(GRAPH))),
        (2, page(script(GRAPH), '<meta content="T &amp; U" property="og:title">')),
        (3, page(script([TOP, {"@type": "Organization"}]))),
        (4, page(script("{broken"))),
        (5, page("nothing")),
    ]
    return spark.createDataFrame(rows, "page_id bigint, html string")


def test_microdata_reader():
    [item] = words.microdata_items(MICRO)
    assert item["type"] == "http://schema.org/Recipe"
    assert item["properties"]["ingredients"] == ["1 cup water", "salt"]
    assert item["properties"]["cookTime"] == "PT10M"
    assert item["properties"]["author"] == {"type": "http://schema.org/Person", "properties": {"name": "Ann"}}


REFERENCES = """
<span id="a" itemprop="name">Soup</span><div id="b"><i itemprop="ingredients">salt</i><p id="c" itemprop="author" itemscope itemref="d"><b itemprop="name">Ann</b></p></div>
<div itemscope itemtype="t1" itemid=" urn:1 " itemref="b a nowhere b"><i itemprop="ingredients">water</i></div>
<div id="d" itemprop="knows" itemscope itemtype="t2" itemref="c d"><i itemprop="name">Bob</i></div>
<div id="self" itemscope itemref="self outer"><u itemprop="x">1</u></div><div id="outer"><div itemprop="y">2<s itemprop="z">3</s></div></div>
<div itemscope itemid="no type">text</div>
"""


def test_references_of_items():
    found = words.microdata_items(REFERENCES)
    ann = {"properties": {"knows": {"type": "t2", "properties": {"name": "Bob"}}, "name": "Ann"}}
    assert found == [
        {"type": "t1", "id": "urn:1", "properties": {"ingredients": ["salt", "water"], "author": ann, "name": "Soup"}},
        {"properties": {"x": "1", "y": "23", "z": "3"}},
        {"properties": {}},
    ]


def test_cycles_and_depth_end():
    loop = "".join(f'<div id="i{n}" itemprop="p" itemscope itemref="i{(n + 1) % 5}"></div>' for n in range(5))
    assert words.microdata_items(loop) == []
    around = '<div id="top"><div itemscope itemref="top"><i itemprop="a">1</i></div><i itemprop="b">2</i></div>'
    assert words.microdata_items(around) == [{"properties": {"b": "2", "a": "1"}}]
    deep = "<div>" * 50_000 + '<div itemscope><p itemprop="a">' + "<b>" * 50_000 + "x"
    assert words.microdata_items(deep) == [{"properties": {"a": "x"}}]


def test_pages_with_references_are_read_whole(spark):
    rows = spark.createDataFrame([(1, page(REFERENCES)), (2, page('<p itemprop="name" id="a">out</p>', MICRO))], "page_id bigint, html string")
    sizes = {r.page_id: r.n for r in harvest.harvest(rows).select("page_id", F.size("microdata").alias("n")).collect()}
    assert sizes == {1: 3, 2: 1}


def test_harvest_types_and_info(spark):
    found = harvest.harvest(pages(spark))
    typed = {r.page_id: r.types for r in harvest.with_types(found).collect()}
    assert typed[2] == ["WebPage", "Thing", "Recipe"]
    assert typed[3] == ["Recipe", "Organization"]
    assert typed[5] == []
    og = found.where("page_id = 2").select(F.col("opengraph")).first().opengraph
    assert [(o.property, o.content) for o in og] == [("og:title", "T & U")]
    info = {r.page_id: r.info for r in harvest.recipe_info(found).collect()}
    assert info[1].name == "Soup & Bread" and info[1].ingredient_count == 2
    assert info[1].instruction_count == len("Step 1: Boil. Step 2: Serve.")
    assert info[2].ingredient_count == len("flour") and info[2].instruction_count == 5
    assert info[2].has_cuisine and not info[2].has_category
    assert info[3] is None and info[5] is None
    row = harvest.assess(found).first()
    assert (row.total_files, row.loaded, row.failed, row.with_schema, row.with_both) == (5, 4, 1, 3, 2)
    assert row.with_schema_rate == 75.0


def test_extraction(spark):
    out = harvest.extract_recipes(harvest.harvest(pages(spark)), "page_id")
    rows = {r.recipe_id: r for r in out.collect()}
    assert rows[1].source == "microdata" and rows[1].title == "Soup & Bread"
    assert rows[1].instructions == ["Boil.", "Serve."] and rows[1].servings == "4"
    assert rows[2].source == "json-ld" and rows[2].cuisine == "a, b"
    assert rows[2].ingredients == ["flour"] and rows[2].instructions == ["Mix 1. well", "Roll", "Bake"]
    assert rows[3].source is None and rows[5].source is None
    tallies = harvest.extraction_tallies(out).first()
    assert (tallies.total_files, tallies.processed, tallies.failed, tallies.with_both) == (5, 2, 3, 2)
    assert {r.recipe_id for r in harvest.failed_documents(out).collect()} == {3, 4, 5}


def test_coverage_and_histogram(spark):
    found = harvest.harvest(pages(spark))
    assert harvest.type_histogram(harvest.with_types(found)).first().schema_type == "Recipe"
    percent = {r.field: r.percent for r in harvest.field_coverage(found).collect()}
    assert percent["has_cook_time"] == 50.0 and percent["has_category"] == 0.0
