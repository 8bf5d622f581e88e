import pytest
from pyspark.sql import functions as F

from quern.functions import cells, fixed, lines, steps, text

LINES = {
    "1 1/2 cups flour": (1.5, "cup", "flour", "", True),
    "½ cup milk": (0.5, "cup", "milk", "", True),
    "2-3 cloves garlic": (2.5, "clove", "garlic", "", True),
    "2 to 4 eggs": (3.0, "", "eggs", "", True),
    "10/4 oz x": (2.5, "ounce", "x", "", True),
    "1½ cups flour": (1.0, "", "½ cups flour", "", True),
    "1/0 cup x": (None, "", "1/0 cup x", "", True),
    "1 tbsp salt": (1.0, "tablespoon", "salt", "", True),
    "2 fl oz cream": (2.0, "fluid_ounce", "cream", "", True),
    "3 large eggs": (3.0, "", "eggs", "", True),
    "1 teaspoon salt": (1.0, "", "teaspoon salt", "", True),
    "1 lb beef (80% lean), cubed": (1.0, "pound", "beef", "cubed, 80% lean", True),
    "of the fresh onion": (None, "", "onion", "fresh", True),
    "quartered lemon": (None, "", "lemon", "quartered, quartered", True),
    "Salt to taste": (None, "", "salt", "to taste", True),
    "beef (lean, cut) x": (None, "", "beef (lean", "cut) x", True),
    "2 cups": (2.0, "cup", "", "", False),
    "For the sauce:": (None, "", "For the sauce:", "", False),
    "(A)": (None, "", "(A)", "", False),
    "  ": (None, "", "", "", False),
    "2.5 cups hot water or milk": (2.5, "cup", "water milk", "hot, or", True),
}


@pytest.mark.parametrize("form", ["table", "array"])
def test_quantity_lines(spark, form):
    df = spark.createDataFrame([(line,) for line in LINES], "line string")
    if form == "table":
        parsed = lines.parse_column(df, "line")
    else:
        parsed = df.select("line", F.get(lines.parse_array(F.array("line")), 0).alias("p")).select("line", "p.*")
    got = {r.line: (r.quantity, r.unit, r.name, r.preparation, r.is_valid) for r in parsed.collect()}
    assert got == LINES


def test_unit_spellings(spark):
    assert len(lines.unit_table()) == 92
    df = spark.createDataFrame([("1 teaspoon salt",)], "line string")
    assert lines.parse_column(df, "line", lines.unit_table(include_canonical=True)).first().unit == "teaspoon"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw, clean", [("Step 3: - Stir;", "Stir"), ("(2) Fold", "Fold"), ("2) Mix  it", "Mix it")])
def test_step_cleaning(spark, raw, clean):
    assert one(spark, raw, steps.clean_step) == clean


def test_step_facts(spark):
    sentence = "Bake at 350°F on medium-high heat for 25 minutes in the Oven"
    assert one(spark, sentence, steps.temperatures) == ["350°F", "medium", "high heat"]
    assert one(spark, sentence, steps.times) == ["25 minutes"]
    assert one(spark, sentence, steps.equipment) == ["oven"]
    assert one(spark, "slowly stir", steps.temperatures) == ["low"]
    assert one(spark, "slowly stir", lambda c: steps.temperatures(c, strict_words=True)) == []
    assert one(spark, "350 degrees for", steps.temperatures) == ["350 degrees f"]
    assert one(spark, "on low for", steps.temperatures) == ["low "]
    assert one(spark, "for about 5, until golden", steps.times) == ["for about 5", "until golden"]


def test_long_blocks_are_split(spark):
    sentence = "Stir the pot well and keep on stirring until it thickens nicely over the heat"
    block = ". ".join([sentence, "Ok", sentence, sentence]) + "."
    out = one(spark, block, lambda c: steps.process_instructions(F.array(c)))
    assert [s.text for s in out.steps] == [sentence + "."] * 3
    assert out.step_count == 3 and out.metadata.equipment == ["pot"]
    marked = f"{sentence}. Step 2: {sentence}. Step 3: {sentence}"
    assert one(spark, marked, lambda c: steps.step_texts(F.array(c))) == [sentence + ".", sentence + ".", sentence]
    assert one(spark, "Short. Text", lambda c: steps.step_texts(F.array(c))) == ["Short. Text"]


def test_instruction_status(spark):
    df = spark.createDataFrame([(1, []), (2, ["- "]), (3, ["Mix"]), (4, None)], "id int, i array<string>")
    out = df.withColumn("p", steps.process_instructions(F.col("i")))
    out = out.select("id", steps.instruction_status(F.col("i"), F.col("p.step_count")).alias("s"))
    assert {r.id: r.s for r in out.collect()} == {1: "no_instructions", 2: "failed", 3: "success", 4: "no_instructions"}


def test_text_cleaning(spark):
    assert one(spark, "&lt;b&gt;Hi&lt;/b&gt; &amp; bye  Jump to Recipe", text.clean_text) == "Hi & bye"
    assert one(spark, "Home » Soup &#233;&nbsp;Expand ", text.clean_text) == "Soup é"
    assert one(spark, "Search", text.clean_text) == ""
    assert one(spark, "Step 1: Mix. Step 2: Bake.", text.split_steps) == ["Mix.", "Bake."]
    assert one(spark, "1. A 2. B", text.split_steps) == ["A", "B"]
    assert one(spark, "1) A 2) B", text.split_steps) == ["A", "B"]
    assert one(spark, "Just mix", text.split_steps) == ["Just mix"]


@pytest.mark.parametrize("cell, minutes", [
    ("PT1H30M", 90), ("PT45S", 0), ("P1D", 0), ("PT25M", 25), ("PT2H", 120), ("PT1.5H", 0), (None, 0), ("nan", 0),
])
def test_durations(spark, cell, minutes):
    assert one(spark, cell, cells.iso_minutes) == minutes


@pytest.mark.parametrize("cell, count", [("4.7", 4), ("four", 0), (None, 0), ("inf", 0), ("NaN", 0), ("6", 6)])
def test_servings(spark, cell, count):
    assert one(spark, cell, cells.servings) == count


def test_categories_and_amounts(spark):
    assert one(spark, " main DISH, ,soup", cells.category_list) == ["Main dish", "Soup"]
    assert one(spark, None, cells.category_list) == []
    df = spark.createDataFrame([(2.0, "cup", "chopped"), (None, "", "diced"), (0.5, "", "")], "q double, u string, p string")
    got = [r.a for r in df.select(cells.amount_text(cells.number_text(F.col("q")), F.col("u"), F.col("p")).alias("a")).collect()]
    assert got == ["2 cup chopped", "diced", "0.5"]
    assert one(spark, '["a","b"]', cells.json_strings) == ["a", "b"]
    assert one(spark, "{bad", cells.json_strings) == []


def test_phrases(spark):
    assert one(spark, " Half-Baked  Pie(s)! ", text.normal_phrase) == "half baked pie s"
    assert one(spark, "  Mango\tSA ", text.normal_query) == "mango sa"


def test_stopword_lists():
    assert len(fixed.ENGLISH_STOPWORDS) == len(set(fixed.ENGLISH_STOPWORDS)) == 179
    assert len(fixed.UNIT_STOPWORDS) == len(set(fixed.UNIT_STOPWORDS)) == 23
