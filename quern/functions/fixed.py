"""Word lists, lookup tables and patterns that decide the results."""

# --- Unicode blanks -----------------------------------------------------------------------------
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- CSV cells that mean "missing" -----------------------------------------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- Page furniture removed from extracted text, in this order --------------------------------
NAVIGATION_PATTERNS = [
    r"Skip to content",
    r"Toggle Menu",
    r"Follow me on \w+!",
    r"Jump to Recipe",
    r"Print Recipe",
    r"Home\s*[»\|>]\s*",
    r"Expand\s*$",
    r"^Search\s*$",
    r"^About\s*$",
    r"^Contact\s*$",
    r"^Privacy Policy\s*$",
]

# --- Step numbering inside one instruction string, tried in this order --------------------------
STEP_SPLIT_PATTERNS = [
    r"(?<!\w)step\s*\d+\s*[:\-]\s*",
    r"(?<!\d)\d+\.\s+",
    r"(?<!\d)\d+\)\s+",
]

# --- Quantity lines ----------------------------------------------------------------------------
UNICODE_FRACTIONS = {
    "½": 0.5,
    "⅓": 1 / 3,
    "⅔": 2 / 3,
    "¼": 0.25,
    "¾": 0.75,
    "⅛": 0.125,
    "⅜": 0.375,
    "⅝": 0.625,
    "⅞": 0.875,
}

# Spellings that are recognised, by the unit they stand for.  Size words stand for no unit.
UNIT_SPELLINGS = {
    "tsp": "teaspoon",
    "tsp.": "teaspoon",
    "teaspoons": "teaspoon",
    "tbsp": "tablespoon",
    "tbsp.": "tablespoon",
    "tbs": "tablespoon",
    "tbs.": "tablespoon",
    "tablespoons": "tablespoon",
    "c": "cup",
    "c.": "cup",
    "cup": "cup",
    "cups": "cup",
    "fl oz": "fluid_ounce",
    "fl. oz": "fluid_ounce",
    "fluid ounces": "fluid_ounce",
    "pt": "pint",
    "pt.": "pint",
    "pints": "pint",
    "qt": "quart",
    "qt.": "quart",
    "quarts": "quart",
    "gal": "gallon",
    "gal.": "gallon",
    "gallons": "gallon",
    "ml": "milliliter",
    "ml.": "milliliter",
    "milliliters": "milliliter",
    "millilitres": "milliliter",
    "l": "liter",
    "l.": "liter",
    "liters": "liter",
    "litres": "liter",
    "oz": "ounce",
    "oz.": "ounce",
    "ounces": "ounce",
    "lb": "pound",
    "lb.": "pound",
    "lbs": "pound",
    "lbs.": "pound",
    "pounds": "pound",
    "g": "gram",
    "g.": "gram",
    "grams": "gram",
    "gm": "gram",
    "gm.": "gram",
    "kg": "kilogram",
    "kg.": "kilogram",
    "kilograms": "kilogram",
    "kilogrammes": "kilogram",
    "whole": "",
    "wholes": "",
    "large": "",
    "medium": "",
    "small": "",
    "pkg": "package",
    "pkg.": "package",
    "pkgs": "package",
    "packages": "package",
    "can": "can",
    "cans": "can",
    "jar": "jar",
    "jars": "jar",
    "bottle": "bottle",
    "bottles": "bottle",
    "slice": "slice",
    "slices": "slice",
    "piece": "piece",
    "pieces": "piece",
    "pinch": "pinch",
    "pinches": "pinch",
    "dash": "dash",
    "dashes": "dash",
    "handful": "handful",
    "handfuls": "handful",
    "bunch": "bunch",
    "bunches": "bunch",
    "clove": "clove",
    "cloves": "clove",
    "stalk": "stalk",
    "stalks": "stalk",
    "sprig": "sprig",
    "sprigs": "sprig",
    "strip": "strip",
    "strips": "strip",
    "stick": "stick",
    "sticks": "stick",
    "cube": "cube",
    "cubes": "cube",
    "envelope": "envelope",
    "envelopes": "envelope",
    "sheet": "sheet",
    "sheets": "sheet",
}

# Canonical singulars that are no spelling of their own unless the caller asks for them.
CANONICAL_SINGULARS = [
    "teaspoon", "tablespoon", "fluid ounce", "pint", "quart", "gallon", "milliliter", "liter",
    "ounce", "pound", "gram", "kilogram", "package",
]

PREPARATION_KEYWORDS = [
    "beaten", "chopped", "diced", "minced", "sliced", "grated", "shredded", "crushed", "mashed",
    "peeled", "seeded", "cored", "halved", "quartered", "julienned", "cubed", "dried", "fresh",
    "frozen", "canned", "roasted", "toasted", "fried", "sauteed", "steamed", "boiled", "baked",
    "grilled", "smoked", "cooked", "uncooked", "raw", "ripe", "unripe", "softened", "melted",
    "soft", "firm", "finely", "coarsely", "roughly", "thinly", "thickly", "diagonally",
    "crosswise", "lengthwise", "drained", "rinsed", "washed", "cleaned", "trimmed", "boneless",
    "skinless", "bone-in", "skin-on", "pitted", "zested", "juiced", "quartered", "sectioned",
    "separated", "divided", "room temperature", "cold", "warm", "hot", "optional", "or",
]

# --- Instruction steps ---------------------------------------------------------------------------
STEP_PREFIX_PATTERNS = [
    r"^step\s*\d+[:.)\-]*\s*",
    r"^\d+[:.)\-]+\s*",
    r"^\(\d+\)\s*",
]
BLOCK_STEP_PATTERN = r"(?:Step\s*\d+[:.)\-]*)|(?:^\d+[:.)\-]+)"
SENTENCE_BREAK_PATTERN = r"(?<=\.)\s+(?=[A-Z])"
LONG_BLOCK_CHARS = 200
SHORT_STEP_CHARS = 10

TEMPERATURE_PATTERN = (
    r"(\d+)\s*°\s*(F|C|f|c)|"
    r"(\d+)\s*(degrees?|deg)\s*(Fahrenheit|Celsius|f|c)?|"
    r"(low|medium|high|medium-low|medium-high)\s*(heat)?"
)
TIME_PATTERN = (
    r"(\d+)\s*(minutes?|mins?|hours?|hrs?|seconds?|secs?)|"
    r"(a few minutes|several minutes|overnight)|"
    r"(until \w+|for about \d+)"
)
EQUIPMENT_PATTERN = (
    r"\b(oven|stove|microwave|blender|food processor|mixing bowl|"
    r"baking sheet|pan|skillet|pot|dutch oven|slow cooker|instant pot|"
    r"air fryer|grill|griddle|wok|saucepan|frying pan|cookie sheet|"
    r"casserole dish|roasting pan|pressure cooker|rice cooker|"
    r"whisk|spatula|wooden spoon|ladle|tongs|knife|cutting board|"
    r"measuring cup|measuring spoon|colander|strainer|sieve|"
    r"rolling pin|pastry brush|grater|peeler|knife|mandoline)\b"
)

# --- Text normalisation ------------------------------------------------------------------------
# The public English stopword list of the natural language toolkit.
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

UNIT_STOPWORDS = [
    "cup", "cups", "tablespoon", "tablespoons", "teaspoon", "teaspoons", "tbsp", "tsp", "lb", "lbs", "oz",
    "ounce", "ounces", "g", "gram", "grams", "ml", "liter", "liters", "pound", "pounds", "inch", "inches",
]

MIN_TOKEN_LENGTH = 3

# --- Catalog ------------------------------------------------------------------------------------
LISTING_COLUMNS = [
    "recipe_id", "title", "image", "preparationMinutes", "cookingMinutes", "healthScore",
    "calories", "protein", "fat", "carbs", "dietary_tags", "instructions",
]
NO_SOURCE_URL = "No instructions provided"

# Fixed values of the public treebank conventions: characters and runs that are tokens by themselves, endings that are
# split from their word, and words that are split in two.
TREEBANK_MARKS = r"[;@#$%&?!*\[\](){}<>«»“”‘’„\"]|`+|''|--|\.{2,}"
TREEBANK_ENDINGS = ("'ll", "'re", "'ve", "'s", "'m", "'d", "n't", "'")
TREEBANK_PAIRS = (
    ("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n"), ("wan", "na"),
    ("'t", "is"), ("'t", "was"),
)
# Abbreviations whose period ends no sentence.
ABBREVIATIONS = (
    "approx", "assn", "co", "corp", "dr", "e.g", "etc", "fig", "fl", "ft", "gal", "i.e", "inc", "jr", "lb", "lbs", "ltd", "mr", "mrs", "ms",
    "no", "oz", "pkg", "prof", "pt", "qt", "sr", "st", "tbsp", "temp", "tsp", "vol", "vs",
)
