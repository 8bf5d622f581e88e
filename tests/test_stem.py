import pyarrow as pa
import pytest

from quern.functions import words

# Samples of the published algorithm description and hand-reasoned cases.
STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign",
    "consist": "consist", "consistency": "consist", "consistently": "consist", "consolation": "consol",
    "consolatory": "consolatori", "consolidating": "consolid", "conspicuously": "conspicu", "constable": "constabl",
    "knackeries": "knackeri", "knaves": "knave", "kneaded": "knead", "kneeling": "kneel", "knotted": "knot",
    "knocker": "knocker", "knightly": "knight", "tomatoes": "tomato", "tomato": "tomato", "ties": "tie",
    "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "hopping": "hop", "hoping": "hope",
    "luxuriated": "luxuri", "cry": "cri", "by": "by", "say": "say", "generous": "generous", "communism": "communism",
    "relational": "relat", "rational": "ration", "sky": "sky", "skies": "sky", "news": "news", "innings": "inning",
    "proceeds": "proceed", "exceedingly": "exceed", "happily": "happili", "apologies": "apolog", "fluently": "fluentli",
    "agreed": "agre", "feed": "feed", "rolling": "roll", "controll": "control", "economy": "economi", "large": "larg",
    "adoption": "adopt", "opinion": "opinion", "hopefulness": "hope", "electricity": "electr", "baked": "bake",
    "youth": "youth", "boyish": "boyish", "enjoy": "enjoy", "analogous": "analog", "arsenal": "arsenal",
}


@pytest.mark.parametrize("word, expected", STEMS.items())
def test_stem(word, expected):
    assert words.stem(word) == expected


def test_list_batches_keep_their_shape():
    lists = pa.array([["tomatoes", None], None, [], ["pies", "tomatoes"]])
    assert words.map_word_lists(lists, words.stem).to_pylist() == [["tomato", None], None, [], ["pie", "tomato"]]
    assert words.map_word_lists(lists[2:], words.stem).to_pylist() == [[], ["pie", "tomato"]]


def test_unescape():
    assert words.unescape("&frac12; &#39;a&#x27; &amp;lt;") == "½ 'a' &lt;"
