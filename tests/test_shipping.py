"""Worker-side functions have to run on executors where the package is not installed."""

import base64
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from quern.functions import text, words
from quern.operators import harvest

RUN = """
import base64, sys
import pyarrow as pa
from pyspark import cloudpickle
function = cloudpickle.loads(base64.b64decode(sys.stdin.read()))
print(function(pa.array(eval(sys.argv[1]))).to_pylist())
assert not any(name.startswith("quern.operators") for name in sys.modules)
"""


@pytest.mark.parametrize("function, value, shown", [
    (text._stem_lists.func, '[["tomatoes"]]', "[['tomato']]"),
    (text.stem_word.func, '["pies"]', "['pie']"),
    (text.stem_phrase.func, '["red pies"]', "['red pie']"),
    (text._unescape_lists.func, '[["&amp;"]]', "[['&']]"),
    (harvest._microdata_json.func, '["<p>", None]', "['[]', None]"),
])
def test_function_loads_without_the_package(function, value, shown):
    packed = base64.b64encode(cloudpickle.dumps(function)).decode()
    done = subprocess.run([sys.executable, "-c", RUN, value], input=packed, capture_output=True, text=True, cwd="/")
    assert done.stdout.strip() == shown, done.stderr


def test_form_finder_is_shipped_by_value():
    assert cloudpickle.loads(cloudpickle.dumps(words.form_finder)) is not words.form_finder
