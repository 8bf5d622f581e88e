import pytest

LONG = "lorem ipsum dolor sit amet consectetur " * 4000


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs, empty and very long texts, ties, repeated rows, odd characters."""
    texts = [
        None, "", " \t\n", LONG, LONG + "end", "A.", "12345", "…", "the cat sat on the mat and the dog ran", "the cat sat on the mat and the dog ran",
        "\U0001f600 é ü ▁ \x00", "el perro corre por la calle y el gato duerme", "x" * 5000,
    ]
    rows = [(at, text, "en" if at % 2 else None, None if at % 3 == 0 else "src0", None) for at, text in enumerate(texts)]
    return rows + [rows[8], rows[8], (None, "a row without an id", "en", "src1", 3)]


# Names that the operators use inside.
EXTRA = ["id", "score", "base", "text_key", "band", "x", "root"]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{name} string" for name in EXTRA)
    return spark.createDataFrame([(*row, *EXTRA) for row in odd_rows], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
