import pytest

DOCS = "doc_id long, text string, lang string, source string, score string, kept string, id string, gone string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (id, text[, lang, source]) with further columns whose names clash with those of operators."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", "x", "y", "z", "w") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


ODD = [(1, "plain text of a few words"), (1, "plain text of a few words"), (None, "no id at all here"), (2, None), (3, ""), (4, " \n\t "), (5, "long " * 30_000)]


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, repeated rows."""
    return make(ODD)
