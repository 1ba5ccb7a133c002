from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of documents from (doc_id, text) pairs, other columns null."""

    def make(rows, schema=DOCS):
        return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)

    return make


@pytest.fixture
def clashing(spark):
    """The same with extra columns that have the operators' own names."""

    def make(rows):
        extra = "digest string, keep_id string, kept string, start string, length string, base string, tokens string, fp string, score string, ids string, n_words string"
        return spark.createDataFrame([(i, t, None, None, None, *["x"] * 11) for i, t in rows], f"{DOCS}, {extra}")

    return make
