"""Rows that every text operator must bear."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, norm string, fp long, kept string, score string, size string"


@pytest.fixture()
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names."""

    def make(rows):
        return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", "y", 7, "z", "s", "w") for i, t, la, s in rows], SCHEMA)

    return make


ODD = [
    (1, "The same text.", "en", "a"), (2, "the SAME text.", "en", "b"), (3, None, None, None), (4, "", "fr", "a"), (5, " \n\t ", "fr", None),
    (6, "The same text.", "en", "a"), (6, "The same text.", "en", "a"), (7, "x " * 60_000, "de", "b"), (None, "no identifier here", "es", "c"), (None, "the same text.", "es", "c"), (8, "Ünïcode ßtraße 日本語 🙂 \x00 \r\n<|im_end|>", None, ""),
]


@pytest.fixture()
def odd(odd_docs):
    return odd_docs(ODD)


@pytest.fixture()
def none(odd_docs):
    return odd_docs(ODD).limit(0)
