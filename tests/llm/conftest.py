"""Brute-force helpers for the operators' tests."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    def make(texts, sources=None):
        rows = [(i, t, "en", (sources or {}).get(i, f"src{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make
