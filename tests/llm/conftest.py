from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents of the given texts, with ids from 0."""

    def make(texts, ids=None):
        return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "src1", None) for i, t in enumerate(texts)], DOCS)

    return make
