from __future__ import annotations

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Makes a table of documents from texts; ids count from 0 unless given."""

    def make(texts, ids=None, lang="en", source="src1"):
        rows = [(i if ids is None else ids[i], t, lang, source, len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC)

    return make

