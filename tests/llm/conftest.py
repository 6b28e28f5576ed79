from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang)."""
    def made(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0",
                 len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)
    return made
