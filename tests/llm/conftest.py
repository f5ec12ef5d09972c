from __future__ import annotations

import pytest

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def docs_frame(spark):
    """Documents from (doc_id, text[, lang[, source]]) with columns whose names clash with those of results."""

    def make(*rows):
        full = [(*r, *(None,) * (4 - len(r)), "clash", "clash", "clash") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, size string, fp string, node string")

    return make
