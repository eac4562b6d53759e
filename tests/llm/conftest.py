import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents table from (doc_id, text, lang, source) rows, with a clashing extra column."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), "extra") for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, size string")

    return build
