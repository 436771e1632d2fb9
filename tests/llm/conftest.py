import pytest
from .llm_samples import AWKWARD, CLASHING, SCHEMA


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with clashing extra columns from (doc_id, text) or (doc_id, text, lang) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) + ("x",) * len(CLASHING) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def awkward(make):
    return make(AWKWARD)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
