"""Small tables with the awkward rows that every operator must take."""

import pytest

from tests_llm_rows import CLASHING, awkward_rows


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with awkward rows, and columns named like the operators' own."""
    rows = [(i, t, lang, source, len(t) if t is not None else None) + ("v",) * len(CLASHING)
            for i, t, lang, source in awkward_rows()]
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(
        rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture()
def folder(spark, tmp_path):
    """Write tables to a folder as the queries read them."""
    def write(**tables):
        for name, frame in tables.items():
            frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
