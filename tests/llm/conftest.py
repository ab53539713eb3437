from __future__ import annotations

import pytest
from llm_helpers import SCHEMA, prose, rows_of


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    long = prose(1, 60_000)
    rows = rows_of(["", None, " \n\t ", "one", "one two three", prose(2, 300), prose(2, 300), long, "á ü 漢字 \U0001F600 word"])
    rows += [(None, prose(3, 80), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [rows[5], rows[0]]  # repeated rows
    rows += [(5, "other text of a repeated id " * 5, "fr", "src1", 1, "p", "k", 1, "g")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_benchmark(spark):
    return spark.createDataFrame([], "item_id long, text string")
