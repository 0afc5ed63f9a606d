import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lectern.session import local_session

    return local_session(4, "tests")


@pytest.fixture(scope="session")
def lines_of(spark):
    """Line relation of documents given as lists of lines or as texts."""

    def make(*docs):
        rows = [(d, i, line) for d, doc in enumerate(docs, 1) for i, line in enumerate(doc.split("\n") if isinstance(doc, str) else doc, 1)]
        return spark.createDataFrame(rows, "doc_id long, line_no int, line string")

    return make
