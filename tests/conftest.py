import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexigrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "4g")
    yield session
    session.stop()


@pytest.fixture
def docs(spark):
    """A small labelled corpus with an uneven label."""
    rows = [
        (i, ("good fine nice " if i % 3 else "bad awful nice ") * (1 + i % 4) + f"w{i % 5}", "pos" if i % 3 else "neg")
        for i in range(40)
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label string")
