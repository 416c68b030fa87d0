from __future__ import annotations

import pytest

from lodestream.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def rows():
    """The rows of a DataFrame as a sorted list of tuples."""

    def get(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return get
