import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from emberline.session import local_session

    return local_session(8, 4)


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples in the order of the given columns."""

    def take(df, *columns):
        columns = columns or df.columns
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((x is None, x) for x in t))

    return take
