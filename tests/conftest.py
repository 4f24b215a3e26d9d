import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tarnish.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "4")


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def toy(spark):
    """Twenty rows: a number, two categories, a key."""
    rows = [(i, i / 20, "abc"[i * 7 % 3], ("foo", "bah")[i * 5 % 2]) for i in range(20)]
    return spark.createDataFrame(rows, "id int, A double, B string, C string").cache()
