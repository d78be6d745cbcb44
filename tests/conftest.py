import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from attesta.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("tests", "4")


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column expression on one row of string columns."""
    def run(expr, **cols):
        df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
        return df.select(expr.alias("v")).collect()[0]["v"]
    return run
