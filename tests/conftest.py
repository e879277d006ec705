import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from mailsift.session import get_spark
    s = get_spark("local[8]", 8, app_name="mailsift-tests")
    yield s


def one_col(spark, values, fn, name="x"):
    """Apply a Column->Column function to a list of strings, return the results in order."""
    from pyspark.sql import functions as F
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col(name))).collect()]
