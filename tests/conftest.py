import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hireplane.session import local_session

    return local_session(4, shuffle_partitions=4)


@pytest.fixture
def rows(spark):
    """Values of one expression over a column of texts."""
    from pyspark.sql import functions as F

    def run(values, fn, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        out = df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
        return [r.r for r in out]

    return run
