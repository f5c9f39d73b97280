import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from clearroll import build_session

    session = build_session("tests", "local[8]", 8, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture
def one(spark):
    """Evaluate Columns over a one-row frame and return the values."""

    def evaluate(*columns, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
        found = row.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0]
        return found[0] if len(columns) == 1 else tuple(found)

    return evaluate
