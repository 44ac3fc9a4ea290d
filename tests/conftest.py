import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from inkwell.operators import groups  # noqa: E402
from inkwell.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_limits(monkeypatch):
    """Every group of more than two rows is heavy and is cut into blocks of four."""
    monkeypatch.setattr(groups, "HEAVY_FLOOR", 2)
    monkeypatch.setattr(groups, "BLOCK_SPAN", 4)


@pytest.fixture
def column(spark):
    """Apply a column function to values; ``column(fn, [v, …])`` gives the results in order."""

    def apply(function, values, kind="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
        return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]

    return apply
