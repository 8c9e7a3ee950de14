import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from headway.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("headway-tests", "4", "4")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def value(spark):
    """Evaluate a column expression over literal inputs."""
    def run(expr, **cols):
        from pyspark.sql import functions as F
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
        return row.select(expr.alias("x")).first()["x"]
    return run
