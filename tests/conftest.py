import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gridsmith.session import local_session

    session = local_session("8")
    session.sparkContext.setLogLevel("OFF")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return session


@pytest.fixture
def read_cell(spark):
    """Apply a column function to a list of texts."""
    from pyspark.sql import functions as F

    def apply(fn, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
        return [r[1] for r in df.select("i", fn(F.col("c"))).orderBy("i").collect()]
    return apply
