import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def series(spark):
    """Observations from Python values: series(values) or series(labels=...)."""
    from patternfold.schema import OBS

    def make(values=None, labels=None, key="all"):
        n = len(values if values is not None else labels)
        rows = [(key, i, None if values is None or values[i] is None else float(values[i]), None, None if labels is None else labels[i], None, None) for i in range(n)]
        return spark.createDataFrame(rows, OBS)

    return make
