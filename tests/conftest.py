import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def skewed(spark):
    """A third of all rows share one value and one group; ties, a null and a NaN elsewhere."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    n = 6000
    x = rng.normal(100, 20, n).round(1)
    x[: n // 3] = 77.7
    group = np.where(np.arange(n) % 10 < 4, "a", np.where(np.arange(n) % 10 < 7, "b", "c"))
    frame = pd.DataFrame({
        "id": np.arange(n), "x": x, "y": x * 0.3 + rng.normal(0, 10, n), "z": rng.integers(0, 5, n).astype(float),
        "group": group, "half": np.where(rng.random(n) < 0.5, "l", "r"),
    })
    frame = frame.sample(frac=1, random_state=1).reset_index(drop=True)
    return frame, spark.createDataFrame(frame).repartition(6)
