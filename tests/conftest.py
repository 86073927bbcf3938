import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from calllens.session import configure  # noqa: E402

SMALL = "/root/testdata/sf0.001"


# Started on import: columns can only be built once a session exists, and the test
# modules hold some at the top level.
SESSION = configure(
    SparkSession.builder.master("local[8]")
    .appName("tests")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.driver.memory", "8g")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
).getOrCreate()
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def small():
    return SMALL
