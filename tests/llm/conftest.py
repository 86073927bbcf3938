import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from cases import CLASHES, TABLES  # noqa: E402

@pytest.fixture(scope="session")
def odd(spark):
    """The edge cases with clashing extra columns."""
    df = spark.createDataFrame(TABLES["rows"], "doc_id bigint, text string, source string")
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
