import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from terrapanel.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "6", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        # partitions are left apart so that groups really do span several of them
        "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def values():
    """Rows of a frame as sorted tuples."""
    return lambda df, *cols: sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is None, x) for x in r))
