import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from fixture_frame import FIXTURE_ROWS, raw_frame  # noqa: E402

from orderlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def raw(spark):
    """Two orders on three lines, one of them at a loss."""
    return raw_frame(spark, FIXTURE_ROWS)


@pytest.fixture()
def lines(spark, raw):
    from pyspark.sql import functions as F

    from orderlens.operators import clean
    from orderlens.operators.features import engineer_features

    cleaned = engineer_features(clean.clean_data(clean.clean_column_names(raw)))
    return cleaned.withColumn("line_seq", F.monotonically_increasing_id())
