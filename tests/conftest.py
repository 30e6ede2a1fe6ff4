import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from rxlake.session import build_session

    session = build_session(
        "tests",
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": 4,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.default.parallelism": 4,
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
