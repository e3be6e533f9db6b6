import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tarifflow.session import build

    session = build(
        "tests",
        **{
            "spark.master": "local[*]",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.log.level": "ERROR",
        },
    )
    yield session
    session.stop()


SF_SMALL = "/root/testdata/sf0.001"
