import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tenure.session import prepare, session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    built = session(
        "local[8]",
        4,
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.maxMetadataStringLength": "5000",
            "spark.sql.debug.maxToStringFields": "500",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    built.sparkContext.setLogLevel("ERROR")
    return prepare(built)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
