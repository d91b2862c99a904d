import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestar.session import build_session

    session = build_session(
        "tests", "local[8]", shuffle_partitions=4,
        extra={"spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")), "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
