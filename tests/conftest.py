import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lattica.session import session

    folder = tmp_path_factory.mktemp("shared")
    s = session("tests", "local[2]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.checkpoint.dir": f"file://{folder}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
