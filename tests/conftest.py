import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from kairoframe.session import session

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    made = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
