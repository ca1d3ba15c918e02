import os

import pytest

os.environ.setdefault("PYSPARK_PYTHON", "python")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quern.session import session

    base = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(base / "checkpoints"), "spark.sql.warehouse.dir": str(base / "warehouse"), "spark.driver.memory": "3g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
