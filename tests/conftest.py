import os

import pytest

os.environ.setdefault("PYSPARK_PIN_THREAD", "true")


@pytest.fixture(scope="session")
def spark():
    from relweave.session import local_session

    s = local_session(4, spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
