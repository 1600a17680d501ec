import pytest

from graphloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared")),
        "spark.driver.memory": "3g",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
