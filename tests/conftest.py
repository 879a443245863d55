import pytest

from siltstone.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("shared")
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(work), "spark.driver.memory": "2g"})
    session.sparkContext.setLogLevel("ERROR")
    return session
