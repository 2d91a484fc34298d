import pytest

from awardlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
