import pytest

from marginalia.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g", partitions=2)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()
