import pytest

from glossweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="3g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
