import pytest

from plumbline.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g", partitions=4)
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield ship(session)
    session.stop()
