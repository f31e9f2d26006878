import pytest

from quillmesh.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g", **{"spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield s
    s.stop()
