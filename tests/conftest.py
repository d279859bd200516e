import pathlib
import sys
import tempfile

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from waymark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "waymark-tests", tempfile.mkdtemp(prefix="waymark-tests-"))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
