import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("SPARK_LOCAL_DIRS", tempfile.mkdtemp(prefix="spark-"))


@pytest.fixture(scope="session")
def spark():
    from pulsefield.session import expose_package, get_spark

    session = get_spark(4, "tests", partitions=4, memory="4g")
    expose_package(session)
    yield session
    session.stop()
