import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sieveline.session import get_session
    ckpt = tempfile.mkdtemp(prefix="sieveline-test-ckpt-")
    s = get_session("local[4]", app="sieveline-tests", shuffle_partitions=4,
                    extra={"spark.driver.memory": "4g", "spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="sieveline-test-")
