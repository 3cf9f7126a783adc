import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    ck = tempfile.mkdtemp(prefix="pagemill-test-ckpt-")
    s = local_session(cores="*", shuffle_partitions=8, app="pagemill-tests",
                      extra={"spark.checkpoint.dir": ck})
    s.sparkContext.setCheckpointDir(ck)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="pagemill-test-")
