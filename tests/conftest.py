import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tasklane.session import build_session
    s = build_session("local[4]", app="tasklane-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir":
                             tempfile.mkdtemp(prefix="tasklane-test-ckpt-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_out():
    return tempfile.mkdtemp(prefix="tasklane-test-")
