import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cantoria.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, extra={"spark.driver.memory": "6g"})
    # tests run without a cluster: the checkpoint folder is unset there, so take a scratch one
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cantoria-test-"))
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"
