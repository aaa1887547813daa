import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYTHONPATH", ROOT)


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import build_session, checkpoint_root
    s = build_session("local[4]", app="quillspark-tests", shuffle_partitions=4)
    # spark.checkpoint.dir is unset in tests: use a scratch folder of our own
    checkpoint_root(s, fallback=tempfile.mkdtemp(prefix="qs-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="qs-test-")
