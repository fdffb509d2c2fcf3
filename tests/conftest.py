import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from spendcode.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8, app_name="spendcode-tests")
    yield s


@pytest.fixture
def tmp_shared(spark, tmp_path_factory):
    """A fresh folder under the session's checkpoint directory."""
    import uuid
    from spendcode.session import shared_dir
    return shared_dir(spark, f"test-{uuid.uuid4().hex[:8]}")
