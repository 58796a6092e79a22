import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from postresp.session import get_spark
    s = get_spark("local[4]", 8)
    # tests only: the shared checkpoint folder is unset locally
    from postresp.session import checkpoint_dir
    checkpoint_dir(s, str(tmp_path_factory.mktemp("ckpt")))
    yield s
