import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from editforge.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", 8, app="editforge-tests")
    checkpoint_dir(s)   # sets a private folder only when the session names none
    yield s
    s.stop()
