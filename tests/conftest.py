import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from linkflow.session import get_session
    s = get_session("local[4]", 4, extra={
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="linkflow-test-ckpt-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
