import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hopmeter.plans.stages import close_tables  # noqa: E402
from hopmeter.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "hopmeter-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="hopmeter-tests-"))
    yield session
    close_tables(session)
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of plain tuples."""
    return lambda df, *names: sorted(
        (tuple(r) for r in (df.select(*names) if names else df).collect()),
        key=lambda r: tuple((x is None, x if x is not None else 0) for x in r),
    )
