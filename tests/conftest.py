"""One session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session

    s = build_session("tests", cores=8, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.ansi.enabled", "true")
    yield s


@pytest.fixture(scope="session")
def folder():
    if not DATA.exists():
        pytest.skip("the test tables aren't here")
    return str(DATA)
