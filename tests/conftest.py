import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparkloom.session import build_session

    home = tmp_path_factory.mktemp("spark")
    s = build_session("local[8]", "tests", spark__sql__shuffle__partitions="8", spark__sql__warehouse__dir=str(home / "warehouse"), spark__local__dir=str(home / "local"), spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
