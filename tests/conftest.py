import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import local_session, ship_package

    s = local_session("tests", 4, 4)
    ship_package(s)
    yield s


@pytest.fixture()
def ws(spark):
    from loomgraph.operators.workspace import Workspace

    return Workspace(spark, "test")
