import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TRIALWEAVE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from trialweave.session import local_session

    session = local_session(8, app="trialweave-tests", **{"spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
