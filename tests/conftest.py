import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tideline.session import local_session

    return local_session(4, 4, **{"spark.driver.memory": "4g", "spark.sql.execution.arrow.maxRecordsPerBatch": "64"})


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
