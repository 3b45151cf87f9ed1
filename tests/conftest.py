import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TIDEGAUGE_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from tidegauge.session import get_session, ship_package

    session = get_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    ship_package(session)
    yield session
    session.stop()
