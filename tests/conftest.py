import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from domora.session import local_session, ship

    session = local_session("4", 4, "3g")
    ship(session)
    yield session
