import pytest

from curbline.plans.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("curbline-tests", "local[4]", 4)
