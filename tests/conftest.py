import pytest

from layerlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    spark = local_session("4", memory="4g", app="tests")
    yield spark
    spark.stop()
