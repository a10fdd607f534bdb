import pytest

from panelrisk.llm.common import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)
