import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from tests_llm_helpers import corpus, frame  # noqa: E402

@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
