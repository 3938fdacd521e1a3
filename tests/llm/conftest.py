from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from cases import corpus, frame  # noqa: E402


@pytest.fixture(scope="session")
def docs():
    return corpus()


@pytest.fixture(scope="session")
def table(spark, docs):
    return frame(spark, docs, clash=True).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [], clash=True)
