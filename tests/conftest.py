import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate columns on a single row."""

    def run(*cols):
        row = spark.range(1).select(*cols).first()
        return row[0] if len(cols) == 1 else tuple(row)

    return run
