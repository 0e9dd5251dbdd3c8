from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from homologrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    # Many tiny jobs: fewer, fuller partitions.
    session.conf.set("spark.sql.shuffle.partitions", "3")
    yield session
    session.stop()


def as_dict(df, key, value):
    return {row[key]: row[value] for row in df.collect()}
