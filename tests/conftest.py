import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import duck, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    return duck("/root/testdata/sf0.01")


@pytest.fixture
def small_tasks(spark):
    """Force the paths that large data takes."""
    from oddrows.operators import neighbors

    keep = neighbors.TILE_ROWS
    spark.conf.set("spark.oddrows.taskRows", "200")
    spark.conf.set("spark.oddrows.broadcastRows", "20")
    neighbors.TILE_ROWS = 64
    yield
    neighbors.TILE_ROWS = keep
    spark.conf.unset("spark.oddrows.taskRows")
    spark.conf.unset("spark.oddrows.broadcastRows")
