import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from quillon.session import get_spark

    return get_spark(master="local[4]", app="tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
