import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]


@pytest.fixture(scope="session")
def spark():
    from compare import session

    s = session("4")
    from ledgerline.sources.shared import ship_package

    ship_package(s)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s
