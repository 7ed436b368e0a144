from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from zonecast.session import local_session, ship_package

    spark = local_session(8, "zonecast-tests")
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    yield spark
    spark.stop()
