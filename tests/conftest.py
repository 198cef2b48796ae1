import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from tidemill.session import SETTINGS  # noqa: E402

SF = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[8]").config(map=SETTINGS | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.ui.enabled": "false"}).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
