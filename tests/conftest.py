import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spendspark.session import configure

    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
               .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-")).getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def claims(spark):
    from spendspark.plans.fixtures import Claims

    return Claims(spark, SMALL)


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)
