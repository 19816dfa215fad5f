import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from adlytics.session import BASE_CONF, ensure_checkpoint_dir
    b = SparkSession.builder.master("local[4]").appName("adlytics-tests")
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", "8")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="adlytics-test-ckpt-"))
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def queries():
    from adlytics.plans.registry import all_queries
    return all_queries()
