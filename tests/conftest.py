import os
import time

import pytest

os.environ["TZ"] = "UTC"
time.tzset()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from stratiform.session import build_session

    where = tmp_path_factory.mktemp("shared")
    s = build_session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_checkpoint_dir=f"file://{where}", spark_driver_memory="4g", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def store(spark, tmp_path):
    from stratiform.plans.store import TableStore

    return TableStore(spark, f"file://{tmp_path}/store")


@pytest.fixture
def rows():
    """Sorted tuples of a frame."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=str)
