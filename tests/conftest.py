import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from wayring.session import build_session

    session = build_session("tests", "local[4]", spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_sql_shuffle_partitions="4", spark_driver_memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
