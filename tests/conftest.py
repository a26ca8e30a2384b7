import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
os.environ["TZ"] = "UTC"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from polyframe.session import session

    base = tmp_path_factory.mktemp("spark")
    made = session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(base / "shared"),
        spark__sql__warehouse__dir=str(base / "warehouse"),
    )
    made.sparkContext.setLogLevel("OFF")
    yield made
    made.stop()


@pytest.fixture
def employees(spark):
    rows = [(1, "Jack", "Shephard", 37, 1), (2, "John", "Locke", 65, 1), (3, "Kate", "Austen", 37, 2), (4, "Claire", "Littleton", 27, 2), (5, "Hugo", "Reyes", 29, 100)]
    return spark.createDataFrame(rows, "employee_id int, fname string, lname string, age int, store_id int")


@pytest.fixture
def stores(spark):
    return spark.createDataFrame([(1, "Hydra", 1, 37), (2, "Arrow", 2, 2000)], "store_id int, store_name string, district_id int, num_sales int")
