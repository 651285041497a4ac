import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netloom.operators import common as C
from netloom.schema import COLUMNS, Network


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("netloom-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield C.configure(session)


@pytest.fixture(scope="session")
def make_network(spark):
    def build(**tables) -> Network:
        """A network from lists of dicts; absent columns are NULL, absent tables empty."""
        frames = {}
        for name, cols in COLUMNS.items():
            rows = [tuple(r.get(c) for c, _ in cols) for r in tables.get(name, [])]
            frames[name] = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in cols))
        return Network(**frames)

    return build


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
