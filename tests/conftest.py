import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TECTRA_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tectra.session import session

    s = session("tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def normal(frame):
    """Rows as sorted texts, columns by name."""
    import numpy as np
    import pandas as pd

    def one(v):
        if isinstance(v, (list, np.ndarray)):
            return str([one(x) for x in v])
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.9g}" if isinstance(v, (float, np.floating)) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted("|".join(map(one, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def at(sf):
        c = duckdb.connect()
        c.execute("SET timezone = 'UTC'")
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{sf}/{t}.parquet')")
        return c

    return at
