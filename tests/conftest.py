import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "10g", **{"spark.sql.shuffle.partitions": "4", "tabspark.fit.shards": "4"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def _people(rows=240):
    """Visits to a shop; who buys follows from the minutes spent and the channel."""
    rng = np.random.default_rng(7)
    minutes, spend = rng.gamma(2.0, 12.0, rows).round(1), rng.normal(60, 15, rows).round(2)
    channel, member = rng.choice(["web", "store", "phone"], rows, p=[0.5, 0.3, 0.2]), rng.choice(["yes", "no"], rows)
    return pd.DataFrame({"minutes": minutes, "spend": spend, "channel": channel, "member": member,
                         "target": ((minutes > 20) ^ (channel == "phone")).astype(int)})


def _flats(rows=240):
    """Rents that grow with the surface and the storey, and differ by quarter."""
    rng = np.random.default_rng(11)
    beds, surface, storey = rng.integers(1, 5, rows), rng.normal(70, 20, rows).round(1), rng.integers(0, 9, rows)
    quarter = rng.choice(["harbour", "hill", "old town"], rows)
    rent = 300 + 9.5 * surface + 20 * storey + np.where(quarter == "hill", 150, 0) + rng.normal(0, 30, rows)
    return pd.DataFrame({"beds": beds, "surface": surface, "storey": storey, "quarter": quarter, "price": rent.round(2)})


@pytest.fixture(scope="session")
def clf_df(spark):
    return spark.createDataFrame(_people()).persist()


@pytest.fixture(scope="session")
def reg_df(spark):
    return spark.createDataFrame(_flats()).persist()


@pytest.fixture(scope="session")
def clf_df_with_nan(spark):
    """Every eighth target is missing, in a nullable whole-number column."""
    rows = [(*r[:4], None if i % 8 == 0 else int(r[4])) for i, r in enumerate(_people().itertuples(index=False, name=None))]
    return spark.createDataFrame(rows, "minutes double, spend double, channel string, member string, target bigint").persist()
