import numpy as np
import pandas as pd
import pytest

from barloom import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("barloom-tests", 8, spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars_pdf():
    """Three random-walk series of different lengths with gaps in the dates."""
    rng = np.random.default_rng(42)
    parts = []
    for name, n in (("A", 900), ("B", 400), ("C", 120)):
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        open_ = close + rng.normal(0, 0.5, n)
        days = pd.Timestamp("2018-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 4, n)), "D")
        parts.append(
            pd.DataFrame(
                {
                    "series_id": name, "bar_date": days.date, "open": open_, "high": np.maximum(open_, close) + rng.random(n),
                    "low": np.minimum(open_, close) - rng.random(n), "close": close, "volume": rng.integers(100, 1000, n).astype(float),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    from barloom.schemas import BARS
    from barloom.session import cut_lineage

    return cut_lineage(spark.createDataFrame(bars_pdf, BARS).repartition(4))
