import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


def make_bars(n_by_symbol: dict[str, int], seed: int = 7, timeframe: str = "1h") -> pd.DataFrame:
    """Random walk bars with gaps, flat stretches and bars without a range."""
    rng = np.random.default_rng(seed)
    out = []
    for symbol, n in n_by_symbol.items():
        step = rng.choice([1, 1, 1, 2, 5], n)
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(step), unit="h")
        close = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), 2)
        close[n // 3:n // 3 + 6] = close[n // 3]
        open_ = np.round(close * (1 + rng.normal(0, 0.01, n)), 2)
        high = np.round(np.maximum(open_, close) * (1 + rng.random(n) * 0.01), 2)
        low = np.round(np.minimum(open_, close) * (1 - rng.random(n) * 0.01), 2)
        flat = rng.random(n) < 0.05
        high[flat] = low[flat] = open_[flat] = close[flat]
        volume = np.round(rng.lognormal(3, 0.8, n), 0) + 1
        out.append(pd.DataFrame({"symbol": symbol, "timeframe": timeframe, "ts": ts, "open": open_, "high": high,
                                 "low": low, "close": close, "volume": volume}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="session")
def pbars():
    return make_bars({"A": 700, "B": 130, "C": 9})


@pytest.fixture(scope="session")
def bars(spark, pbars):
    df = spark.createDataFrame(pbars).withColumn("ts", __import__("pyspark.sql.functions").sql.functions.col("ts").cast("timestamp_ntz"))
    return df.cache()


def rows(df, keys=("symbol", "timeframe", "ts")) -> pd.DataFrame:
    pdf = df.toPandas()
    keys = [k for k in keys if k in pdf.columns]
    return pdf[sorted(pdf.columns)].sort_values(keys, ignore_index=True)
