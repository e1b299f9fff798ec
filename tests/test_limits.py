"""Results that must not change with history length, spans, cell counts or the unit of time."""

import numpy as np
import pandas as pd
import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from barloom.functions import cells as C
from barloom.operators import assets as A
from barloom.operators import indicators as I
from barloom.operators import levels as V
from barloom.operators import signals as S
from barloom.operators.series import number_bars


def as_bars(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_old_pivot_keeps_its_channels(spark):
    n = 2000
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h")
    high = np.full(n, 100.0)
    high[500] = 110.0
    pdf = pd.DataFrame({"symbol": "A", "timeframe": "1h", "ts": ts, "open": 99.0, "high": high, "low": 98.0, "close": 99.0, "volume": 1.0})
    got = V.channels(as_bars(spark, pdf)).collect()
    assert got and {r.as_of for r in got} == {510}
    assert [tuple(r)[3:] for r in got] == [tuple(r)[3:] for r in V.channels(as_bars(spark, pdf.iloc[:1000])).collect()]


@pytest.mark.parametrize("spans", [(12, 200, 9), (2, 30, 9), (5, 100, 3)])
def test_macd_of_any_spans(spark, spans):
    pdf = make_bars({"A": 900})
    got = I.macd(as_bars(spark, pdf), *spans, size=200).toPandas().sort_values("ts")
    close = pdf.close
    line = close.ewm(span=spans[0]).mean() - close.ewm(span=spans[1]).mean()
    np.testing.assert_allclose(got.macd, line, rtol=1e-8, atol=1e-9)
    np.testing.assert_allclose(got.macd_signal, line.ewm(span=spans[2]).mean(), rtol=1e-8, atol=1e-9)


@pytest.mark.parametrize("timeframe", ["1s", None, "tick"])
def test_second_bars_are_numbered_in_spans(spark, timeframe):
    df = spark.range(5000).select(F.lit("A").alias("symbol"), F.lit(timeframe).alias("timeframe"),
                                  F.timestamp_add("SECOND", "id", F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"), "id")
    keys = ("symbol", "timeframe") if timeframe else ("symbol",)
    df = df if timeframe else df.drop("timeframe")
    from barloom.operators.series import _span
    assert df.groupBy(_span(df, 100, "ts")).count().agg(F.max("count")).first()[0] <= 100
    assert number_bars(df, keys, 100).where("bar_no <> id").count() == 0


def test_cells_beyond_a_thousand(spark):
    df = spark.range(1).select(F.concat(F.array_repeat(F.lit("x"), 1200), F.array(F.lit("$7.5 B"))).alias("cells"))
    assert df.select(C.recover_cap(F.col("cells"))).first()[0] == "$7.5 B"


def test_long_suffix_numbers(spark):
    df = spark.createDataFrame([(1, "AB"), (2, "AB"), (3, "AB2"), (4, "AB12345678901"), (5, "AB3"), (6, "AB")], "row_id long, symbol string")
    got = {r.row_id: r.unique_symbol for r in A.unique_symbols(df).collect()}
    assert got == {1: "AB", 2: "AB4", 3: "AB2", 4: "AB12345678901", 5: "AB3", 6: "AB5"}


def test_many_signals_in_linear_time(spark):
    """Signals of one symbol that change sides at every bar, and long runs of one side."""
    n = 200_000
    for period in (1, 1000):
        df = spark.range(n).select(F.lit("A").alias("symbol"), F.lit("1m").alias("timeframe"), F.col("id").alias("bar_no"),
                                   F.timestamp_add("MINUTE", "id", F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"), (F.col("id") % 97 + 1.0).alias("close"),
                                   F.when(F.floor(F.col("id") / period) % 2 == 0, 1).otherwise(-1).alias("signal_type"))
        follow = (F.floor(F.col("bar_no") / period) + 1) * period
        nxt = S.next_opposite(df, size=4096)
        assert nxt.where((follow < n) & (F.col("next_bar_no") != follow)).count() == 0 and nxt.where("next_bar_no IS NULL").count() == period
        assert S.excursions(df, size=4096).count() == n - period
