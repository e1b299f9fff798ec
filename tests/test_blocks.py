"""Small blocks must give what one block per series gives."""

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from barloom.operators import brackets as K
from barloom.operators import assets as A
from barloom.operators import indicators as I
from barloom.operators import levels as V
from barloom.operators import pairs as X
from barloom.operators import performance as P
from barloom.operators import profile as R
from barloom.operators import signals as S
from barloom.operators import sweep as G

KT = ("symbol", "timeframe")
CASES = {
    "moving_averages": (lambda b, s: I.moving_averages(b, 10, size=s), None),
    "macd": (lambda b, s: I.macd(b, size=s), None),
    "rsi": (lambda b, s: I.rsi(b, size=s), None),
    "rsi_wilder": (lambda b, s: I.rsi(b, 5, wilder=True, size=s), None),
    "atr": (lambda b, s: I.atr(b, 5, size=s), None),
    "returns": (lambda b, s: I.returns(b, size=s), None),
    "knn": (lambda b, s: I.knn_trend(b, 3, 12, 4, 10, size=s), None),
    "knn_zero": (lambda b, s: I.knn_trend(b, 3, 12, 4, 10, zero_fill=True, size=s), None),
    "knn_vote": (lambda b, s: I.knn_vote(b, 3, 12, 4, 5, size=s), None),
    "features": (lambda b, s: I.volume_features(b, size=s), None),
    "oscillator": (lambda b, s: I.volume_oscillator(b, size=s), None),
    "position": (lambda b, s: S.position(S.sma_cross(b, 5, size=s, keep_block=True), size=s), None),
    "events": (lambda b, s: S.effective_events(S.sma_cross(b, 5, size=s, keep_block=True), size=s), None),
    "curve": (lambda b, s: S.equity_curve(S.sma_cross(b, 5, size=s, keep_block=True), fee=0.001, size=s), None),
    "excursions": (lambda b, s: S.excursions(S.sma_cross(b, 5, size=s, keep_block=True), size=s), ("symbol", "entry_time")),
    "drawdown": (lambda b, s: P.drawdown(b, "close", size=s), None),
    "pivots": (lambda b, s: V.pivots(b, 4, size=s), None),
    "channels": (lambda b, s: V.channels(b, 4, 60, range_bars=80, size=s), ("symbol", "channel_no")),
    "profile": (lambda b, s: R.volume_profile(b, 120, 20, size=s), ("symbol", "row_no")),
    "cluster": (lambda b, s: R.cluster_levels(b, tolerance=0.02, size=s), None),
    "sweep_macd": (lambda b, s: G.sweep_macd(b, (4, 6), (9, 12), (3, 5), size=s), (*KT, "fast", "slow", "signal")),
    "sweep_knn": (lambda b, s: G.sweep_knn(b, (2, 4), (8, 12), (3, 5), size=s), (*KT, "k", "window", "ma_len")),
    "sweep_sma": (lambda b, s: G.sweep_sma(b, (5, 9), (0, 10), spare=10, size=s), (*KT, "history", "sma_period")),
}


@pytest.mark.parametrize("name", CASES)
def test_small_blocks(bars, name):
    fn, keys = CASES[name]
    one = rows(fn(bars, 65_536), keys or (*KT, "ts"))
    many = rows(fn(bars, 90), keys or (*KT, "ts"))
    assert len(one) > 0
    pd.testing.assert_frame_equal(one, many, check_dtype=False, rtol=1e-9, atol=1e-9)


def _targets(bars):
    t = ((F.hash("ts") % 100) / 50.0)
    df = I.macd(bars, 3, 6, 3).select(*KT, "ts", "bar_no", "close", F.when(F.abs(t) > 1.2, t).otherwise(0.0).alias("target_position"),
                                      (F.hash("close", "ts") % 17 == 0).cast("int").alias("profit_take"))
    return K.with_configs(df, (("tight", 1.0, 0.01, 0.02), ("wide", 1.0, 0.2, 0.5)))


def _loop(g, stop, take):
    """Plain loop over the bars of one series."""
    pos, entry, out = 0.0, None, []
    for i in range(1, len(g)):
        price, target, flag = g.close.iat[i], g.target_position.iat[i], g.profit_take.iat[i]
        if pos:
            move = (price - entry[1]) / entry[1] * (1 if pos > 0 else -1)
            if move <= -stop or move >= take or flag or target * pos < 0:
                out.append((entry[0], i, pos))
                pos = 0.0
        if not pos and abs(target) > 0.01:
            pos, entry = target, (i, price)
    if pos:
        out.append((entry[0], -1, pos))
    return out


@pytest.mark.parametrize("size", [65_536, 40])
def test_bracket_chain_equals_loop(bars, size):
    targets = _targets(bars).cache()
    got = K.bracket_trades(K.bracket_exits(targets, size=size)).toPandas()
    want = []
    for (s, c), g in targets.toPandas().sort_values("bar_no").groupby(["symbol", "config"]):
        want += [(s, c, *t) for t in _loop(g, g.stop_loss.iat[0], g.take_profit.iat[0])]
    have = [(r.symbol, r.config, r.entry_no, -1 if pd.isna(r.exit_no) else int(r.exit_no), r.target_position) for r in got.itertuples()]
    assert sorted(have) == sorted(want) and len(want) > 30


def test_unique_symbols_and_fill(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["X", "X", "X2", "X", "N/A", "N/A", "X3", "Y", "X"])], "row_id long, symbol string")
    for size in (2, 1000):
        got = [r.unique_symbol for r in A.unique_symbols(df, size=size).orderBy("row_id").collect()]
        assert got == ["X", "X4", "X2", "X5", "N/A", "N/A", "X3", "Y", "X6"]
    doc = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, "a", None, None, "b", None])], "page_id int, row_no long, d string")
    for size in (2, 1000):
        got = [r.d for r in A.forward_fill(doc, ["d"], size=size).orderBy("row_no").collect()]
        assert got == [None, "a", "a", "a", "b", "b"]


def test_asof_blocks(bars):
    a = bars.filter("symbol = 'A'").select("ts", "close")
    b = bars.filter("symbol = 'B'").select("ts", "close")
    one, many = (rows(X.align_asof(a, b, size=s), ("ts",)) for s in (65_536, 30))
    pd.testing.assert_frame_equal(one, many)
    pa, pb = a.toPandas().sort_values("ts"), b.toPandas().sort_values("ts")
    want = pd.merge_asof(one[["ts"]], pb.rename(columns={"close": "w"}), on="ts")
    assert (want.w.to_numpy() == one.b_close.to_numpy()).all() and len(pa) <= len(one) + 1


def test_unique_symbols_equal_loop(spark):
    """Many repeats among names that use up numbers, in blocks of every size."""
    import random
    rng = random.Random(1)
    names = ["A", "A2", "A3", "A5", "A22", "A23", "B", "B02", "B1", "B3", "A9" + "9" * 20, "", None, "N/A", "A4x"]
    rows_ = [(i, rng.choice(names[:1] * 6 + names)) for i in range(300)]
    df = spark.createDataFrame(rows_, "row_id long, symbol string")
    natural = {s for _, s in rows_}
    used, want = {}, []
    for _, s in rows_:
        k = used[s] = used.get(s, 0) + 1
        if k == 1 or s in ("", "N/A", None):
            want.append(s)
            continue
        free = (n for n in range(2, 10_000) if f"{s}{n}" not in natural)
        want.append(f"{s}{[next(free) for _ in range(k - 1)][-1]}")
    for size in (1000, 7):
        got = A.unique_symbols(df, size=size)
        assert [r.unique_symbol for r in got.orderBy("row_id").collect()] == want and got.columns == ["row_id", "symbol", "unique_symbol"]
