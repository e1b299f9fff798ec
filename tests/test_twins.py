"""Operators against plain pandas or loops."""

import numpy as np
import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from barloom.operators import indicators as I
from barloom.operators import levels as V
from barloom.operators import profile as R
from barloom.operators import signals as S
from barloom.operators import sweep as G


def series(pbars, symbol="A"):
    return pbars[pbars.symbol == symbol].reset_index(drop=True)


def test_exponential_means(bars, pbars):
    got = rows(I.moving_averages(bars, 10, size=64).filter("symbol = 'A'"))
    c = series(pbars).close
    np.testing.assert_allclose(got.ema, c.ewm(span=10).mean(), rtol=1e-11)
    np.testing.assert_allclose(got.ema_recursive, c.ewm(span=10, adjust=False).mean(), rtol=1e-11)
    seed = c.copy()
    seed[:9], seed[9] = np.nan, c[:10].mean()
    np.testing.assert_allclose(got.rma[9:], seed[9:].ewm(alpha=0.1, adjust=False).mean(), rtol=1e-11)
    assert got.rma[:9].isna().all() and got.sma[:9].isna().all()


def naive_knn(value, target, k, window):
    out = np.full(len(value), np.nan)
    for i in range(window, len(value)):
        past = [(abs(value[i - d] - target[i]), d, value[i - d]) for d in range(1, window + 1) if not np.isnan(value[i - d])]
        near = sorted(past)[:k]
        out[i] = np.mean([v for _, _, v in near])
    return out


def test_knn_trend(bars, pbars):
    got = rows(I.knn_trend(bars, 3, 12, 4, 10, size=100).filter("symbol = 'A'"))
    p = series(pbars)
    value = ((p.high + p.low) / 2).rolling(4).mean().to_numpy()
    line = naive_knn(value, p.close.ewm(span=4).mean().to_numpy(), 3, 12)
    np.testing.assert_allclose(got.knn_ma, line, rtol=1e-9)
    assert set(got.signal_type) == {-1, 0, 1}


def test_knn_vote(bars, pbars):
    k, window, ma, smooth = 3, 12, 4, 5
    got = rows(I.knn_vote(bars, k, window, ma, smooth, size=200).filter("symbol = 'A'"))

    def rma(x, n):
        x, out = np.asarray(x, float), np.full(len(x), np.nan)
        first = int(np.flatnonzero(~np.isnan(x))[0]) + n - 1
        out[first] = x[first - n + 1:first + 1].mean()
        for i in range(first + 1, len(x)):
            out[i] = out[i - 1] + (x[i] - out[i - 1]) / n
        return out
    p = series(pbars)
    value = ((p.high + p.low) / 2).rolling(ma).mean().to_numpy()
    target = rma(p.close, ma)
    line = np.full(len(p), np.nan)
    for i in range(window + ma - 1, len(p)):
        near = sorted((abs(value[i - d] - target[i]), d, value[i - d]) for d in range(1, window + 1))[:k]
        line[i] = sum(v for _, _, v in near) / k
    np.testing.assert_allclose(got.knn_ma, line, rtol=1e-9)
    o, c = rma(line, smooth), rma(np.r_[np.nan, line[:-1]], smooth)
    np.testing.assert_allclose(got.average_line, o, rtol=1e-9)
    price = (line + p.close.to_numpy()) / 2
    want = []
    for i in range(len(p)):
        best, pos, neg = 10e10, 0, 0
        for d in range(1, 11):
            if i - d >= 0 and abs(price[i - d] - price[i]) < best:
                best = abs(price[i - d] - price[i])
                pos += c[i - d] < o[i - d]
                neg += c[i - d] > o[i - d]
        want.append(1 if pos > neg else -1)
    assert list(got.vote) == want


def test_macd_sweep_equals_single_runs(bars):
    res = G.sweep_macd(bars, (4, 6), (9, 12), (3,)).filter("symbol = 'A' and fast = 4 and slow = 12").toPandas().iloc[0]
    curve = S.equity_curve(I.macd(bars, 4, 12, 3, keep_block=True)).filter("symbol = 'A'")
    end = rows(curve).equity.iloc[-1]
    closed = S.pair_trades(curve).filter("exit_ts is not null").count()
    assert abs(res.final_capital / end - 1) < 1e-9 and res.total_trades == closed


def test_knn_sweep_equals_single_runs(bars):
    res = G.sweep_knn(bars, (2, 4), (8,), (3,), (7, 9)).filter("symbol = 'A' and k = 4").toPandas()
    curve = S.equity_curve(I.knn_trend(bars, 4, 8, 3, zero_fill=True, keep_block=True)).filter("symbol = 'A'")
    assert sorted(res.smoothing) == [7, 9]
    np.testing.assert_allclose(res.final_capital, rows(curve).equity.iloc[-1], rtol=1e-9)


def test_mean_sweep_equals_single_runs(spark, pbars):
    """Summaries of blocks give what the whole curve gives, in every column, whatever the blocks; whole prices sum exactly."""
    from barloom.operators import performance as P
    whole = pbars[["symbol", "timeframe", "ts", "close"]].assign(close=pbars.close.round())
    gaps = whole.assign(close=whole.close.mask(whole.ts.dt.dayofyear % 19 == 3))

    def frame(p):
        return spark.createDataFrame(p).withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "close": F.when(~F.isnan("close"), F.col("close"))})

    def crossings(g, n):
        mean = g.close.fillna(0).rolling(n).sum() / n
        up = (g.close > mean) & (g.close.shift() <= mean.shift())
        down = (g.close < mean) & (g.close.shift() >= mean.shift())
        return g.assign(symbol=g.symbol + f"|{n}", bar_no=np.arange(len(g)), signal_type=up.astype(int) - down.astype(int))
    for source in (whole, gaps):
        end = source.groupby("symbol").ts.transform("max")
        parts = []
        for history, p in ((0, source), (10, source[source.ts > end - pd.Timedelta(days=10)])):
            for symbol, g in p.groupby("symbol"):
                parts += [crossings(g.assign(symbol=f"{symbol}|{history}"), n) for n in (5, 9) if len(g) >= n + 10]
        want = P.curve_metrics(S.equity_curve(frame(pd.concat(parts)))).toPandas().sort_values("symbol", ignore_index=True)
        assert len(want) == 8 and (want.n_entries > 3).all()
        for size in (65_536, 37, 6):
            got = G.sweep_sma(frame(source), (5, 9), (0, 10), spare=10, size=size).toPandas()
            got["symbol"] = got.symbol + "|" + got.history.astype(str) + "|" + got.sma_period.astype(str)
            got = got.sort_values("symbol", ignore_index=True)
            pd.testing.assert_frame_equal(got[list(want.columns)], want, check_dtype=False, rtol=1e-9, atol=1e-9)


def naive_channels(p, prd, loopback, pct, most, span):
    """Channels as of the newest pivot of p; none without a pivot."""
    high, low, n = p.high.to_numpy(), p.low.to_numpy(), len(p)
    vals, result = [], None
    for t in range(n):
        i = t - prd
        if i < prd:
            continue
        others = [j for j in range(i - prd, t + 1) if j != i]
        ph = high[i] > high[others].max()
        pl = low[i] < low[others].min()
        if ph or pl:
            vals.insert(0, (t, high[i] if ph else low[i]))
            vals = [v for v in vals if t - v[0] <= loopback]
            result = (t, list(vals))
    if result is None:
        return []
    t, vals = result
    a = max(0, t - span + 1)
    width = (high[a:t + 1].max() - low[a:t + 1].min()) * pct / 100
    found = []
    for _, seed in vals:
        lo = hi = seed
        s = 0
        for _, v in vals:
            gap = hi - v if v <= hi else v - lo
            if gap <= width:
                lo, hi = (min(lo, v), hi) if v <= hi else (lo, max(hi, v))
                s += 20
        b = max(0, t - loopback)
        h, l = high[b:t + 1], low[b:t + 1]
        s += int((((h <= hi) & (h >= lo)) | ((l <= hi) & (l >= lo))).sum())
        found.append([s, hi, lo])
    out = []
    for _ in range(most):
        best = max((f for f in found if f[0] >= 20), key=lambda f: f[0], default=None)
        if best is None:
            break
        top, bottom, s = best[1], best[2], best[0]
        out.append((top, bottom, s))
        for f in found:
            if bottom <= f[1] <= top or bottom <= f[2] <= top:
                f[0] = -1
    return sorted(out, key=lambda x: (-x[2], x))


def test_channels(bars, pbars):
    got = V.channels(bars, 4, 60, range_bars=80).filter("symbol = 'A'").toPandas()
    have = sorted(zip(got.top, got.bottom, got.strength), key=lambda x: (-x[2], x))
    assert have == naive_channels(series(pbars), 4, 60, 5.0, 10, 80) and len(have) > 2


def test_channel_breaks(bars, pbars):
    """Every bar against the channels known on that bar, never later ones."""
    got = V.channel_breaks(bars, V.channel_sets(bars, 4, 60, range_bars=80), size=90).filter("symbol = 'A'").orderBy("bar_no").toPandas()
    p = series(pbars).iloc[:260]
    for t in range(1, len(p)):
        now = naive_channels(p.iloc[:t + 1], 4, 60, 5.0, 10, 80)
        c, prev = p.close.iloc[t], p.close.iloc[t - 1]
        outside = not any(b <= c <= a for a, b, _ in now)
        assert got.resistance_broken[t] == (outside and any(prev <= a < c for a, _, _ in now)), t
        assert got.support_broken[t] == (outside and any(prev >= b > c for _, b, _ in now)), t
    assert got.resistance_broken.sum() > 3 and got.support_broken.sum() > 3


def test_smart_levels(bars):
    prof = R.volume_profile(bars, 300, 100).cache()
    got = R.smart_levels(prof, 0.6, 0.03).filter("symbol = 'A'").toPandas().sort_values("price")
    p = prof.filter("symbol = 'A'").toPandas().sort_values("row_no")
    high = p[p.total_volume > np.percentile(p.total_volume, 60)]
    used, want = set(), []
    for i, a in enumerate(high.price_level):
        if i in used:
            continue
        group = [j for j, b in enumerate(high.price_level) if j not in used and (j == i or abs(a - b) / a < 0.03)]
        used |= set(group)
        g = high.iloc[group]
        want.append((np.average(g.price_level, weights=g.total_volume), len(g)))
    np.testing.assert_allclose(got.price, sorted(w for w, _ in want), rtol=1e-9)
    assert got.strength.sum() == len(high)


def test_profile_keeps_volume(bars):
    prof = R.volume_profile(bars, 300, 24, "volume").groupBy("symbol").agg(F.sum("total_volume").alias("v"))
    last = R.latest(bars, 300).filter("high > low").groupBy("symbol").agg(F.sum("volume").alias("w"))
    for r in prof.join(last, "symbol").collect():
        assert abs(r.v / r.w - 1) < 1e-9


def test_curve_invariants(bars):
    curve = rows(S.equity_curve(S.sma_cross(bars, 5, keep_block=True)))
    for _, g in curve.groupby("symbol"):
        side = g.event[g.event != 0].tolist()
        assert all(a != b for a, b in zip(side, side[1:])) and (not side or side[0] == 1)
        flat = g.position.shift(1, fill_value=0).eq(0)
        assert np.allclose(g.equity[flat], g.equity.shift(1, fill_value=10_000.0)[flat])
        assert (g.drawdown <= 1e-12).all()


def test_transactions_profit(bars):
    trades = S.pair_trades(S.equity_curve(S.sma_cross(bars, 5, keep_block=True)))
    tx = S.transactions(trades).toPandas()
    both = tx[tx.action == "SELL"].merge(tx[tx.action == "BUY"], on=["symbol", "trade_no"])
    assert len(both) > 10
    np.testing.assert_allclose(both.profit_x, (both.price_x - both.price_y) * both.quantity_y)
