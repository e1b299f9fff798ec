"""Bracket exits and their chain against plain loops, over many blocks and levels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import brackets as K


def walks(seed: int = 3) -> pd.DataFrame:
    """Series with many, few and no entries, flat stretches, exits far behind their entry, and none at all."""
    rng = np.random.default_rng(seed)
    out = []
    for symbol, n, share, step in (("many", 300, 0.7, 0.03), ("few", 400, 0.03, 0.004), ("none", 60, 0.0, 0.02), ("late", 250, 0.1, 0.0005), ("one", 1, 1.0, 0.1)):
        close = np.round(100 * np.exp(np.cumsum(rng.normal(0, step, n))), 2)
        target = np.where(rng.random(n) < share, rng.choice([-1.5, -0.5, 0.005, 0.5, 1.0], n), 0.0)
        if symbol == "late":
            target[:150] = np.where(target[:150] < 0, 0, target[:150])
            close[:200] = 100.0
        out.append(pd.DataFrame({"symbol": symbol, "timeframe": "1h", "bar_no": np.arange(n), "close": close, "target_position": target,
                                 "profit_take": (rng.random(n) < (0.02 if symbol == "many" else 0)).astype(int)}))
    return pd.concat(out, ignore_index=True)


def first_exit(g: pd.DataFrame, i: int, stop: float, take: float) -> int:
    price, side = g.close.iat[i], np.sign(g.target_position.iat[i])
    for j in range(i + 1, len(g)):
        move = side * (g.close.iat[j] - price) / price
        if move <= -stop or move >= take or g.profit_take.iat[j] or g.target_position.iat[j] * side < 0:
            return j
    return -1


CONFIGS = (("tight", 1.0, 0.01, 0.02), ("wide", 1.0, 0.2, 0.5))


@pytest.mark.parametrize("size,fan", [(1000, 64), (32, 2), (7, 3)])
def test_exits_and_chain_equal_loops(spark, size, fan):
    bars = walks()
    targets = K.with_configs(spark.createDataFrame(bars), CONFIGS).cache()
    exits = K.bracket_exits(targets, size=size, fan=fan)
    trades = K.bracket_trades(exits, size=size)
    want_exits, want_trades = set(), []
    for symbol, g in bars.groupby("symbol"):
        g = g.reset_index(drop=True)
        entries = [i for i in range(1, len(g)) if abs(g.target_position.iat[i]) > 0.01]
        for name, _, stop, take in CONFIGS:
            leave = {i: first_exit(g, i, stop, take) for i in entries}
            want_exits |= {(symbol, name, i, x) for i, x in leave.items()}
            at, no = 0, 0
            while (i := next((e for e in entries if e >= at), None)) is not None:
                no += 1
                want_trades.append((symbol, name, no, i, leave[i]))
                if leave[i] < 0:
                    break
                at = leave[i]
    got = {(r.symbol, r.config, r.entry_no, r.exit_no) for r in exits.select("symbol", "config", "entry_no", F.coalesce("exit_no", F.lit(-1)).alias("exit_no")).collect()}
    assert got == want_exits
    got = [(r.symbol, r.config, r.trade_no, r.entry_no, r.exit_no) for r in trades.select("symbol", "config", "trade_no", "entry_no", F.coalesce("exit_no", F.lit(-1)).alias("exit_no")).collect()]
    assert sorted(got) == sorted(want_trades) and len(want_trades) > 40


def test_first_hit_of_a_block():
    bars = walks(5).query("symbol == 'many'").reset_index(drop=True)
    for n in (1, 2, 63, 64, 65, 300):
        part = bars.head(n)
        e = pd.DataFrame({"entry_no": np.arange(-1, n), "entry_price": 100.0, "side": np.where(np.arange(n + 1) % 2, 1.0, -1.0), "stop_loss": 0.03, "take_profit": 0.05})
        got = K._Hits(part).first(e)
        for i, r in enumerate(e.itertuples()):
            want = -1
            for j in range(r.entry_no + 1, n):
                move = r.side * (part.close.iat[j] - 100.0) / 100.0
                if move <= -0.03 or move >= 0.05 or part.profit_take.iat[j] or r.side * part.target_position.iat[j] < 0:
                    want = j
                    break
            assert got[i] == want


def test_no_entries(spark):
    targets = K.with_configs(spark.createDataFrame(walks()).where("symbol = 'none'"))
    exits = K.bracket_exits(targets)
    assert exits.count() == 0 and K.bracket_trades(exits).count() == 0
    assert K.bracket_trades(K.bracket_exits(targets.where("false"))).count() == 0
