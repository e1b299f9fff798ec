"""Stop/target exits of position signals and the trades they form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .series import BLOCK_BARS, KEYS, blocked

MIN_TARGET = 0.01
#: Children of a node of the tree over blocks; three levels hold 64**3 blocks of a series.
FAN = 64
#: What a stretch of bars must be asked to know whether it can end an entry.
EXTREMES = ("lo", "hi", "flag", "least", "most")


class _Hits:
    """Extremes of all aligned stretches of a block's bars, for the first bar that ends an entry."""

    def __init__(self, bars: pd.DataFrame):
        self.no = bars["bar_no"].to_numpy()
        n = self.leaves = 1 << max(0, int(len(bars) - 1).bit_length())
        rest = n - len(bars)
        close, target, flag = (bars[c].to_numpy(float) for c in ("close", "target_position", "profit_take"))
        close = np.concatenate([close, np.full(rest, np.nan)])
        target, flag = (np.nan_to_num(np.concatenate([x, np.zeros(rest)])) for x in (target, flag))
        self.tables = []
        for values, join in ((close, np.fmin), (close, np.fmax), (flag, np.maximum), (target, np.minimum), (target, np.maximum)):
            tree = np.zeros(2 * n)
            tree[n:] = values
            for level in range(n.bit_length() - 1, 0, -1):
                first = 1 << (level - 1)
                tree[first:2 * first] = join(tree[2 * first:4 * first:2], tree[2 * first + 1:4 * first:2])
            self.tables.append(tree)

    def _hit(self, node, price, side, stop, take):
        lo, hi, flag, least, most = (t[node] for t in self.tables)
        # moves rise or fall with the close, so the extremes decide exactly
        a, b = side * (lo - price) / price, side * (hi - price) / price
        return ((np.fmin(a, b) <= -stop) | (np.fmax(a, b) >= take) | (flag > 0)
                | np.where(side > 0, least < 0, most > 0))

    def first(self, entries: pd.DataFrame) -> np.ndarray:
        """Bar number of the first bar behind each entry that ends it, -1 if there is none."""
        values = [entries[c].to_numpy(float) for c in ("entry_price", "side", "stop_loss", "take_profit")]
        begin = np.searchsorted(self.no, entries["entry_no"].to_numpy(), side="right")
        at, found = begin + self.leaves, np.zeros(len(begin), bool)
        act = np.flatnonzero(begin < len(self.no))
        with np.errstate(invalid="ignore", divide="ignore"):
            while len(act):                                      # up and to the right, all entries at once
                node = at[act] // (at[act] & -at[act])
                hit = self._hit(node, *(v[act] for v in values))
                at[act[hit]], found[act[hit]] = node[hit], True
                act, node = act[~hit], node[~hit] + 1
                at[act] = node
                act = act[(node & -node) != node]
            act = np.flatnonzero(found & (at < self.leaves))
            while len(act):                                      # down to the bar
                left = 2 * at[act]
                hit = self._hit(left, *(v[act] for v in values))
                at[act] = np.where(hit, left, left + 1)
                act = act[at[act] < self.leaves]
        out = np.full(len(begin), -1, dtype=np.int64)
        out[found] = self.no[at[found] - self.leaves]
        return out


def _levels(blocks: DataFrame, keys: Sequence[str], fan: int) -> list[DataFrame]:
    """Tree over the blocks of a series: at level k a row a node with the extremes of its ``fan`` children."""
    top = blocks.agg(F.max("_node")).first()[0] or 0
    out, child = [], blocks
    while top > 0:
        node = F.floor(F.col("_node") / fan)
        out.append(child.groupBy(*keys, node.alias("_node")).agg(F.sort_array(F.collect_list(
            F.struct("_node", *EXTREMES))).alias("_children")))                      # ``fan`` at most
        child = child.groupBy(*keys, node.alias("_node")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("flag").alias("flag"),
            F.min("least").alias("least"), F.max("most").alias("most"))
        top //= fan
    return out


def _first_child(after: str | None):
    """Number of the first child that can end the entry, of those behind ``after``; NULL if none can."""
    price, side = F.col("entry_price"), F.col("side")

    def hit(c):
        a, b = (F.try_divide(side * (c[x] - price), price) for x in ("lo", "hi"))
        ends = ((F.least(a, b) <= -F.col("stop_loss")) | (F.greatest(a, b) >= F.col("take_profit")) | (c["flag"] > 0)
                | F.when(side > 0, c["least"] < 0).otherwise(c["most"] > 0))
        return ends if after is None else (c["_node"] > F.col(after)) & ends
    return F.get(F.filter("_children", hit), 0)["_node"]


def _first_block(open_: DataFrame, blocks: DataFrame, keys: Sequence[str], fan: int) -> DataFrame:
    """``open_`` entries with the first block behind their own (``_blk``) that can end them.

    Up a tree over blocks until a later child can, then down to the block: an entry is one row of one equi join a
    level, whatever the number of blocks.
    """
    levels = _levels(blocks, keys, fan)
    columns = open_.columns
    waiting, found = open_.withColumn("_at", F.col("_blk")), []
    for level in levels:
        asked = (waiting.withColumn("_node", F.floor(F.col("_at") / fan)).join(level, [*keys, "_node"])
                 .withColumn("_hit", _first_child("_at")).drop("_children"))
        asked = cut_lineage(asked)
        found.append(asked.where("_hit IS NOT NULL").withColumn("_at", F.col("_hit")).select(*columns, "_at"))
        waiting = asked.where("_hit IS NULL").withColumn("_at", F.col("_node")).select(*columns, "_at")
    down = None
    for k in range(len(levels) - 1, -1, -1):
        if down is not None:
            down = (down.withColumnRenamed("_at", "_node").join(levels[k], [*keys, "_node"])
                    .withColumn("_at", _first_child(None)).select(*columns, "_at"))
        down = found[k] if down is None else down.unionByName(found[k])
    if down is None:
        return waiting.where("false").drop("_at")
    return down.drop("_blk").withColumnRenamed("_at", "_blk").select(*columns)


def bracket_exits(targets: DataFrame, keys: Sequence[str] = (*KEYS, "config"), size: int = BLOCK_BARS,
                  fan: int = FAN) -> DataFrame:
    """First exit of every possible entry (|target| above 0.01), NULL while it stays open.

    Needs bar_no, close, target_position, profit_take, stop_loss, take_profit.  Entries look for their exit inside
    their own block by extremes of its stretches; those without one go up and down a tree over the blocks
    to the first later block that can hold it, and look there.  No horizon, no task sees more than one block, and no
    entry meets more than one node a level.
    """
    # read four times below, so it is written once
    df = cut_lineage(blocked(targets, keys, size))
    slim = df.select(*keys, "_blk", "bar_no", "close", "target_position", "profit_take", "stop_loss", "take_profit")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    head = ", ".join(f"`{k}` {types[k]}" for k in (*keys, "_blk"))
    schema = (head + ", entry_no bigint, entry_price double, target_position double, side double,"
              " stop_loss double, take_profit double, exit_no bigint")
    names = [*keys, "_blk", "entry_no", "entry_price", "target_position", "side", "stop_loss", "take_profit"]

    def inside(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("bar_no")
        e = bars[(bars["target_position"].abs() > MIN_TARGET) & (bars["bar_no"] >= 1)]
        e = e.rename(columns={"bar_no": "entry_no", "close": "entry_price"})
        e = e.assign(side=np.sign(e["target_position"]))
        return e[names].assign(exit_no=_Hits(bars).first(e))
    own = cut_lineage(slim.groupBy(*keys, "_blk").applyInPandas(inside, schema))
    done = own.filter(F.col("exit_no") >= 0)
    later = own.filter(F.col("exit_no") < 0).drop("exit_no")
    blocks = df.groupBy(*keys, F.col("_blk").alias("_node")).agg(
        F.min("close").alias("lo"), F.max("close").alias("hi"), F.max("profit_take").alias("flag"),
        F.min("target_position").alias("least"), F.max("target_position").alias("most"))
    waiting = _first_block(later, blocks, keys, fan)

    def beyond(bars: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(e):
            return e[names].assign(exit_no=np.zeros(0, np.int64))
        return e[names].assign(exit_no=_Hits(bars.sort_values("bar_no")).first(e))
    found = (slim.groupBy(*keys, "_blk").cogroup(waiting.groupBy(*keys, "_blk")).applyInPandas(beyond, schema))
    ids = [*keys, "entry_no"]
    exits = done.unionByName(found.filter(F.col("exit_no") >= 0)).select(*ids, "exit_no")
    all_entries = own.drop("exit_no", "_blk").join(exits, ids, "left")
    at_exit = df.select(*keys, F.col("bar_no").alias("exit_no"), F.col("close").alias("exit_price"))
    price = F.col("entry_price")
    return cut_lineage(all_entries.join(at_exit, [*keys, "exit_no"], "left")
                       .withColumn("trade_return", F.col("target_position") * F.try_divide(F.col("exit_price") - price, price)))


def _next_in_block(entry: np.ndarray, leave: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the next trade behind each entry's trade, -1 outside; bar at which a chain from it leaves the block).

    A trade that stays open ends the chain (bar -1); a chain with no entry left is free at ``end``.
    """
    follow = np.searchsorted(entry, leave, side="left")
    inner = (leave >= 0) & (leave < end) & (follow < len(entry))
    land = np.where(leave < 0, -1, np.where(leave < end, end, leave))
    for i in range(len(entry) - 1, -1, -1):                      # a trade ends behind its entry
        if inner[i]:
            land[i] = land[follow[i]]
    return np.where(inner, follow, -1), land


def bracket_trades(exits: DataFrame, keys: Sequence[str] = (*KEYS, "config"), size: int = BLOCK_BARS) -> DataFrame:
    """Trades that do not overlap: the next entry is the first at or after the last exit.

    A block of ``size`` bars maps the bar at which a chain comes in free to the bar beyond it at which it is free
    again.  Bars at which some chain comes in are the nodes of a graph whose links go to later blocks; links are
    doubled until they span the series, then the nodes on the chain from its start are read off by powers
    of two, and each block lists the trades behind its node.  No task sees more than a block.
    """
    slim = cut_lineage(exits.select(*keys, F.floor(F.col("entry_no") / size).alias("_blk"), "entry_no",
                                    F.coalesce("exit_no", F.lit(-1)).cast("long").alias("exit_no")))
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    by_block = [*keys, "_blk"]

    def landings(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry_no")
        _, land = _next_in_block(pdf["entry_no"].to_numpy(), pdf["exit_no"].to_numpy(), int(pdf["_blk"].iloc[0] + 1) * size)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "bar": np.unique(land[land >= 0])})

    blocks = cut_lineage(slim.select(*by_block).distinct())
    landed = cut_lineage(slim.groupBy(*by_block).applyInPandas(landings, head + ", bar bigint").distinct().withColumn("_blk", F.floor(F.col("bar") / size)))
    # free in a block without entries: at the start of the next one that has some
    behind = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(0, Window.unboundedFollowing)
    asked = landed.select(*by_block).union(blocks.select(*keys, F.col("_blk") + 1)).distinct()
    have = blocks.withColumn("_has", F.col("_blk"))
    there = cut_lineage(asked.unionByName(have, allowMissingColumns=True).groupBy(*by_block).agg(F.max("_has").alias("_has"))
                        .withColumn("_there", F.min("_has").over(behind)).where("_there IS NOT NULL").drop("_has"))

    def settled(frame: DataFrame, bar: str) -> DataFrame:
        block = F.floor(F.col(bar) / size)
        return (frame.drop("_blk").withColumn("_blk", block).join(there, by_block)
                .withColumn(bar, F.when(F.col("_there") == F.col("_blk"), F.col(bar)).otherwise(F.col("_there") * size)).drop("_blk", "_there"))

    starts = blocks.select(*keys, (F.col("_blk") * size).alias("bar"))
    nodes = cut_lineage(settled(landed, "bar").unionByName(starts).distinct().withColumn("_blk", F.floor(F.col("bar") / size)))

    def step(entries: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        if not len(come):
            return pd.DataFrame({**{k: [] for k in keys}, "bar": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})
        come = come.sort_values("bar")
        end = int(come["_blk"].iloc[0] + 1) * size
        bar, to = come["bar"].to_numpy(), np.full(len(come), end)
        entries = entries.sort_values("entry_no")
        entry = entries["entry_no"].to_numpy()
        _, land = _next_in_block(entry, entries["exit_no"].to_numpy(), end)
        first = np.searchsorted(entry, bar, side="left")
        has = first < len(entry)
        to[has] = land[first[has]]
        return pd.DataFrame({**{k: come[k].to_numpy() for k in keys}, "bar": bar, "to": to})

    links = slim.groupBy(*by_block).cogroup(nodes.groupBy(*by_block)).applyInPandas(step, head + ", bar bigint, to bigint")
    links = settled(links.where("to >= 0"), "to").select(*keys, "bar", "to")
    jumps = [cut_lineage(links)]
    spans = (blocks.agg(F.max("_blk")).first()[0] or 0) + 1
    while 1 << len(jumps) < spans:
        last = jumps[-1]
        onward = last.select(*keys, F.col("bar").alias("to"), F.col("to").alias("_to"))
        jumps.append(cut_lineage(last.join(onward, [*keys, "to"]).select(*keys, "bar", F.col("_to").alias("to"))))
    on_chain = blocks.groupBy(*keys).agg((F.min("_blk") * size).alias("bar"))
    for jump in reversed(jumps):                                 # a node a block at most
        on_chain = cut_lineage(on_chain.unionByName(on_chain.join(jump, [*keys, "bar"]).select(*keys, F.col("to").alias("bar"))))

    def listed(entries: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        taken = []
        if len(come) and len(entries):
            entries = entries.sort_values("entry_no")
            entry = entries["entry_no"].to_numpy()
            follow, _ = _next_in_block(entry, entries["exit_no"].to_numpy(), int(entries["_blk"].iloc[0] + 1) * size)
            i = int(np.searchsorted(entry, come["bar"].iloc[0], side="left"))
            while 0 <= i < len(entry):
                taken.append(i)
                i = int(follow[i])
        out = entries.iloc[taken][[*by_block, "entry_no"]]
        return out.assign(_in=np.arange(1, len(taken) + 1))

    at = on_chain.withColumn("_blk", F.floor(F.col("bar") / size))
    picked = cut_lineage(slim.groupBy(*by_block).cogroup(at.groupBy(*by_block)).applyInPandas(listed, f"{head}, _blk bigint, entry_no bigint, _in bigint"))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = picked.groupBy(*by_block).agg(F.count("*").alias("_n")).select(*by_block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return picked.join(before, by_block).select(*keys, "entry_no", (F.col("_before") + F.col("_in")).alias("trade_no")).join(exits, [*keys, "entry_no"])


def bracket_metrics(trades: DataFrame, keys: Sequence[str] = (*KEYS, "config")) -> DataFrame:
    """Trade counts, win rate, mean win and loss and profit factor of closed trades."""
    r = F.col("trade_return")
    agg = trades.groupBy(*keys).agg(
        F.count(r).alias("total_trades"), F.count_if(r > 0).alias("wins"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.sum(r), F.lit(0.0)).alias("sum_return"))
    n, w = F.col("total_trades"), F.col("wins")
    return agg.withColumns({
        "win_rate": F.coalesce(F.try_divide(w, n), F.lit(0.0)),
        "profit_factor": F.abs(F.try_divide(F.col("avg_win") * w, F.col("avg_loss") * (n - w)))})


def bracket_curve(targets: DataFrame, trades: DataFrame, keys: Sequence[str] = (*KEYS, "config"),
                  size: int = BLOCK_BARS) -> DataFrame:
    """Per-bar position, strategy return and growth of the traded chain.

    Entries and exits are put on their bars by an equi join; the held size is a blocked
    running value.
    """
    from .series import running, windowed
    t = trades.select(*keys, "entry_no", "exit_no", "target_position")
    opened = t.select(*keys, F.col("entry_no").alias("bar_no"), F.col("target_position").alias("_open"))
    closed = t.filter(F.col("exit_no").isNotNull()).select(*keys, F.col("exit_no").alias("bar_no"),
                                                           F.lit(True).alias("_close"))
    df = (targets.join(opened, [*keys, "bar_no"], "left").join(closed, [*keys, "bar_no"], "left"))
    df = df.withColumn("_set", F.coalesce(F.col("_open"), F.when(F.col("_close"), 0.0)))
    df = running(df, {"_pos": ("last", F.col("_set"))}, keys, size)
    df = df.withColumn("position", F.coalesce("_pos", F.lit(0.0)))

    def fn(d, o):
        held = F.lag("position", 1).over(o.ordered)
        move = F.try_divide(F.col("close"), F.lag("close", 1).over(o.ordered)) - 1
        return d.withColumn("strategy_return", F.coalesce(held * move, F.lit(0.0)))
    df = windowed(df, fn, 1, keys=keys, size=size, keep_block=True)
    df = running(df, {"growth": ("prod", 1 + F.col("strategy_return"))}, keys, size)
    return df.drop("_open", "_close", "_set", "_pos")


# fixed values: the compared settings
CONFIGS = (("Conservative", 0.05, 0.03, 0.10), ("Moderate", 0.10, 0.05, 0.15), ("Aggressive", 0.15, 0.07, 0.20))


def with_configs(signals: DataFrame, configs: Sequence[tuple] = CONFIGS) -> DataFrame:
    """Signals once per (config, max_position, stop_loss, take_profit), as a projection."""
    names = ("config", "max_position", "stop_loss", "take_profit")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c)]) for c in configs])
    return signals.withColumn("_k", F.explode(rows)).select(*signals.columns, "_k.*")
