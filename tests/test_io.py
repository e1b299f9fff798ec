"""Readers, writers, store loads and streams on small files."""

import json
import os
import tempfile
from datetime import date, datetime

import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from barloom.functions import cells as C
from barloom.functions import text as T
from barloom.operators import assets as A
from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators import store as O
from barloom.sources import html as H
from barloom.sources import readers as D
from barloom.streaming import streams as W


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def put(name, text):
    d = folder()
    with open(f"{d}/{name}", "w", encoding="utf-8") as f:
        f.write(text)
    return d


def test_readers(spark):
    d = put("assets_de.json", json.dumps([{"ticker": "A.DE", "market_cap": 1.5}, {"ticker": "B"}]))
    with open(f"{d}/assets_fr.json", "w") as f:
        f.write('[{"ticker": "C"')
    got = D.read_assets(spark, d).orderBy("ticker").collect()
    assert [(r.ticker, r.file_country) for r in got] == [("A.DE", "DE"), ("B", "DE")]

    d = put("BTC_4h.txt", json.dumps([[1704067200000, "1", "3", "0.5", "2", "9", 0, "0", 1, "0", "0", "0"]]) + "\nbroken\n")
    r = D.read_klines(spark, d).collect()
    assert [(x.symbol, x.timeframe, x.high, x.volume) for x in r] == [("BTC", "4h", 3.0, 9.0)]

    d = put("h.json", json.dumps({"symbol": "X", "historical": [{"date": "2024-01-02", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 5}]}))
    assert D.read_history_json(spark, d).first().ts == datetime(2024, 1, 2)

    d = put("caps.csv", 'timestamp;close;marketCap;volume\n"2024-01-01T00:00:00.000Z";5;100;7\n')
    assert D.read_caps_csv(spark, d).first().market_cap == 100.0

    d = put("o.csv", " Date ;Open;High;Low;Close\n2024-01-01;1;2;1;2\n2024-01-02;1;x;1;2\n")
    r = D.read_ohlcv_csv(spark, d).collect()
    assert len(r) == 1 and r[0].volume == 1e6

    d = put("r_4h.csv", "a,b\n1,2\n")
    assert D.read_results(spark, d, "a int, b int").first().timeframe == "4h"
    empty = put("e.csv", "Price,Close\nTicker,BTC\nDate,\n")
    assert D.read_first(spark, [f"{folder()}/none", empty, d], ["a", "b"]).columns == ["a", "b"]
    out = folder() + "/w"
    D.write_results(spark.createDataFrame([(1.23456,)], "x double"), out, "csv", 2)
    assert spark.read.option("header", True).csv(out).first().x == "1.23"


def test_html_and_cells(spark):
    page = ("<table><tr><th>Rank</th><th>x</th><th>Name</th><th>Market cap</th><th>Price</th><th>Today</th></tr>"
            "<tr><td>1</td><td></td><td>Big Corp 12BIG</td><td>$3.512 T</td><td>$142.83</td><td class='red'>1.2%</td></tr></table>")
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    r = H.company_rows(H.table_rows(df)).first()
    assert (r["name"], r.ticker, r.market_cap_raw, r.price_raw, r.today) == ("Big Corp", "BIG", 3_512_000_000_000, 142.83, "-1.2%")
    card = ("<div><h4>ETH</h4><div>Total supplied</div><p>$5B</p><p data-cy='apy'>1%</p><p data-cy='apy'>2%</p></div>"
            "<div><h4>ETH</h4><p data-cy='apy'>9%</p></div><div><h4>NIL</h4></div>")
    r = H.lending_cards(spark.createDataFrame([(1, card)], "page_id int, html string")).collect()
    assert [(x.asset_name, x.total_supplied, x.supply_apy, x.borrow_apy) for x in r] == [("ETH", "$5B", "1%", "2%")]

    def price(cells, attrs=None, text=None):
        attrs = attrs or [None] * len(cells)
        one = spark.createDataFrame([(cells, attrs, text or " ".join(cells))], "c array<string>, a array<string>, t string")
        return one.select(C.recover_price(F.col("c"), F.col("a"), F.col("t"))).first()[0]
    assert price(["", "1", "n", "", "$2 T", "$142.83"]) == "$142.83"
    assert price(["", "1", "n", "", "$2 T", ""], [None] * 5 + ["88.00"]) == "$88"
    assert price(["7", "x", "€45.50"]) == "€45.50"
    assert price(["7", "note 650 units"]) == "$650"
    assert price(["7"], text="rank 7 only") is None


def test_names_and_mojibake(spark):
    one = spark.createDataFrame([("12 Strategy " + T.FLAGS[0][0] + "X  é", "café\x07 CitÃ©", "Firm & Co.")], "a string, b string, c string")
    r = one.select(T.clean_holder("a"), T.normalize_text("b"), T.normalize_company("c")).first()
    assert list(r) == ["Strategy US X", "café Cité", "FIRM"]


def test_store_loads_are_idempotent(spark):
    path = folder() + "/t"
    df = spark.createDataFrame([(1, "a", date(2024, 1, 1)), (2, "b", date(2024, 1, 2))], "id int, v string, snapshot_date date")
    for _ in range(2):
        O.replace_partition(df, path)
    O.upsert(spark, path, spark.createDataFrame([(2, "B", date(2024, 1, 2)), (3, "c", date(2024, 1, 2))], df.schema), ["id"])
    got = sorted((r.id, r.v) for r in spark.read.schema(df.schema).parquet(path).collect())
    assert got == [(1, "a"), (2, "B"), (3, "c")]
    O.insert_missing(spark, path, spark.createDataFrame([(3, "x", date(2024, 1, 2)), (4, "d", date(2024, 1, 3))], df.schema), ["id"], ["snapshot_date"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == ["B", "a", "c", "d"]
    gone = O.apply_retention(spark, path, 1, F.lit("2024-01-03").cast("date"), "snapshot_date")
    assert gone == ["2024-01-01"]
    events = folder() + "/e"
    e = spark.createDataFrame([("CPI", "1", "", date(2024, 1, 1))], "name string, forecast string, actual string, day date")
    O.upsert_fill_blanks(spark, events, e, ["name", "day"], ["forecast", "actual"], ["day"])
    O.upsert_fill_blanks(spark, events, spark.createDataFrame([("CPI", "9", "2", date(2024, 1, 1))], e.schema), ["name", "day"], ["forecast", "actual"], ["day"])
    r = spark.read.schema(e.schema).parquet(events).first()
    assert (r.forecast, r.actual) == ("1", "2")


def test_incremental_store(spark, bars):
    root = folder()
    trend = bars.filter("symbol = 'B'").withColumn("date_analyzed", F.lit("2024-02-01").cast("date"))
    summary = trend.groupBy("symbol", "timeframe", "date_analyzed").agg(F.count("*").alias("n"))
    part = trend.filter("close > 100")
    O.incremental_store(spark, root, part, part, part, summary)
    O.incremental_store(spark, root, trend, trend, trend, summary)
    assert O.pending(spark, root, trend, trend, summary).count() == 0
    O.incremental_store(spark, root, trend, trend, trend, summary)
    for name in ("ai_trend_data", "equity_curve", "transaction_records"):
        assert spark.read.parquet(f"{root}/{name}").count() == trend.count()


def stream_of(spark, df, parts=3):
    path = folder() + "/s"
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, mode="append"):
    out, name = folder(), "m" + folder()[-6:].replace("_", "x").replace("-", "x")
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_stream_bars_equal_batch(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.lit(1.0).alias("volume"), F.col("event_id").alias("tick_id"))
    end = ev.agg(F.max("ts")).first()[0]
    closing = spark.createDataFrame([("view", end + pd.Timedelta(days=60), 1.0, 1.0, -1)], ev.schema)
    # a repeated tick must not count twice; the closing tick pushes the watermark
    ticks = ev.unionByName(ev.limit(50))
    src = folder() + "/s"
    ticks.repartition(2).write.parquet(src)
    closing.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    live = run(W.stream_bars(W.with_policy(stream, "40 days"), "4 hours", "4h"))
    batch = B.ticks_to_bars(ev, "4 hours", "4h")
    got, want = rows(live.filter(F.col("ts") <= F.lit(end))), rows(batch)
    pd.testing.assert_frame_equal(got, want[got.columns])
    ratio = run(W.stream_ratio(stream.withWatermark("ts", "40 days"), "click", "view", "1 hour")).toPandas()
    assert len(ratio) > 0 and (ratio.ratio > 0).all()


def test_stream_alerts_equal_batch(spark, bars):
    src = folder() + "/s"
    b = bars.withColumn("ts", F.col("ts").cast("timestamp"))
    cut = "timestamp'2024-01-20'"
    b.filter(f"ts < {cut}").coalesce(1).write.parquet(src)
    schema = b.schema
    stream = spark.readStream.schema(schema).parquet(src)
    out = folder()

    def go():
        q = W.stream_alerts(stream).writeStream.format("parquet").option("path", f"{out}/d").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    go()
    b.filter(f"ts >= {cut}").coalesce(1).write.mode("append").parquet(src)
    go()
    got = rows(spark.read.parquet(f"{out}/d"))
    want = rows(I.macd(bars).filter("signal_type <> 0").select("symbol", "timeframe", "ts", "close", "signal_type"))
    assert len(got) == len(want) and (got.signal_type.to_numpy() == want.signal_type.to_numpy()).all()


def test_store_stream_and_changes(spark, bars):
    table, seen = folder() + "/t", []
    df = bars.withColumn("day", F.to_date("ts"))
    W.store_stream(stream_of(spark, df.unionByName(df.limit(20))), table, ("symbol", "ts"), ["day"], folder()).awaitTermination()
    assert spark.read.parquet(table).count() == bars.count()
    changes = W.stream_changes(spark, table, df.schema, lambda b, i: seen.append(b.count()), folder())
    changes.awaitTermination()
    assert sum(seen) == bars.count()


def test_late_rows_go_aside(spark):
    """Late by what arrived before, however it is cut into batches; repeats and replayed batches add nothing."""
    schema = "symbol string, tick_id long, ts timestamp, price double"
    hours = [("A", 1, 10), ("A", 2, 12), ("A", 3, 11), ("B", 4, 3), ("A", 5, 10), ("A", 6, 13), ("B", 7, 4), ("A", 8, 11), ("A", 9, 12), ("B", 10, 2)]
    ticks = [(s, i, datetime(2024, 1, 1, h), 1.0) for s, i, h in hours]
    late = {5, 8, 10}
    for cuts in ([10], [3, 10], [1, 2, 5, 7, 10]):
        src, root = folder() + "/s", folder()
        start = 0
        for end in cuts:
            again = ticks[:2] if start else []                       # repeats of stored ticks, the second one late by now
            spark.createDataFrame(ticks[start:end] + again + ticks[start:end], schema).repartition(2).write.mode("append").parquet(src)
            W.split_late(spark.readStream.schema(schema).parquet(src), root, "90 minutes", f"{root}/c").awaitTermination()
            start = end
        def stored():
            return [sorted(r.tick_id for r in spark.read.parquet(f"{root}/{n}").collect()) for n in ("on_time", "late")]
        assert stored() == [sorted({i for _, i, _ in hours} - late), sorted(late)]
        for name in (f"{len(cuts) - 1}", f".{len(cuts) - 1}.crc"):    # as if the query had died before its last batch was noted
            os.remove(f"{root}/c/commits/{name}")
        W.split_late(spark.readStream.schema(schema).parquet(src), root, "90 minutes", f"{root}/c").awaitTermination()
        assert stored() == [sorted({i for _, i, _ in hours} - late), sorted(late)]


def test_no_late_rows(spark):
    """Ticks so dense that none is late: the table of late ones has no file, the query is still the whole table."""
    import duckdb
    from barloom.plans import ORACLES, QUERIES
    from compare import check
    sf = folder()
    spark.range(900).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 0.25) AS ts",
                                "if(id % 2 = 0, 'view', 'click') AS event_type", "CAST(id % 7 AS double) AS value").write.parquet(f"{sf}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    ok, message = check(spark, con, "r7_late_ticks", QUERIES["r7_late_ticks"], ORACLES["r7_late_ticks"], sf)
    assert ok, message


def test_late_split_writes_a_file_a_day(spark):
    """Small days are one file of a batch each, however many tasks had their rows."""
    src, root = folder() + "/s", folder()
    schema = "symbol string, tick_id long, ts timestamp, price double"
    ticks = spark.range(900).selectExpr("'A' AS symbol", "id AS tick_id", "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 864) AS ts", "1.0D AS price")
    ticks.repartition(6).write.parquet(src)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")                                # else so few rows are one task anyway
    try:
        W.split_late(spark.readStream.schema(schema).parquet(src), root, "90 minutes", f"{root}/c").awaitTermination()
    finally:
        spark.conf.set(coalesce, "true")
    files = [f for _, _, names in os.walk(f"{root}/on_time") for f in names if f.endswith(".parquet")]
    got = W.read_split(spark, root, spark.read.parquet(src).schema)
    assert len(files) == 9 and got.count() == 900 and got.where("late").isEmpty()


def test_classification_without_cross_join(spark):
    df = spark.createDataFrame([(1, "Apple Inc"), (2, "gold"), (3, "Zed")], "row_id long, name string")
    cls = spark.createDataFrame([(5, "apple", "Tech"), (1, "Gold bars", "Metal")], "cls_id long, name string, category string")
    out = A.apply_classification_fuzzy(df, cls)
    assert {r.row_id: r.category for r in out.collect()} == {1: "Tech", 2: "Metal", 3: "Other"}
    plan = A.contains_pairs(df.selectExpr("row_id as a_key", "name as a_text"), cls.selectExpr("cls_id as b_key", "name as b_text"))
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString()


def test_database_snapshot(spark):
    """A day between quantiles of its keys, as even parts; without keys in one."""
    from barloom.sources import readers as R
    url, props = "jdbc:derby:memory:snap", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(i if i < 40 else i * 1000, datetime(2024, 1, 2 if i % 3 else 3, 23, 59), "x") for i in range(60)]
    spark.createDataFrame(rows, "k long, ts timestamp, note string").write.jdbc(f"{url};create=true", "snap", properties=props)
    want = sorted(k for k, t, _ in rows if t.day == 2)
    parts = R.read_snapshot_jdbc(spark, url, "snap", "2024-01-02", ["k"], props, "\"k\"", 4, "\"ts\"")
    assert parts.columns == ["k"] and sorted(r.k for r in parts.collect()) == want
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    one = R.read_snapshot_jdbc(spark, url, "snap", "2024-01-02", ["k"], props, time_column="ts")
    assert sorted(r.k for r in one.collect()) == want and "PushedFilters: [*" in one._jdf.queryExecution().toString()
    assert R.read_snapshot_jdbc(spark, url, "snap", "2020-01-01", ["k"], props, "\"k\"", 4, "\"ts\"").count() == 0


def test_fuzzy_classification_equals_loop(spark):
    """Long, short, hot, equal and missing names, whatever the depth of the first level."""
    import random
    rng = random.Random(3)
    words = ["international", "a", "ab", "gold", "metals", "international metals holding of the north", "\u00e9t\u00e9", "ba"]
    made = [" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3, 7]))) for _ in range(120)]
    names = [*made[:70], made[0], None, "", "Gold", "zzz"]
    classes = [*made[60:], "INTERNATIONAL", "international met", made[60], "", None, "x" * 60]
    rng.shuffle(classes)
    df = spark.createDataFrame(list(enumerate(names)), "row_id int, name string")
    cls = spark.createDataFrame([(i, n, f"c{i}") for i, n in enumerate(classes)], "cls_id int, name string, category string")
    want = {}
    for i, n in enumerate(names):
        hits = [f"c{j}" for j, c in enumerate(classes) if n and c and (c.lower() in n.lower() or n.lower() in c.lower())]
        want[i] = hits[0] if hits else None
    assert len(set(want.values())) > 10
    for q in (2, 5, 12):
        got = {r.row_id: r.category for r in A.apply_classification_fuzzy(df, cls, q=q).collect()}
        assert len(got) == len(names) and all(got[i] == w for i, w in want.items() if w), q
        pairs = A.contains_pairs(df.selectExpr("row_id as a_key", "name as a_text"), cls.selectExpr("cls_id as b_key", "name as b_text"), q)
        assert sorted(map(tuple, pairs.collect())) == sorted((i, j) for i, n in enumerate(names) for j, c in enumerate(classes) if n and c and c in n), q
    none = cls.limit(0)
    assert A.apply_classification_fuzzy(df, none).count() == len(names) and A.apply_classification_fuzzy(df.limit(0), cls).count() == 0
