"""Loads into result tables, made twice or failing on purpose, and read back."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import versions as V
from ..session import shared_folder
from .registry import query
from .results import SQL_ST, incoming, stored
from .results import O as S


def new_store(read) -> V.Versions:
    return V.Versions(read.spark, f"{shared_folder(read.spark)}/tables-{uuid.uuid4().hex[:12]}")


def days(read) -> DataFrame:
    """Orders as rows of the analysis of a day, the first of their month."""
    return read("orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date(F.date_trunc("month", "o_orderdate")).alias("day"))


SQL_DAYS = "d AS (SELECT o_orderkey, o_custkey, o_totalprice, date_trunc('month', o_orderdate)::DATE AS day FROM orders)"
DAY = "1997-03-01"


@query("s15_load_replace_day", f"WITH {SQL_DAYS} SELECT o_orderkey, o_custkey, o_totalprice, day::TIMESTAMP AS day FROM d WHERE day <> DATE '{DAY}' UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1, day FROM d WHERE day = DATE '{DAY}' AND o_orderkey % 2 = 0",
       r2="o_totalprice")
def _(read):
    """A day is loaded again with fewer rows, twice; the other days stay."""
    rows, store = days(read), new_store(read)
    load = store.load()
    load.replace_days("orders", rows, "day")
    store = load.commit()
    again = rows.where(f"day = date'{DAY}' AND o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    for _ in range(2):
        load = store.load()
        load.replace_days("orders", again, "day", [date.fromisoformat(DAY)])
        store = load.commit()
    return store.table("orders", rows.schema)


@query("s16_load_replace_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT c_custkey::INTEGER, c_name, c_nationkey FROM customer WHERE c_acctbal < 0")
def _(read):
    """The whole table is replaced; the second load is made twice."""
    nation = read("nation").select("n_nationkey", "n_name", "n_regionkey")
    second = nation.where("n_regionkey <> 2").union(read("customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("int"), "c_name", "c_nationkey"))
    store = new_store(read)
    for rows in (nation, second, second):
        load = store.load()
        load.replace_table("nation", rows, V.by_key(["n_nationkey"], 4))
        store = load.commit()
    return store.table("nation", nation.schema)


def twice(store: V.Versions, name: str, change, *rows: DataFrame) -> V.Versions:
    """``change(load, rows)`` for each of ``rows``, the last one two times."""
    for r in (*rows, rows[-1]):
        load = store.load()
        change(load, r)
        store = load.commit()
    return store


@query("s17_load_upsert", f"WITH {SQL_ST} SELECT * FROM nw UNION ALL SELECT * FROM st WHERE o_custkey NOT IN (SELECT o_custkey FROM nw)", r2="o_totalprice")
def _(read):
    """All orders of a customer come in one load; the last one by its key stays, over the stored one."""
    old = S.enforce_key(stored(read), ["o_custkey"], "version")
    new = read("orders").where("o_orderdate >= timestamp_ntz'1997-01-01'").select("o_custkey", F.col("o_orderkey").alias("version"), "o_totalprice", "o_orderstatus").select(*old.columns)
    return twice(new_store(read), "latest", lambda load, r: load.upsert("latest", r, ["o_custkey"], ["version"]), old, new).table("latest", old.schema)


@query("s18_load_fill_blanks", f"""WITH {SQL_ST}, t AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS a, CASE WHEN version % 2 = 0 THEN NULL ELSE version::VARCHAR END AS b FROM st),
s AS (SELECT o_custkey, o_orderstatus AS a, version::VARCHAR AS b FROM nw)
SELECT coalesce(t.o_custkey, s.o_custkey) AS o_custkey, coalesce(nullif(t.a, ''), nullif(s.a, ''), '') AS a, coalesce(nullif(t.b, ''), nullif(s.b, ''), '') AS b FROM t FULL JOIN s ON t.o_custkey = s.o_custkey""")
def _(read):
    old = S.enforce_key(stored(read), ["o_custkey"], "version").selectExpr(
        "o_custkey", "CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS a", "CASE WHEN version % 2 = 0 THEN NULL ELSE CAST(version AS STRING) END AS b")
    new = incoming(read).selectExpr("o_custkey", "o_orderstatus AS a", "CAST(version AS STRING) AS b")
    return twice(new_store(read), "latest", lambda load, r: load.fill_blanks("latest", r, ["o_custkey"], ["a", "b"], ["b"]), old, new).table("latest", new.schema)


@query("s19_load_insert_missing", f"WITH {SQL_ST} SELECT * FROM st UNION ALL SELECT * FROM nw WHERE o_custkey NOT IN (SELECT o_custkey FROM st)", r2="o_totalprice")
def _(read):
    old = S.enforce_key(stored(read), ["o_custkey"], "version")
    new = incoming(read).select(*old.columns)
    return twice(new_store(read), "latest", lambda load, r: load.insert_missing("latest", r, ["o_custkey"], ["version"]), old, new).table("latest", old.schema)


@query("s20_load_daily_summary", f"WITH {SQL_DAYS} SELECT day::TIMESTAMP AS day, max(o_orderkey) AS last_id, arg_max(o_totalprice, o_orderkey) AS total FROM d GROUP BY 1", r2="total")
def _(read):
    """Summaries of a day replace each other, also within one load and with an older one loaded last."""
    rows = days(read).select("day", F.col("o_orderkey").alias("last_id"), F.col("o_totalprice").alias("total"))
    early, late = rows.where("last_id % 3 = 0"), rows
    return twice(new_store(read), "summary", lambda load, r: load.upsert("summary", r, ["day"], ["last_id"]), early, late).table("summary", rows.schema)


@query("s21_load_retain", f"WITH {SQL_DAYS} SELECT o_orderkey, o_custkey, o_totalprice, day::TIMESTAMP AS day FROM d WHERE day >= DATE '1998-01-01' - 90", r2="o_totalprice")
def _(read):
    """Old days leave the manifest; their files are not read."""
    rows, store = days(read), new_store(read)
    load = store.load()
    load.replace_days("orders", rows, "day")
    store = load.commit()
    load = store.load()
    load.retain("orders", 90, F.lit("1998-01-01").cast("date"))
    return load.commit().table("orders", rows.schema)


#: The four tables of an analysis, all from the day's orders.
def four_tables(read, factor: float = 1.0) -> dict[str, DataFrame]:
    rows = days(read)
    price = F.round(F.col("o_totalprice") * factor, 2)
    return {"equity_curve": rows.select("day", "o_orderkey", price.alias("v")), "ai_trend_data": rows.select("day", "o_orderkey", (F.col("o_custkey") * factor).alias("v")),
            "transaction_records": rows.where("o_orderkey % 4 = 0").select("day", "o_orderkey", (-price).alias("v")),
            "performance_summary": rows.groupBy("day").agg(F.max("o_orderkey").alias("o_orderkey"), F.round(F.sum(price), 2).alias("v"))}


def _sql_four(factor: str) -> str:
    p = f"round(o_totalprice * {factor}, 2)"
    return (f"SELECT 'equity_curve' AS t, day, o_orderkey, {p} AS v FROM d UNION ALL SELECT 'ai_trend_data', day, o_orderkey, o_custkey * {factor} FROM d "
            f"UNION ALL SELECT 'transaction_records', day, o_orderkey, -{p} FROM d WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'performance_summary', day, max(o_orderkey), round(sum({p}), 2) FROM d GROUP BY 2")


@query("r6_refresh_four_tables", f"""WITH {SQL_DAYS}, a AS ({_sql_four("1.0")}), b AS ({_sql_four("2.0")})
SELECT t AS table_name, day::TIMESTAMP AS day, count(*) AS n_rows, sum(v) AS v FROM (SELECT * FROM a WHERE day <> DATE '{DAY}' UNION ALL SELECT * FROM b WHERE day = DATE '{DAY}') GROUP BY 1, 2""", r2="v")
def _(read):
    """A refresh of a day fails in its last table, so all four keep the old day; the next one changes all four."""
    store, first, second = new_store(read), four_tables(read), four_tables(read, 2.0)
    load = store.load()
    for name, rows in first.items():
        load.replace_days(name, rows, "day")
    store = load.commit()
    day = date.fromisoformat(DAY)
    for broken in (True, False):
        load = V.Versions(read.spark, store.root).load()
        try:
            for name, rows in second.items():
                rows = rows.where(F.col("day") == F.lit(day))
                if broken and name == "performance_summary":
                    rows = rows.withColumn("v", F.raise_error(F.lit("the load fails here")).cast("double"))
                load.replace_days(name, rows, "day", [day])
            load.commit()
        except PySparkException:
            before = V.Versions(read.spark, store.root)
            if before.version != store.version:
                raise
    newest = V.Versions(read.spark, store.root)
    parts = [newest.table(name, rows.schema).withColumn("table_name", F.lit(name)) for name, rows in first.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("table_name", "day").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("v").alias("v"))


@query("r5_incremental_store", f"""WITH {SQL_DAYS}, n AS (SELECT day, count(*) AS want, count(*) FILTER (o_orderkey % 50 <> 0) AS have FROM d GROUP BY 1),
t AS (SELECT day, o_orderkey, CASE WHEN o_orderkey % 50 <> 0 AND day <> DATE '{DAY}' THEN o_totalprice ELSE o_totalprice + 1 END AS v FROM d JOIN n USING (day)
  WHERE (day <> DATE '{DAY}' AND o_orderkey % 50 <> 0) OR day = DATE '{DAY}' OR have < greatest(floor(want * 0.95), 1)),
r AS (SELECT day, o_orderkey, CASE WHEN day = DATE '{DAY}' OR have < greatest(floor(want * 0.95), 1) THEN 2 ELSE 1 END AS v FROM d JOIN n USING (day)
  WHERE o_orderkey % 4 = 0 AND (day = DATE '{DAY}' OR have < greatest(floor(want * 0.95), 1) OR o_orderkey % 50 <> 0))
SELECT 'trend' AS table_name, day::TIMESTAMP AS day, o_orderkey, v FROM t UNION ALL SELECT 'trades', day::TIMESTAMP, o_orderkey, v FROM r""", r2="v")
def _(read):
    """A second run brings all rows with other values: covered days are skipped, others get what is missing and new trades."""
    rows = days(read)
    part = rows.where(f"o_orderkey % 50 <> 0 AND day <> date'{DAY}'")
    store = new_store(read)

    def run(store, rows, plus, mark):
        trend = rows.select("day", "o_orderkey", (F.col("o_totalprice") + plus).alias("v"))
        trades = rows.where("o_orderkey % 4 = 0").select("day", "o_orderkey", F.lit(float(mark)).alias("v"))
        return V.store_run(store, {"trend": trend}, {"trades": trades}, "day", ["day", "o_orderkey"])
    for args in ((part, 0.0, 1), (rows, 1.0, 2), (rows, 5.0, 3)):
        store = run(store, *args)
    schema = part.select("day", "o_orderkey", F.lit(1.0).alias("v")).schema
    return store.table("trend", schema).withColumn("table_name", F.lit("trend")).unionByName(store.table("trades", schema).withColumn("table_name", F.lit("trades")))


@query("r4_change_feed", f"""WITH {SQL_ST} SELECT CASE WHEN s.o_custkey IS NULL THEN 'insert' ELSE 'update' END AS change, n.o_custkey, coalesce(s.version, -1) AS old_version, n.version AS new_version, s.o_totalprice AS old_price, n.o_totalprice AS new_price
FROM nw n LEFT JOIN st s ON s.o_custkey = n.o_custkey WHERE n.o_custkey % 9 <> 0 AND (s.o_custkey IS NULL OR s.version <> n.version OR s.o_totalprice <> n.o_totalprice OR s.o_orderstatus <> n.o_orderstatus)
UNION ALL SELECT 'delete', o_custkey, version, -1, o_totalprice, NULL FROM st WHERE o_custkey % 9 = 0""", r2="old_price new_price")
def _(read):
    """What an upsert and a deletion have changed between two versions."""
    old = S.enforce_key(stored(read), ["o_custkey"], "version")
    store = twice(new_store(read), "latest", lambda load, r: load.upsert("latest", r, ["o_custkey"], ["version"]), old)
    first = store.version
    load = store.load()
    load.upsert("latest", incoming(read).select(*old.columns), ["o_custkey"], ["version"])
    store = load.commit()
    rest = store.table("latest", old.schema).where("o_custkey % 9 <> 0")
    load = store.load()
    load.replace_table("latest", rest, V.by_key(["o_custkey"]))
    store = load.commit()
    found = store.changes(first, "latest", old.schema, ["o_custkey"])
    return found.select("change", "o_custkey", *[F.coalesce(F.col(f"{side}.version"), F.lit(-1)).alias(name) for side, name in (("before", "old_version"), ("after", "new_version"))],
                        F.col("before.o_totalprice").alias("old_price"), F.col("after.o_totalprice").alias("new_price"))
