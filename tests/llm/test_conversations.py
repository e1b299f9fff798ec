"""Repair and prefix trie of conversations against SQL, and the search against all edits of short conversations."""

import hashlib
import random
from itertools import product

import duckdb
import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.01"
SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def talks() -> list[tuple]:
    """Nulls, blank and cut texts, repeats, roles of other kinds, shared beginnings, rows of one turn, one long conversation."""
    rng = random.Random(5)
    said = ["Hello there.", "what", "Yes!", "", " \t\n", "No?\x0b", "über. ", "one two  three.", "cut off", None, "x" * 3000 + ".", "a ", "Hello there."]
    roles = ["user", "assistant", "system", "tool", "", None, "speaker", "User", "u"]
    rows = []
    for conv in [*range(0, 140), 199, 200, 2**62, -7, -40]:
        n = rng.randint(1, 7)
        for t in range(n):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((conv, None if rng.random() < 0.05 else t + (rng.random() < 0.1), role, rng.choice(said) if rng.random() < 0.6 else f"Said {rng.randint(0, 3)}."))
    rows += [(300 + i, t, ("user", "assistant")[t % 2], f"same {t}.") for i in range(30) for t in range(4)]          # one conversation many times
    rows += [(500, t, rng.choice(roles[:3]), rng.choice(said) or f"turn {t}" + rng.choice((".", ""))) for t in range(400)]
    rows += [(600, 3, "user", "tie b."), (600, 3, "user", "tie a."), (600, 3, "assistant", "tie."), (600, 3, "user", "tie b."), (601, None, None, None)]
    rows += rows[:9]
    rng.shuffle(rows)
    return rows


def table_of(rows) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows], SCHEMA)


def in_spark(spark, rows):
    """With further columns, some named like columns that the operators make."""
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], "conv_id long, turn long, role string, text string, n int, kind string, audit string, depth int").repartition(3)


def by_sql(sql: str, rows):
    con = duckdb.connect()
    conversations = table_of(rows)  # noqa: F841
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, sorted(got.fetchall(), key=str)


def check(df, sql, rows):
    names, want = by_sql(sql, rows)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    assert set(df.columns) == set(names)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("task_rows", [10_000, 3])
def test_repair_like_sql(spark, task_rows):
    from barloom.llm.conversation_sql import repair_sql
    from barloom.llm.repair import repair
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", task_rows)
    try:
        rows = [*talks(), (None, 1, "user", "no id."), (None, 2, "assistant", "no id, cut")]
        check(repair(in_spark(spark, rows)), repair_sql(), rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("task_rows", [10_000, 3])
def test_prefixes_like_sql(spark, task_rows):
    from barloom.llm.conversation_sql import prefixes_sql
    from barloom.llm.prefixes import prefix_trie
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", task_rows)
    try:
        rows = talks()
        check(prefix_trie(in_spark(spark, [*rows, (None, 1, "user", "no id")])), prefixes_sql(), rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_given_tables_like_sql(spark):
    from barloom.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{SF}/conversations.parquet'")
    for name in ("op12_repair", "op13_prefix_trie"):
        got = con.execute(ORACLES[name])
        names = [d[0] for d in got.description]
        want = sorted(got.fetchall(), key=str)
        assert sorted((tuple(r[c] for c in names) for r in QUERIES[name](spark, SF).collect()), key=str) == want


def test_nothing(spark):
    from barloom.llm.prefixes import prefix_trie
    from barloom.llm.repair import repair
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(none).count() == 0 and prefix_trie(none).count() == 0
    lost = next(i for i in range(1000) if __import__("zlib").crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = repair(spark.createDataFrame([(lost, 0, "user", "gone")], "conv_id long, turn long, role string, text string")).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def all_edits(codes: bytes) -> tuple[int, str]:
    """Every way to edit a few rows, with at most two turns put in at each place."""
    best = None
    n = len(codes)
    for kept in product("DKR", repeat=n):
        for puts in product((0, 1, 2), repeat=n + 1):
            cost, out, ok = 0, "", True
            audit = ""
            for i in range(n + 1):
                audit += "I" * puts[i]
                cost += 5 * puts[i]
                out += "?" * puts[i]
                if i < n:
                    audit += kept[i]
                    if kept[i] == "D":
                        cost += 2
                        continue
                    ok &= not codes[i] & 4
                    cost += 5 * (codes[i] & 8 > 0) + (kept[i] == "R")
                    out += "?" if kept[i] == "R" else "suax"[codes[i] & 3]
            # '?' may be u or a
            want = lambda k, s: "u" if (k - s) % 2 == 0 else "a"
            fits = any(len(out) == 0 or (len(out) - s) % 2 == 0 and len(out) > s and (s == 0 or out[0] == "s") and all(c in ("?", want(k, s)) for k, c in list(enumerate(out))[s:]) for s in (0, 1))
            if ok and fits and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_search_against_all_edits():
    from barloom.llm.repair import cheapest, needed
    for n in range(4):
        for codes in product([0, 1, 2, 3, 4, 6, 8, 9, 10], repeat=n) if n < 3 else random.Random(1).sample(list(product([0, 1, 2, 3, 5, 8, 9, 10, 11], repeat=3)), 60):
            codes = bytes(codes)
            cost, edits = cheapest(codes)
            assert (cost, edits.decode()) == all_edits(codes), codes
            assert needed(codes)[0] <= cost


def test_search_of_long_conversations():
    from barloom.llm.repair import cheapest
    rng = random.Random(2)
    codes = bytes(rng.choice((0, 1, 1, 2, 2, 3, 5, 9, 10)) for _ in range(20_000))
    cost, edits = cheapest(codes)
    assert len(edits) - edits.count(b"I") == len(codes) and cost > 0
