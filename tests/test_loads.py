"""Gated loads, the stream that rewrites touched parts only, windows as a stream, and greedy spreading with stores without coordinates."""

import os
import random

from pyspark.sql import functions as F
from tests.test_operators import miles
from tiermark.operators import loads, stores
from tiermark.streaming.captures import keep_newest_parts, newest_parts, stream_windowed_counts

SCHEMA = "id long, year int"


def test_gated_load(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    measures = {"n": F.count(F.lit(1)), "years": F.collect_set("year")}
    gates = {"rows": loads.at_least("n", 1), "year": loads.one_value("years", 2027)}
    assert loads.current(spark, table, SCHEMA).count() == 0
    of = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    now = lambda: sorted(map(tuple, loads.current(spark, table, SCHEMA).collect()))
    assert loads.gated_load(of((1, 2027), (2, 2027)), table, measures, gates)[1] == []
    assert now() == [(1, 2027), (2, 2027)]
    before = sorted(os.listdir(tmp_path / "t"))
    measured, refused = loads.gated_load(of((3, 2026), (4, 2027)), table, measures, gates)
    assert refused == ["year"] and measured["n"] == 2 and sorted(measured["years"]) == [2026, 2027]
    assert loads.gated_load(of(), table, measures, gates)[1] == ["rows", "year"]
    assert now() == [(1, 2027), (2, 2027)] and sorted(os.listdir(tmp_path / "t")) == before
    reader = loads.current(spark, table, SCHEMA)
    assert loads.gated_load(of((9, 2027)), table, measures, gates)[1] == []
    assert now() == [(9, 2027)] and reader.count() == 2
    for i in range(3):
        loads.gated_load(of((i, 2027)), table, measures, gates)
    assert len([x for x in os.listdir(tmp_path / "t") if x.startswith("v-")]) == 2 and now() == [(2, 2027)]


def test_stream_rewrites_touched_parts_only(spark, tmp_path):
    made = random.Random(4)
    data = [(made.randrange(200), i, made.random()) for i in range(900)]
    schema = spark.createDataFrame(data[:1], "k long, at long, v double").schema
    batches = [data[:500], data[500:890], [(7, 5000, 1.0)], [(7, 1, 2.0)]]
    sizes = []

    def run():
        q = keep_newest_parts(spark, f"file://{tmp_path}/in", schema, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", ["k"], ["at"], parts=16)
        q.awaitTermination()

    seen = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/made/{i}")
        os.makedirs(tmp_path / "in", exist_ok=True)
        part = next(x for x in os.listdir(tmp_path / "made" / str(i)) if x.startswith("part-"))
        os.rename(tmp_path / "made" / str(i) / part, tmp_path / "in" / f"{i}.parquet")
        run()
        seen += rows
        want = {k: max((d for d in seen if d[0] == k), key=lambda d: d[1]) for k, _, _ in seen}
        assert {tuple(r) for r in newest_parts(spark, schema, f"file://{tmp_path}/out").collect()} == set(want.values())
        versions = [sorted(x for x in os.listdir(tmp_path / "out" / p) if x.startswith("batch=")) for p in os.listdir(tmp_path / "out") if p.startswith("part=")]
        assert len(versions) == 16 and all(len(v) == 1 for v in versions)
        sizes.append(sum(v == [f"batch={i}"] for v in versions))
    assert sizes[0] == 16 and sizes[2] == sizes[3] == 1


def test_windows_drop_late_events(spark, tmp_path):
    files = [[("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a")], [("2024-01-04 00:00:00", "b")], [("2024-01-04 00:30:00", "b")], [("2024-01-01 03:00:00", "a"), ("2024-01-04 01:00:00", "b")], [("2024-01-09 00:00:00", "c")]]
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(f"file://{tmp_path}/made/{i}")
        os.makedirs(tmp_path / "in", exist_ok=True)
        part = next(x for x in os.listdir(tmp_path / "made" / str(i)) if x.startswith("part-"))
        os.rename(tmp_path / "made" / str(i) / part, tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream_windowed_counts(spark, f"file://{tmp_path}/in", df.schema, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    got = sorted((str(r.window_start), r.event_type, r.n) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    # the first event of the fourth file is days behind the second one's: its window was closed with two
    assert got == [("2024-01-01 00:00:00", "a", 2), ("2024-01-04 00:00:00", "b", 3)]


def greedy(found, same):
    out = set()
    for c in {f[0] for f in found}:
        kept = []
        for f in sorted((f for f in found if f[0] == c), key=lambda f: (f[4], f[1])):
            near = lambda k: miles(f[2:4], k[2:4]) < same if None not in (*f[2:4], *k[2:4]) else abs(f[4] - k[4]) < 0.05 and f[5] == k[5]  # noqa: B023, E731
            if not any(near(k) for k in kept):
                kept.append(f)
        out |= {(c, f[1]) for f in kept}
    return out


def test_spread_out_with_stores_without_coordinates(spark):
    made, found = random.Random(6), []
    for c in range(6):
        for i in range(60):
            la, lo = made.uniform(45, 45.06), made.uniform(-93.06, -93)
            gone = made.random() < 0.3
            found.append((c, i, None if gone else la, None if gone and made.random() < 0.8 else lo, round(miles((45.03, -93.03), (la, lo)), 2), made.choice(["55001", "55002", None])))
    df = spark.createDataFrame(found, "client long, npi long, lat double, lon double, distance double, zip string")
    for same in (0.1, 0.7):
        assert {(r.client, r.npi) for r in stores.spread_out(df, ["client"], same).collect()} == greedy(found, same)
    assert "collect_list" not in stores.spread_out(df, ["client"])._jdf.queryExecution().toString()
    assert stores.spread_out(df.where("false"), ["client"]).count() == 0


def test_a_chain_of_stores(spark):
    found = [(1, i, 45.0, -93.0 + i * 0.0015, i * 0.0733, None) for i in range(12)]
    df = spark.createDataFrame(found, "client long, npi long, lat double, lon double, distance double, zip string")
    assert {(r.client, r.npi) for r in stores.spread_out(df, ["client"]).collect()} == greedy(found, 0.1) == {(1, i) for i in range(0, 12, 2)}


def test_store_match(spark):
    network = [
        (1, 10, "Coborn's Pharmacy", "1106 8TH STREET SW STE 2", "56164"), (1, 11, "PIPESTONE CLINIC", "1106 8th St. SW", "56164"), (2, 12, "Coborn's", "1106 8TH ST SW", "56164"),
        (1, 20, "SANFORD BEMIDJI", "1300 ANNE ST NW STE B", "56601"), (1, 21, "SANFORD BEMIDJI SOUTH", "1300 ANNE STREET NW, SUITE C", "56601"), (1, 22, "OTHER", "1300 ANNE ST NW", "56601"),
    ]
    captured = [
        ("words", "Coborn's Pharmacy #2034", "1106 8th St Sw, Pipestone, MN 56164", 1), ("none named", "Acme Drug", "1106 8th St Sw, Pipestone, MN 56164", 1), ("plan", "Coborn's", "1106 8th St Sw, Pipestone, MN 56164", 2),
        ("suite", "Sanford Health", "1300 Anne St Nw Ste C, Bemidji, MN 56601", 1), ("another suite", "Sanford Health", "1300 Anne St Nw Ste D, Bemidji, MN 56601", 1), ("no suite", "Sanford Health", "1300 Anne St NW, Bemidji, MN 56601", 1),
        ("zip", "Sanford Health", "1300 Anne St NW, Bemidji, MN 56602", 1), ("shape", "Sanford", "1300 Anne St NW", 1), ("null", None, None, 1),
    ]
    got = stores.store_match(spark.createDataFrame(captured, "id string, store_name string, address string, plan long"), spark.createDataFrame(network, "plan long, npi long, name string, street string, zip string"), ["id"])
    assert sorted(map(tuple, got.collect())) == [("another suite", 20), ("another suite", 21), ("no suite", 20), ("no suite", 21), ("none named", 10), ("none named", 11), ("plan", 12), ("suite", 21), ("words", 10)]
