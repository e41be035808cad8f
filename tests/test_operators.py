"""Stores, rows, text, sources and streams on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tiermark.functions import clean, text
from tiermark.operators import resolve, rows, stores
from tiermark.sources import files
from tiermark.streaming.captures import keep_newest, windowed_counts


def miles(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 3958.8 * math.asin(math.sqrt(x))


def points(rng, n):
    return [(i, rng.uniform(43, 49), rng.uniform(-97, -89)) for i in range(n)]


def test_nearby_equals_all_pairs(spark):
    rng = random.Random(1)
    clients, shops = points(rng, 80), points(rng, 300)
    made = stores.nearby(spark.createDataFrame(clients, "client long, lat double, lon double"), spark.createDataFrame(shops, "npi long, lat double, lon double"), only=lambda s: s["npi"] % 2 == 0)
    want = {(c[0], s[0]) for c in clients for s in shops if s[0] % 2 == 0 and miles(c[1:], s[1:]) <= 30}
    assert {(r["client"], r["npi"]) for r in made.collect()} == want and want
    assert "CartesianProduct" not in made._jdf.queryExecution().toString() and "NestedLoop" not in made._jdf.queryExecution().toString()
    far = spark.createDataFrame([(1, 60.0, -97.0)], "client long, lat double, lon double")
    with pytest.raises(Exception, match="54 degrees"):
        stores.nearby(far, spark.createDataFrame(shops, "npi long, lat double, lon double")).collect()


def test_spread_out_equals_loop(spark):
    rng = random.Random(2)
    found = [(c, i, rng.uniform(45, 45.1), rng.uniform(-93, -92.9)) for c in range(5) for i in range(30)]
    found = [(c, i, la, lo, miles((45, -93), (la, lo))) for c, i, la, lo in found]
    got = stores.spread_out(spark.createDataFrame(found, "client long, npi long, lat double, lon double, distance double"), ["client"], same=1.0)
    want = set()
    for c in range(5):
        kept = []
        for f in sorted((f for f in found if f[0] == c), key=lambda f: (f[4], f[1])):
            if all(miles(f[2:4], k[2:4]) >= 1.0 for k in kept):
                kept.append(f)
        want |= {(c, f[1]) for f in kept}
    assert {(r["client"], r["npi"]) for r in got.collect()} == want


def test_rows(spark):
    df = spark.createDataFrame([(1, 3, "a"), (1, 2, "b"), (2, 5, "c"), (2, 9, None)], "k long, o long, v string")
    assert {tuple(r) for r in rows.first_by(df, ["k"], ["o"]).collect()} == {(1, 2, "b"), (2, 5, "c")}
    assert {tuple(r) for r in rows.newest(df, ["k"], ["o"]).collect()} == {(1, 3, "a"), (2, 9, None)}
    assert {r["v"] for r in rows.soft_filter(df, ["k"], F.col("v") == "a").collect()} == {"a", "c", None}
    assert rows.top(df, ["k"], ["o"], 1).count() == 2
    assert rows.with_default_columns(df, {"z": F.lit(1), "v": F.lit("no")}).where("z = 1 and v is null").count() == 1
    old, new = df.select("k", "v"), spark.createDataFrame([(2, "n")], "k long, v string")
    assert {tuple(r) for r in rows.replaced(old, new, ["k"]).collect()} == {(1, "a"), (1, "b"), (2, "n")}
    sold = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 1)], "k long, shop string, drug long")
    assert [r["shop"] for r in rows.divides(sold, ["k"], ["shop"], "drug").collect()] == ["x"]


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_text(spark):
    L = F.lit
    assert value(spark, text.place_key(L("Saint  Paul, city."))) == "st paul"
    assert value(spark, text.street_key(L("1106 8th Street Sw, Ste 2"))) == "1106 8TH ST SW"
    assert value(spark, text.suite(L("1 Main St Suite #b4"))) == "B4"
    assert sorted(value(spark, text.name_words(L("Coborn's Pharmacy & Drug #2034")))) == ["COBORN"]
    assert value(spark, text.chain_of(L("CVS Pharmacy #07110"))) == "cvs" and value(spark, text.chain_of(L(" Corner "))) == "corner"
    assert value(spark, text.strip_amounts(L("40 mg 2 times a day"))) == "40 mg a day"
    assert value(spark, text.has_strength(L("Vitamin D3"))) is False and value(spark, text.has_strength(L("Lisinopril 10"))) is True
    assert value(spark, text.strength_of(L("Gabapentin 300mg capsule"))) == "300mg capsule"
    assert [value(spark, text.monthly_amount(L(x))) for x in ("40 mg twice daily", "prn", "2 tabs weekly", "1/2 tablet every other day", None, "20 mg")] == [60, None, 8, 8, None, None]
    assert value(spark, text.display_dose(L("Levothyroxine"), L("0.075 mg"))) == "75 mcg" and value(spark, text.display_dose(L("x"), L("0.5 mg"))) == "0.5 mg"
    assert value(spark, text.short_store(L("Walgreens Pharmacy #12"))) == "Walgreens"
    assert value(spark, text.money_text(L(123456))) == "$1,234.56" and value(spark, text.money_text(L(None).cast("long"))) == "—"
    assert value(spark, text.tidy(L("drugs[1].dosage: metoprolol  listed"))) == "Metoprolol listed"
    assert value(spark, text.written_name(L("Ann"), L("Lee"), L(""), L("raw"))) == "Dr. Ann Lee"


def test_clean(spark):
    L = F.lit
    assert value(spark, clean.money(L("$1,234.50"))) == 1234.5 and value(spark, clean.money(L("n/a"))) is None
    assert value(spark, clean.number_or_zero(L("."))) == 0
    assert value(spark, clean.pharmacy_id(L("101234567890"))) == "1234567890"
    assert value(spark, clean.zip5(L("55001-1234"))) == "55001" and value(spark, clean.zip5(L("5500"))) is None
    assert value(spark, clean.yes(L(" y"))) is True and value(spark, clean.yes(L(None).cast("string"))) is None


def test_resolve(spark):
    concepts = spark.createDataFrame([("1", "lisinopril 10 MG Oral Tablet", "SCD"), ("2", "apixaban 5 MG Oral Tablet [Eliquis]", "SBD"), ("3", "amlodipine 5 MG / benazepril 20 MG Oral Capsule", "SCD")], "rxcui string, name string, tty string")
    made = {r["rxcui"]: r for r in resolve.dictionary(concepts).collect()}
    assert made["3"]["ingredients"] == ["amlodipine", "benazepril"] and made["3"]["strengths"] == [5.0, 20.0] and made["3"]["form"] == "oral capsule"
    assert made["2"]["brand"] == "eliquis" and made["1"]["brand"] is None
    asked = spark.createDataFrame([(1, ["benazepril", "amlodipine"]), (2, ["lisinopril"]), (3, ["benazepril"])], "mention long, words array<string>")
    assert {(r["mention"], r["rxcui"]) for r in resolve.candidates(asked, resolve.dictionary(concepts)).collect()} == {(1, "3"), (2, "1")}
    names = spark.createDataFrame([("lisinopril",), ("apixaban",), ("abc1",), ("abc2",)], "name string")
    wrong = spark.createDataFrame([(1, "lisinoprol"), (2, "zzz"), (3, "apixiban")], "mention long, written string")
    assert {(r["mention"], r["name"]) for r in resolve.spelled(wrong, names).collect()} == {(1, "lisinopril"), (3, "apixaban")}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id , name\n1,x\n2\n".encode())
    made = files.read_delimited(spark, f"file://{tmp_path}/a.csv", {"name": "n", "id": "i"})
    assert {tuple(r) for r in made.collect()} == {("x", "1"), (None, "2")}
    with pytest.raises(ValueError, match="lacks zip"):
        files.read_delimited(spark, f"file://{tmp_path}/a.csv", {"zip": "z"})
    (tmp_path / "b.json").write_text('{"plan_id":"p","zip":"1","drugs_entered":["a"],"yearly_drug_cost":{"s":1.5}}\n{bad\n')
    good, bad = files.read_searches(spark, f"file://{tmp_path}/b.json")
    assert [tuple(r) for r in good.collect()] == [("p", "1", 1, "s", 1.5, None, None)] and bad.count() == 1
    (tmp_path / "c.psv").write_text("# note\na|b|c|d|e|f\na|b|c|d|e|f|g\n")
    assert [r["hint"] for r in files.read_cases(spark, f"file://{tmp_path}/c.psv").collect()] == [None, "g"]
    keyed = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "k long, line long, v string")
    for keep, want in (("last", "new"), ("first", "old")):
        files.write_keyed(keyed, f"file://{tmp_path}/{keep}", ["k"], "line", keep)
        assert spark.read.parquet(f"file://{tmp_path}/{keep}").first()["v"] == want
    assert files.append_new(keyed, f"file://{tmp_path}/out", ["line"]) == 2 and files.append_new(keyed, f"file://{tmp_path}/out", ["line"]) == 0


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    data = [(rng.randrange(20), i, rng.random()) for i in range(300)]
    df = spark.createDataFrame(data, "k long, at long, v double")
    df.repartition(4).write.parquet(f"file://{tmp_path}/in")
    q = keep_newest(spark, f"file://{tmp_path}/in", df.schema, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", ["k"], ["at"])
    q.awaitTermination()
    last = max(p["batchId"] for p in q.recentProgress)
    got = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out/{last}").collect()}
    assert last == 3 and got == {max((d for d in data if d[0] == k), key=lambda d: d[1]) for k in {d[0] for d in data}}
    events = spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 05:59:59", "a"), ("2024-01-01 06:00:00", "a")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in windowed_counts(events).collect()) == [1, 2]
