"""Matching and choosing on small inputs, and the cases beyond former limits."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import miles, value
from tiermark.functions import clean, text
from tiermark.operators import choosing, matching, quality, resolve, stores, year


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_patterns_of_any_length(spark):
    rng = random.Random(1)
    words = ["ab", "cd", "ef", "gh"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    patterns = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(40)})
    got = {(r["id"], r["pat"]) for r in matching.contained(frame(spark, "id long, txt string", *texts), "txt", frame(spark, "pat string", *[(p,) for p in patterns]), "pat").collect()}
    assert got == {(i, p) for i, t in texts for p in patterns if f" {p} " in f" {t} "} and any(len(p.split()) > 3 for _, p in got)


def test_requests(spark):
    plans = frame(spark, "plan long, carrier string, name string", (1, "blue cross", "Blue Cross Core"), (2, "blue cross", "Blue Cross Choice"), (3, "medica", "Medica Choice Rx"), (4, "medica", "Medica Choice Rx"), (5, "uhc", "UHC"))
    said = {"BCBS choice": 2, "bc": 1, "choice": 2, "medica choice": 3, "AARP plan": 5, "nothing here": None, "": None}
    asked = frame(spark, "raw string", *[(s,) for s in said]).withColumn("request", matching.expanded(F.col("raw"), {"bc": "blue cross", "bcbs": "blue cross", "aarp": "uhc"}))
    found = matching.requested(asked.select("request").distinct(), plans, ("core", "choice"))
    got = {r["raw"]: (r["plan"], r["score"]) for r in asked.join(found, "request", "left").collect()}
    assert {k: v[0] for k, v in got.items()} == said
    assert got["BCBS choice"] == (2, 10 + 3 + 3 + 8 + 3) and got["medica choice"][1] == 10 + 3 + 8 + 3


def test_directory_and_evidence(spark):
    rng = random.Random(2)
    entries = [(i, rng.choice(["Ann", "Anna", "Amy", "bo"]), rng.choice(["Lee", "LEE", "Roe"]), rng.randint(0, 3), rng.random() < 0.5) for i in range(80)]
    doctors = [(i, rng.choice(["An", "Amy", "Bob", "C"]), rng.choice(["lee", "Roe", "Poe"]), rng.randint(0, 3)) for i in range(20)]
    got = {r["doctor"]: r["id"] for r in matching.in_directory(frame(spark, "doctor long, first string, last string, city int", *doctors), frame(spark, "id long, first string, last string, city int, accepting boolean", *entries)).collect()}
    want = {}
    for d, f, la, c in doctors:
        fit = [(not (e[1].lower().startswith(f.lower()) or f.lower().startswith(e[1].lower())), e[3] != c, not e[4], e[0]) for e in entries if e[2].lower() == la.lower() and e[1][0].lower() == f[0].lower()]
        if fit:
            want[d] = min(fit)[3]
    assert got == want and want
    asked = frame(spark, "entity long, scope int", (1, 1), (1, 2), (2, 1), (3, 1))
    known = frame(spark, "entity long, scope int, source string, status string, ts long, id long", (1, None, "directory", "in", 5, 1), (1, 1, "system", "out", 9, 2), (1, 2, "confirmed", "out", 1, 3), (1, 2, "confirmed", "in", 2, 4), (2, 2, "confirmed", "in", 1, 5), (2, None, "rumour", "in", 1, 6))
    made = {(r["entity"], r["scope"]): (r["source"], r["status"]) for r in matching.by_precedence(asked, known, ("confirmed", "directory", "system")).collect()}
    assert made == {(1, 1): ("directory", "in"), (1, 2): ("confirmed", "in"), (2, 1): ("none", "not checked"), (3, 1): ("none", "not checked")}


def test_agreement_needs_all_rows_and_one_kind(spark):
    votes = []
    for label, candidate, kind, rows in (("a", 1, "x", [(1, 1), (1, 0)]), ("a", 2, "y", [(1, 1), (0, 1)]), ("b", 3, "x", [(1, 1), (1, 1)]), ("b", 4, "y", [(1, 1), (1, 1)]), ("c", 5, "x", [(1, 1)]), ("d", 6, "x", [(1, 0), (1, 0)]), ("e", 7, "x", [(1, 1), (1, 1), (0, 1)])):
        votes += [(label, candidate, kind, bool(g), bool(c)) for g, c in rows]
    got = {r["candidate"] for r in matching.agreed(frame(spark, "label string, candidate long, kind string, agree boolean, covered boolean", *votes)).where("accepted").collect()}
    assert got == {1}


def test_choosing(spark):
    area = frame(spark, "plan long, plan_name string, plan_type string, county string, list_status string", (1, "A", "MA", "X", "present"), (2, "B SNP", "MA", "X", "present"), (3, "C", "PDP", "X", "present"), (4, "D", "MA", "All Counties", "pending"), (5, "E", "MA", "Y", "none"), (6, "F", "Cost", "Y", "present"))
    got = {tuple(r) for r in choosing.eligible(frame(spark, "county string", ("X",), ("Y",)), area).collect()}
    assert got == {("X", 1), ("X", 4), ("Y", 4), ("Y", 6)}
    plans = frame(spark, "plan long", (1,), (2,), (3,))
    assert {r[0] for r in choosing.visible(plans, frame(spark, "plan string", (" 2 ",))).collect()} == {1, 3}
    assert choosing.visible(plans, frame(spark, "plan string", ("2",), ("None",))).count() == 3
    routed = {r["plan"]: (r["source"], r["how"]) for r in choosing.routed(plans, frame(spark, "plan long", (1,), (9,)), frame(spark, "plan long, source long", (1, 9), (2, 9), (3, 1))).collect()}
    assert routed == {1: (1, "same"), 2: (9, "alike"), 3: (None, "none")}
    schema = "client long, plan long, appointed boolean, offered boolean, premium long, drug_premium long, drugs long, giveback long, wanted array<int>, systems array<int>"
    rows = frame(spark, schema, (1, 1, True, True, 10, 0, 0, 0, [1, 2], [1, 2]), (1, 2, True, True, 1, 0, 0, 0, [1, 2], [3]), (1, 3, True, True, 5, 0, 0, 5, [1, 2], [2]), (1, 4, False, True, 0, 0, 0, 0, [1, 2], [1]), (1, 5, True, False, 0, 0, 0, 0, [1, 2], None))
    by = lambda **k: {r["plan"]: (r["rank"], r["dropped"]) for r in choosing.selected(rows, ["client"], **k).collect()}
    rest = {4: (None, "carrier not appointed"), 5: (None, "not offered here")}
    assert by(fit=choosing.by_systems, most=2) == {1: (1, None), 3: (2, None), 2: (3, "over limit"), **rest}
    assert by(fit=choosing.by_systems, doctors_first=False, most=2) == {3: (1, None), 2: (2, None), 1: (3, "over limit"), **rest}
    assert by(most=3) == {3: (1, None), 2: (2, None), 1: (3, None), **rest}


def test_no_limit_on_stores_near_a_client(spark):
    """More than 200 stores: those beyond them are chosen from, too."""
    rng = random.Random(3)
    found = [(1, i, la, lo, miles((45, -93), (la, lo))) for i, (la, lo) in enumerate((rng.uniform(44.8, 45.2), rng.uniform(-93.2, -92.8)) for _ in range(400))]
    kept = []
    for f in sorted(found, key=lambda f: (f[4], f[1])):
        if all(miles(f[2:4], k[2:4]) >= 0.1 for k in kept):
            kept.append(f)
    got = stores.spread_out(frame(spark, "client long, npi long, lat double, lon double, distance double", *found), ["client"])
    assert {r["npi"] for r in got.collect()} == {f[1] for f in kept} and len(kept) > 250


def test_year_parts(spark):
    terms = frame(spark, "price long, flat long, cost_type int, ded_applies boolean", (None, None, 1, False), (None, None, 1, True), (None, None, 2, False), (None, 3500, 2, True), (5, None, 2, True))
    assert [tuple(r) for r in year.known(terms).collect()] == [(None, None, 1, False), (None, 3500, 2, True), (5, None, 2, True)]
    slow = frame(spark, "g long, month int, cost long", *[(1, m, 100 + 30 * m) for m in range(1, 13)])
    assert [r["month"] for r in year.change_points(slow, ["g"], 50).orderBy("month").collect()] == [1, 3, 5, 7, 9, 11]
    ramp = frame(spark, "g long, month int, cost long", *[(1, m, c) for m, c in enumerate([900, 900, 500, *[300] * 9], 1)])
    made = year.ramp(year.change_points(ramp, ["g"], 50), year.typical_month(ramp, ["g"]), ["g"], 12, 50)
    assert sorted((r["first_month"], r["last_month"]) for r in made.collect()) == [(1, 2), (3, 3)]
    tiers = frame(spark, "plan long, level int, months int, ded_applies boolean", (1, 1, 1, True), (1, 0, 1, False), (2, 1, 1, False), (3, 1, 3, False))
    assert {r["plan"]: r["rule"] for r in year.rule_of(tiers).collect()} == {1: "classic", 2: "gross", 3: "classic"}
    limits = {r["year"]: (r["cap"], r["standard"]) for r in year.parameters(frame(spark, "year int, cap int, standard int", (2026, 2150, None), (2030, 3000, 900))).collect()}
    assert limits == {2025: (2000, 590), 2026: (2150, 615), 2027: (2400, 700), 2030: (3000, 900)}


def test_text_and_checks(spark):
    L = F.lit
    assert value(spark, clean.listed(L("a 1,000 mg, b,c 2,50"))) == ["a 1,000 mg", "b", "c 2", "50"]
    assert [tuple(x) for x in value(spark, clean.paired_lists(L("a,b"), L("1,2,3")))] == [("a", None), ("b", None)]
    assert [value(spark, text.is_injected(L(x))) for x in ("Humalog KwikPen", "Ozempic", "Pencil", "Enoxaparin syringe")] == [False, True, True, True]
    assert value(spark, text.is_insulin(L("LANTUS"))) is True
    assert value(spark, text.street_key(L("12 North Avenue-West, Apt 4"))) == "12 N AVENUE-WEST" and value(spark, text.place_key(L("Saint-Cloud City"))) == "st-cloud"
    assert [value(spark, text.monthly_amount(L(x))) for x in ("half tab q12h", "two capsules every 6 hours", "as directed daily", "1.5 tabs in the evening")] == [30, 240, None, 45]
    assert value(spark, text.tidy(L("providers[0].last_name :  zip_code unclear -"))) == "Doctor's name : ZIP unclear"
    assert value(spark, text.display_dose(L("Cytomel"), L(".0125 MG"))) == "12.5 mcg"
    assert tuple(value(spark, resolve.dose_form(L("x 5 mg/ml pen-injector")))) == ("inj", "pen") and tuple(value(spark, resolve.dose_form(L("x 5 mg chewable tab")))) == ("tab", "chew")
    assert [value(spark, resolve.release(L(x))) for x in ("a ER tab", "a 24 hr cap", "a DR cap", "a 5 mg/hr patch", "a")] == ["er", "er", "dr", "ir", "ir"]
    assert tuple(value(spark, resolve.gated(L(" water pill "), L("furosemide"), L(0.4)))) == ("water pill", "possibly furosemide")
    few = spark.range(5)
    assert quality.at_least(few, "id", 5).count() == 5
    with pytest.raises(Exception, match="5 different id, 6 needed"):
        quality.at_least(few, "id", 6).collect()
