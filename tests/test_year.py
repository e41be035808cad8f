"""The yearly cost model against a month-by-month loop, and known cases."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tiermark.operators import year

SCHEMA = "g long, pos int, price long, fee long, cost_type int, cost_amt int, ded_applies boolean, flat long, deductible long, rule string"


def post(p, kind, amt):
    if kind == 2:
        return (p or 0) * amt
    if kind == 1:
        return min(amt * 100, p * 100) if p else amt * 100
    return 0


def loop(rows, cap, standard):
    """All fills of a group in order, with what is left of the deductible, the standard one and the cap; hundredths of a cent."""
    left, std, room = rows[0]["deductible"] * 100, standard * 10000, cap * 10000
    out = {}
    for m in range(1, 13):
        for r in sorted(rows, key=lambda r: (r["price"] is None, r["price"] or 0, r["pos"])):
            p, rule, flat = r["price"] or 0, r["rule"], r["flat"]
            full = p * 100
            if room <= 0:
                out[r["pos"], m] = 0
                continue
            subject = r["ded_applies"] and p > 0 and flat is None
            fee = lambda x, r=r: x + (r["fee"] * 100 if x > 0 else 0)
            if flat is not None:
                cost, used = flat * 100, 0
            elif not subject or left <= 0:
                cost, used = fee(post(r["price"], r["cost_type"], r["cost_amt"])), 0
            elif full >= left:
                cost, used = left + r["fee"] * 100 + post((full - left) // 100, r["cost_type"], r["cost_amt"]), left
            else:
                cost, used = full + r["fee"] * 100, full
            if rule == "classic":
                left, add = max(0, left - used), cost
            elif flat is not None:
                left, add = max(0, left - cost), cost
            elif rule == "gross":
                part = min(full, std)
                left, std = max(0, left - full), max(0, std - full)
                add = max(cost, part + (full - part) * 25 // 100)
            else:
                part = min(full, left)
                if left > 0 and subject:
                    base = cost
                else:
                    own = {2: p * r["cost_amt"], 1: r["cost_amt"] * 100}.get(r["cost_type"], 0)
                    base = fee(own if p else cost)
                left = max(0, left - full)
                add = part + max(base - min(base, part), (full - part) * 25 // 100)
            if add > room:
                cost = max(0, cost - (add - room)) if rule == "older" else min(cost, room)
                add = room
            room -= add
            out[r["pos"], m] = cost
    return out


def run(spark, rows, cap, standard):
    made = year.year_costs(spark.createDataFrame(rows, SCHEMA), ["g"], cap, standard).collect()
    by = defaultdict(dict)
    for r in made:
        by[r["g"]][r["pos"], r["month"]] = r["cost"]
    return by


@pytest.mark.parametrize("rule", ["classic", "gross", "older"])
def test_equals_loop(spark, rule):
    rng = random.Random(rule)
    rows = []
    for g in range(250):
        d = rng.choice([0, 10000, 30000, 61500, 70000])
        for pos in range(rng.randint(1, 8)):
            price = rng.choice([None, 0, rng.randint(1, 2000), rng.randint(1000, 90000), d])
            rows.append((g, pos, price, rng.choice([0, 50, 150]), rng.choice([0, 1, 1, 2, 2]), rng.choice([0, 5, 25, 30, 800, 4700]), rng.random() < 0.6, rng.choice([None] * 7 + [3500, 2367]), d, rule))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(dict(zip(names, r, strict=True)))
    got = run(spark, rows, 2400, 700)
    for g, some in groups.items():
        assert got[g] == loop(some, 2400, 700), (g, some)
        assert sum(got[g].values()) <= 2400 * 10000


def one(spark, fills, deductible, cap=99999):
    rows = [(0, i, *f, deductible, "classic") for i, f in enumerate(fills)]
    return run(spark, rows, cap, 700)[0]


def test_known_cases(spark):
    share = (30000, 0, 2, 25, True, None)
    three = one(spark, [share] * 3, 61500)
    assert [three[i, 1] for i in range(3)] == [3000000, 3000000, 150000 + 712500]
    assert sum(one(spark, [(50000, 0, 2, 25, True, None)] * 3, 61500, 2100).values()) == 21000000
    assert set(one(spark, [(None, 0, 1, 0, False, 3500)], 61500).values()) == {350000}
    assert set(one(spark, [(2000, 150, 1, 200, False, None)], 0).values()) == {35000}
    assert set(one(spark, [(400, 150, 0, 0, False, None)], 0).values()) == {0}
    assert set(one(spark, [(140, 0, 1, 1000, False, None)], 0).values()) == {14000}
    assert set(one(spark, [(None, 0, 1, 1000, False, None)], 0).values()) == {100000}
    pair = one(spark, [(30000, 0, 2, 25, True, None), (5000, 0, 2, 25, True, None)], 10000)
    assert pair[1, 1] == 500000 and pair[0, 1] == 500000 + 625000


def test_order_of_drugs_does_not_matter_and_one_sort(spark):
    rows = [(0, i, p, 50, 2, 25, True, None, 30000, "gross") for i, p in enumerate([40000, 1000, 1000, 77700])]
    turned = [(r[0], 3 - r[1], *r[2:]) for r in reversed(rows)]
    a, b = run(spark, rows, 2400, 700)[0], run(spark, turned, 2400, 700)[0]
    assert sorted(a.values()) == sorted(b.values())
    plan = year.year_costs(spark.createDataFrame(rows, SCHEMA), ["g"], 2400, 700)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_month_texts(spark):
    monthly = spark.createDataFrame([(1, m, c) for m, c in enumerate([500, 500, 300, 300, 300, 0, 0, 0, 0, 0, 0, 0], 1)], "g long, month int, cost long")
    changes = year.change_points(monthly, ["g"], 50)
    assert [(r["first_month"], r["last_month"]) for r in year.spans(changes, ["g"], 12).orderBy("first_month").collect()] == [(1, 2), (3, 5), (6, 12)]
    assert year.typical_month(monthly, ["g"]).first()["typical"] == 300
    assert year.group_year(monthly.withColumns({"ded_run": F.lit(0), "deductible": F.lit(5), "cap_run": F.lit(0), "cap_add": F.lit(0)}), ["g"], 1).first()["year"] == 1900


# Months that the public plan finder shows for two people's drugs (dollars), and their terms there as
# (price in cents, percent of the price or None for a copay of nothing), the deductible holding for what has a percent.
FINDER = [
    (
        [736.89, 374.12, 374.12, 374.12, 151.15, 0, 0, 0, 0, 0, 0, 0],
        [(2540, 25), (1220, 25), (137270, 25), *[(p, None) for p in (196, 260, 1040, 620, 3500, 320, 1220, 710, 1100, 740, 1820, 1100, 3260, 140, 350, 200, 880, 650)]],
        (8615, 2154),
    ),
    (
        [807.49, 437.87, 437.87, 437.87, 1.28, 0, 0, 0, 0, 0, 0, 0],
        [(9855, 50), (9135, 25), (137175, 25), *[(p, None) for p in (187, 135, None, 615, 3495, 765, 315, 195, 255, 735, 1815, 1095, 2265, 135, 345, 195, 635, 645)]],
        (8610, 2152),
    ),
]


@pytest.mark.parametrize("shown, terms, insulin", FINDER)
def test_months_of_the_plan_finder(spark, shown, terms, insulin):
    """A year within 15 dollars of what is shown, and the cap in the same month."""
    rows = [(0, i, p, 0, 2 if share else 1, share or 0, bool(share), None, 70000, "gross") for i, (p, share) in enumerate(terms)]
    rows.append((0, len(rows), insulin[0], 0, 0, 0, False, insulin[1], 70000, "gross"))
    made = year.group_year(year.year_costs(spark.createDataFrame(rows, SCHEMA), ["g"], 2400, 700), ["g"], 2400).first()
    assert abs(made.year / 10000 - sum(shown)) <= 15
    assert made.capped == max(m for m, paid in enumerate(shown, 1) if paid > 0)
