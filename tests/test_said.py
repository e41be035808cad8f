"""Texts of benefits, cost shares and costs by hand-made cases."""

from pyspark.sql import functions as F

from tiermark.functions import said
from tiermark.operators.benefits import RULES, cost_shares


def test_benefit_texts(spark):
    names = list(RULES)
    cases = [
        ({}, {"oop_max": "—", "deductible": "—", "part_b_giveback": None, "pcp_visit": "—", "dental": "See plan", "fitness": "—"}),
        ({"oop_max_inn": 0.0, "oop_max_comb": 8900.0, "medical_deductible": 0.0}, {"oop_max": "$8,900", "deductible": "$0"}),
        ({"oop_max_inn": 0.0}, {"oop_max": "—"}),
        ({"oop_max_inn": 4900.0, "oop_max_comb": 8900.0}, {"oop_max": "$4,900"}),
        ({"oop_max_comb": 0.0}, {"oop_max": "$0"}),
        ({"part_b_giveback": 1250.5}, {"part_b_giveback": "+$1,250 / mo"}),
        ({"part_b_giveback": 0.0}, {"part_b_giveback": None}),
        ({"pcp_copay": 0.0, "spec_coins": 20.0, "er_copay": 120.0, "er_coins": 5.0}, {"pcp_visit": "$0", "specialist_visit": "20%", "emergency_room": "$120"}),
        ({"hosp_copay": 295.0, "hosp_day_begin": 1.0, "hosp_day_end": 6.0}, {"hospital_per_day": ("$295", "days 1–6")}),
        ({"hosp_copay": 295.0, "hosp_day_begin": 1.0}, {"hospital_per_day": ("$295", "per stay")}),
        ({"hosp_coins": 20.0, "hosp_day_begin": 1.0, "hosp_day_end": 6.0}, {"hospital_per_day": ("20%", None)}),
        ({"dental_allowance": 1500.0, "hearing_allowance": 0.0, "fitness_included": 1.0}, {"dental": "$1,500", "hearing": "$0", "fitness": "Included"}),
    ]
    df = spark.createDataFrame([(i, *[c.get(n) for n in names]) for i, (c, _) in enumerate(cases)], ", ".join(["id long", *[f"{n} double" for n in names]]))
    got = {r.id: r.asDict() for r in df.select("id", *[c.alias(n) for n, c in said.benefit_texts().items()]).collect()}
    for i, (case, want) in enumerate(cases):
        for k, v in want.items():
            assert (tuple(got[i][k]) if isinstance(v, tuple) else got[i][k]) == v, (case, k)


COSTS = "plan string, tier int, segment int, days int, pref_type int, pref_amount double, std_type int, std_amount double, mail_type int, mail_amount double, ded_applies string, insulin boolean"


def test_cost_shares(spark):
    rows = [
        ("a", 1, 2, 1, 1, 9.0, 1, 9.0, 0, 0.0, "N", False),
        ("a", 1, 1, 1, 1, 47.0, 1, 52.5, 1, 90.0, "Y", False),
        ("a", 1, 1, 2, 1, 141.0, 1, 156.0, 1, 94.0, "Y", False),
        ("b", 2, 0, 1, 2, 0.255, 2, 0.255, 0, 0.0, None, None),
        ("c", 3, 0, 1, 1, 1000.0, 2, 0.0, 2, 0.2, "N", True),
        ("d", 4, 0, 2, 1, 5.0, 1, 5.0, 1, 5.0, "N", False),
        ("e", 5, 0, 1, 0, 0.0, 2, 0.0, 0, 0.0, "N", False),
        ("f", 5, 0, 1, 0, 0.0, 0, 0.0, 0, 0.0, "N", False),
        ("f", 5, 0, 1, 0, 0.0, 0, 0.0, 0, 0.0, "N", False),
        ("g", 1, None, 1, 1, None, 1, None, None, None, "Y", False),
    ]
    got = {r.plan: tuple(r)[2:] for r in cost_shares(spark.createDataFrame(rows, COSTS), ["plan", "tier"]).collect()}
    assert got == {
        "a": ("$47 copay", "$52.50 copay", "$94 copay", True, False, "$47 copay (preferred pharmacy) · $52.50 copay standard · deductible applies", "$47 copay pref. · ded. applies"),
        "b": ("25.5% coinsurance", None, None, True, False, "25.5% coinsurance · deductible applies", "25.5% · ded. applies"),
        "c": ("$1,000 copay", "$0", None, False, True, "$35/month max (insulin)", "$35/mo max (insulin)"),
        "e": ("$0", None, None, False, False, "$0 · no deductible", "$0 · no ded."),
        "f": (None, None, None, False, False, "no deductible", " · no ded."),
        "g": ("$0 copay", None, None, True, False, "$0 copay · deductible applies", "$0 copay · ded. applies"),
    }
    assert cost_shares(spark.createDataFrame([], COSTS), ["plan", "tier"]).count() == 0


def test_distance_and_month(spark):
    df = spark.createDataFrame([(0, 1), (10, 12), (15, None), (123, 5)], "t long, m int")
    got = [tuple(r) for r in df.select(said.distance(F.col("t")), said.distance(F.col("t"), F.col("t") == 15), said.month(F.col("m"))).collect()]
    assert got == [("0 mi", "0 mi", "Jan"), ("1 mi", "1 mi", "Dec"), ("1.5 mi", "~1.5 mi", None), ("12.3 mi", "12.3 mi", "May")]
