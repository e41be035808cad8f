"""Names that are shown and gates of what is official."""

from pyspark.sql import functions as F

from tiermark.functions import labels
from tiermark.operators import gates


def test_names(spark):
    cases = [
        ("AARP Medicare Advantage Patriot (PPO)", "Patriot (PPO)", "Medica"), ("Blue Cross Medicare Advantage Choice (PPO)", "Choice (PPO)", "Blue Cross"), ("Advantage Solution H6154-001 (HMO-POS)", "Advantage Solution (HMO-POS)", "Advantage Solution H6154-001 (HMO-POS)"),
        ("Allina Health Aetna Medicare Signature (PPO)", "Signature (PPO)", "Medica"), ("Humana ", "Humana", "Humana"), ("UHC AARP", "UHC AARP", "UHC"), (None, "short", None), ("", "short", ""), ("HumanaChoice X from UHC (PDP)", "Choice X (PDP)", "Humana"),
    ]
    df = spark.createDataFrame([(i, o) for i, (o, _, _) in enumerate(cases)], "i int, o string")
    got = {r.i: (r.n, r.f) for r in df.select("i", labels.plan_name(F.col("o"), F.lit("short")).alias("n"), labels.family(F.col("o")).alias("f")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]


def test_gates(spark):
    plans = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (3, 7, None), (4, 8, "zz"), (5, 9, "c")], "plan int, x int, list string")
    lists = spark.createDataFrame([("a", "cms"), ("b", "carrier"), ("b", "carrier"), ("c", None)], "list string, source string")
    meta = lambda *kv: spark.createDataFrame(list(kv), "key string, value string")
    shown = lambda m, gate: sorted((r.plan, r.x, r.list_official) for r in gates.masked(plans, m, {"x": gate}, lists).collect())
    assert shown(meta(), "list") == [(1, 5, True), (2, None, False), (3, None, False), (4, None, False), (5, 9, True)]
    assert [tuple(gates.gates(m).first()) for m in (meta(), meta(("prices_estimated", "1"), ("stars_year", "2027"), ("year", "2027")), meta(("network_estimated", "1"), ("stars_year", "x"), ("year", "x")), meta(("stars_year", "2026"), ("year", "2027")))] == [
        (True, True, False), (False, True, True), (True, False, False), (True, True, False),
    ]
    assert [x for _, x, _ in shown(meta(("prices_estimated", "1")), "prices")] == [None] * 5
