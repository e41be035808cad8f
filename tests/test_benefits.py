"""Rules as data against their cases."""

import pytest

from tiermark.operators.benefits import RULES, benefits, columns_of, tier_costs


def test_rules(spark):
    names = columns_of(RULES)
    cases = [
        ({}, {"medical_deductible": 0.0, "pcp_copay": 0.0, "hosp_copay": 0.0}),
        ({"pbp_b7a_copay_yn": "1", "pbp_b7a_copay_amt_mc_min": " 20 ", "pbp_b7a_coins_yn": "1", "pbp_b7a_coins_pct_mc_min": "15"}, {"pcp_copay": 20.0}),
        ({"pbp_b7a_copay_yn": "1", "pbp_b7a_copay_amt_mc_min": "."}, {"pcp_copay": 0.0}),
        ({"pbp_b7d_copay_yn": "2", "pbp_b7d_coins_yn": "1", "pbp_b7d_coins_pct_mc_min": "15"}, {"spec_coins": 15.0, "spec_copay": None}),
        ({"pbp_d_ann_deduct_yn": "1", "pbp_d_inn_deduct_yn": "1", "pbp_d_inn_deduct_amt": "250"}, {"medical_deductible": 250.0}),
        ({"pbp_d_comb_deduct_yn": "2", "pbp_d_comb_deduct_amt": "250"}, {"medical_deductible": 0.0}),
        ({"pbp_b1a_copay_yn": "1", "pbp_b1a_copay_mcs_amt_int1_t1": "275", "pbp_b1a_copay_mcs_bgnd_int1_t1": "1", "pbp_b1a_copay_mcs_endd_int1_t1": "7"}, {"hosp_copay": 275.0, "hosp_day_begin": 1.0, "hosp_day_end": 7.0}),
        ({"pbp_b1a_copay_yn": "1", "pbp_b1a_copay_mcs_amt_t1": "1500", "pbp_b1a_copay_mcs_bgnd_int1_t1": "1"}, {"hosp_copay": 1500.0, "hosp_day_begin": None}),
        ({"pbp_b1a_coins_yn": "1", "pbp_b1a_coins_mcs_pct_t1": "20"}, {"hosp_copay": None, "hosp_coins": 20.0}),
        ({"pbp_b16c_maxplan_cmp_yn": "1", "pbp_b16b_maxplan_pv_yn": "1", "pbp_b16b_maxplan_pv_amt": "500"}, {"dental_allowance": 500.0}),
        ({"pbp_b14c_bendesc_typ_mhc": "gym"}, {"fitness_included": 1.0}),
        ({"pbp_b17b_comb_maxplan_yn": "2", "pbp_b17b_comb_maxplan_amt": "200"}, {"vision_allowance": None}),
        ({"pbp_d_out_pocket_amt_yn": "1", "pbp_d_out_pocket_amt": "5,000"}, {"oop_max_inn": None}),
    ]
    rows = [(i, *[c.get(n) for n in names]) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, ", ".join(["id long", *[f"{n} string" for n in names]]))
    got = {r.id: r.asDict() for r in benefits(df, ["id"]).collect()}
    for i, (case, want) in enumerate(cases):
        for k, v in {"pcp_coins": None, "part_b_giveback": None, **want}.items():
            assert got[i][k] == v, (case, k)
    with pytest.raises(ValueError, match="pbp_d_out_pocket_amt"):
        benefits(df.drop("pbp_d_out_pocket_amt"), ["id"])


def test_tier_costs(spark):
    names = ["mrx_tier_locat_rsplt", *[f"mrx_tier_{p}_{k}_{m}m" for p in ("rspfd", "rsstd", "rstd", "mosstd", "mostd") for k in ("copay", "coins") for m in (1, 3)]]
    cases = [
        {"mrx_tier_rstd_copay_1m": "5", "mrx_tier_rstd_coins_1m": "25", "mrx_tier_mostd_coins_1m": "20"},
        {"mrx_tier_locat_rsplt": "1", "mrx_tier_rspfd_copay_1m": "0", "mrx_tier_rsstd_coins_1m": "25", "mrx_tier_rstd_copay_1m": "9", "mrx_tier_mosstd_copay_1m": "7", "mrx_tier_mostd_copay_1m": "8"},
        {"mrx_tier_locat_rsplt": "1", "mrx_tier_rsstd_copay_3m": "12"},
        {"mrx_tier_locat_rsplt": "1", "mrx_tier_rstd_copay_1m": "9"},
    ]
    df = spark.createDataFrame([(i, *[c.get(n) for n in names]) for i, c in enumerate(cases)], ", ".join(["id long", *[f"{n} string" for n in names]]))
    assert sorted(map(tuple, tier_costs(df, ["id"]).collect())) == [(0, 1, 1, 5.0, 1, 5.0, 2, 0.2), (1, 1, 1, 0.0, 2, 0.25, 1, 7.0), (2, 2, 1, 12.0, 1, 12.0, 0, 0.0)]
