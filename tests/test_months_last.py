"""The yearly model repeats rows by month last: no month of a fill is shuffled."""

import pytest

from tiermark.operators import year
from tiermark.plans.all_queries import QUERIES
from tests.test_year import SCHEMA

NAMES = ["h15_cost_story", "f4_store_grid", "y10_by_channel", "u3_switches", "d9_store_totals", "f2_cheapest_plan", "y5_first_fill", "y6_year_classic", "y7_year_gross", "e9_free_from", "d13_typical_month", "f5_mail_or_store"]


@pytest.mark.parametrize("name", NAMES)
def test_no_month_is_shuffled(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.rindex("[month#")].splitlines()[:-1]
    assert "[month#" in plan and not any("Exchange" in line or "Sort [" in line and "month" in line for line in above)


def test_amounts_below_zero_are_refused(spark):
    rows = spark.createDataFrame([(0, 0, -5, 0, 1, 5, True, None, 100, "classic")], SCHEMA)
    with pytest.raises(Exception, match="below zero"):
        year.year_costs(rows, ["g"], 2400, 700).collect()
