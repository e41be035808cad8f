"""The yearly cost model: a shared deductible and a cap on what is paid, by running sums.

Money is in hundredths of a cent (long), so every sum is exact. All drugs of a group
are filled each month in the order of their prices; what a fill costs depends on
what the fills before it have used up, which are sums over one window each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hundredths of a cent in a cent.
UNIT = 100
# A year's cap and standard deductible in dollars, and insulin's monthly price.
PARAMETERS = {2025: (2000, 590), 2026: (2100, 615), 2027: (2400, 700)}
INSULIN = 35
MONTHS = 12
#: The share of the price that the standard benefit asks for after its deductible, in percent.
STANDARD = 25


def known(terms: DataFrame) -> DataFrame:
    """Rows whose cost can be told: those with a price or a flat amount, and those whose copay needs neither price nor deductible."""
    return terms.where("price is not null or flat is not null or (cost_type <> 2 and not ded_applies)")


def parameters(overrides: DataFrame | None = None, spark: SparkSession | None = None) -> DataFrame:
    """year, cap and standard (dollars): the fixed ones, but for what a table of overrides (year, cap, standard) has."""
    spark = spark or overrides.sparkSession
    fixed = spark.createDataFrame([(y, c, s) for y, (c, s) in sorted(PARAMETERS.items())], "year int, cap int, standard int")
    if overrides is None:
        return fixed
    own = overrides.select(F.col("year").cast("int").alias("year"), F.col("cap").cast("int").alias("_cap"), F.col("standard").cast("int").alias("_standard"))
    return fixed.join(own, "year", "full").select("year", F.coalesce("_cap", "cap").alias("cap"), F.coalesce("_standard", "standard").alias("standard"))


def rule_of(tier_cost: DataFrame) -> DataFrame:
    """plan and rule: gross where a tier of the first level and one month's supply has no deductible, else classic.

    tier_cost: plan, level, months, ded_applies.
    """
    first = F.col("level").cast("string").eqNullSafe("1") & (F.col("months") == 1)
    free = F.coalesce(F.bool_or(first & ~F.col("ded_applies")), F.lit(False))
    return tier_cost.groupBy("plan").agg(F.when(free, "gross").otherwise("classic").alias("rule"))


def post(price: Column, cost_type: Column, cost_amt: Column) -> Column:
    """What is paid after the deductible: nothing, a share of the price, or a copay up to the price.

    cost_type 1: cost_amt is cents; 2: percent. price: cents. A copay on a price of zero
    or an unknown one is charged in full.
    """
    copay = cost_amt * UNIT
    return F.when(cost_type == 2, F.coalesce(price, F.lit(0)) * cost_amt).when(cost_type == 1, F.when(F.coalesce(price, F.lit(0)) > 0, F.least(copay, price * UNIT)).otherwise(copay)).otherwise(F.lit(0)).cast("long")


def months(terms: DataFrame, first: Column | int = 1, last: int = MONTHS) -> DataFrame:
    """Each row once for each month."""
    start = F.lit(first) if isinstance(first, int) else first
    return terms.withColumn("month", F.explode(F.sequence(start, F.lit(last))))


def nominal(price: Column, cost_type: Column, cost_amt: Column) -> Column:
    """The plan's own share of the cost, a copay not held to the price."""
    return F.when(cost_type == 2, F.coalesce(price, F.lit(0)) * cost_amt).when(cost_type == 1, cost_amt * UNIT).otherwise(F.lit(0)).cast("long")


def year_costs(terms: DataFrame, groups: Sequence[str], cap: int, standard: Column | int, rule: str = "rule") -> DataFrame:
    """terms by month with cost, and ded_use, ded_run, cap_add and cap_run, what counts to the deductible and the cap.

    terms: the groups' columns, pos, price (cents, null: unknown), fee (cents), cost_type,
    cost_amt, ded_applies, flat (cents a month, null: none), deductible (cents), and rule:
    "classic" (what is paid uses up the deductible and the cap), "gross" (full prices use
    up the deductible; the cap counts what the standard benefit would ask, if more) or
    "older" (the plan's own deductible stands for the standard one). Rows whose cost is
    unknown must be left out before. cap and standard are dollars.

    Only terms are shuffled and sorted, not their months. What a fill uses up of the
    deductible is the same each month, so what is left before it falls by the same sum from
    month to month, by no less than its own price: it has one amount while more is left than
    its price, another once nothing is, and a third in the one month between at most. So is
    it with the standard deductible. What counts to the cap is thus twelve amounts of few kinds, and
    rows are repeated by month last. Amounts below zero, for which that does not hold, are
    refused. Two windows of the same partitioning and order: one shuffle, which rows that are
    already dealt by some of the groups' columns are spared, and one sort.
    """
    gross, older = F.col(rule) == "gross", F.col(rule) == "older"
    order = Window.partitionBy(*groups).orderBy("unknown", "price", "pos")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    div = lambda x, n: F.call_function("div", x, n if isinstance(n, Column) else F.lit(n))
    flat, flat_cost, r, left, std = F.col("flat").isNotNull(), F.col("flat").cast("long") * UNIT, F.col("r"), F.col("_left"), F.col("_std")
    refused = F.raise_error(F.lit("an amount below zero")).cast("long")
    rows = terms.withColumn("unknown", F.col("price").isNull()).withColumn("r", F.when((F.col("price") < 0) | (F.col("flat") < 0) | (F.col("fee") < 0), refused).otherwise(F.coalesce(F.col("price"), F.lit(0)).cast("long") * UNIT))
    subject = F.col("ded_applies") & (r > 0) & ~flat
    rows = rows.withColumn("ded_use", F.when(gross | older, F.when(flat, flat_cost).otherwise(r)).otherwise(F.when(subject, r).otherwise(zero)))
    std_use = F.when(flat, zero).otherwise(r)
    sums = lambda x: (F.coalesce(F.sum(x).over(before), zero), F.sum(x).over(whole))
    rows = rows.withColumns(dict(zip(("_ded", "_deds", "_std", "_stds"), (*sums("ded_use"), *sums(std_use)), strict=True)))
    # what is left before a row in the first month, and in the month in which it is used up
    rows = rows.withColumns({"_left": F.col("deductible").cast("long") * UNIT - F.col("_ded"), "_std": F.lit(standard).cast("long") * 100 * UNIT - std})
    after = lambda x, sum_, used: x - sum_ * F.when(used > 0, div(used - 1, F.greatest(sum_, F.lit(1))) + 1).otherwise(zero)
    rows = rows.withColumns({"_cross": after(left, F.col("_deds"), left - r), "_std_cross": after(std, F.col("_stds"), std - r + 1)})
    # a fill's cost before the cap: while the deductible holds, in the month that it is met, and after it
    fee, cross = F.col("fee").cast("long") * UNIT, F.col("_cross")
    with_fee = lambda x: x + F.when(x > 0, fee).otherwise(zero)
    past = F.when(flat, flat_cost).otherwise(with_fee(post(F.col("price"), F.col("cost_type"), F.col("cost_amt"))))
    # past the deductible the price is a part of a fill's; hundredths of a cent are whole here, as deductibles are
    met = cross + fee + post(div(r - cross, UNIT), F.col("cost_type"), F.col("cost_amt"))
    rows = rows.withColumn("_c3", past).withColumns({"_c1": F.when(subject, r + fee).otherwise(F.col("_c3")), "_c2": F.when(subject, met).otherwise(F.col("_c3"))})
    # what counts to the cap, by the deductible and, under the gross rule, by the standard one, if more
    benefit = lambda part: div((r - part) * STANDARD, 100)
    own = with_fee(F.when(r > 0, nominal(F.col("price"), F.col("cost_type"), F.col("cost_amt"))).otherwise(F.col("_c3")))
    least = lambda share, part: part + F.greatest(share - F.least(share, part), benefit(part))
    plain = ~older | flat
    rows = rows.withColumn("_own", own).withColumns(
        {
            "_p1": F.when(plain, F.col("_c1")).otherwise(least(F.when(subject, F.col("_c1")).otherwise(F.col("_own")), r)),
            "_p2": F.when(plain, F.col("_c2")).otherwise(least(F.when(subject, F.col("_c2")).otherwise(F.col("_own")), cross)),
            "_p3": F.when(plain, F.col("_c3")).otherwise(least(F.col("_own"), zero)),
            "_q1": F.when(gross & ~flat, r),
            "_q2": F.when(gross & ~flat, F.col("_std_cross") + benefit(F.col("_std_cross"))),
            "_q3": F.when(gross & ~flat, benefit(zero)),
        }
    )
    in_month = lambda x, kind: F.when(x <= 0, F.col(f"_{kind}3")).when(x <= r, F.col(f"_{kind}2")).otherwise(F.col(f"_{kind}1"))
    counts = lambda i: F.greatest(in_month(left - i * F.col("_deds"), "p"), F.when(std - i * F.col("_stds") >= r, F.col("_q1")).otherwise(in_month(std - i * F.col("_stds"), "q")))
    # one expression of twelve amounts: as twelve columns they are a method that is too long to be compiled
    rows = rows.withColumn("_adds", F.transform(F.sequence(F.lit(0), F.lit(MONTHS - 1)), counts))
    # by month, what counts before a row in that month, and of all rows
    at = [F.get("_adds", F.lit(i)) for i in range(MONTHS)]
    rows = rows.withColumns({f"_b{i}": F.coalesce(F.sum(x).over(before), zero) for i, x in enumerate(at)} | {f"_t{i}": F.sum(x).over(whole) for i, x in enumerate(at[:-1])})
    run, befores = zero, []
    for i in range(MONTHS):
        befores.append(run + F.col(f"_b{i}"))
        run = run + F.col(f"_t{i}") if i < MONTHS - 1 else run
    rows = months(rows.withColumn("_befores", F.array(*befores)).drop(*[f"_{x}{i}" for x in "bt" for i in range(MONTHS)]))
    i = F.col("month") - 1
    rows = rows.withColumns({"cap_add": F.get("_adds", i), "_before": F.get("_befores", i), "_cost0": in_month(left - i * F.col("_deds"), "c")})
    room = F.greatest(zero, F.lit(cap * 100 * UNIT).cast("long") - F.col("_before"))
    crossing = F.when(older & (F.col("cap_add") > room), F.greatest(zero, F.col("_cost0") - (F.col("cap_add") - room))).otherwise(F.least(F.col("_cost0"), room))
    cost = F.when(room <= 0, zero).otherwise(crossing)
    rows = rows.withColumns({"cost": cost, "ded_run": F.col("_ded") + i * F.col("_deds") + F.col("ded_use"), "cap_run": F.col("_before") + F.col("cap_add")})
    return rows.drop("unknown", "r", "_ded", "_deds", "_std", "_stds", "_left", "_cross", "_std_cross", "_own", "_adds", "_befores", "_before", "_cost0", *[f"_{x}{i}" for x in "cpq" for i in (1, 2, 3)])


def group_year(costs: DataFrame, groups: Sequence[str], cap: int, *more: Column) -> DataFrame:
    """For each group: year (hundredths of a cent), met and capped: the months the deductible and the cap are reached; and more aggregates."""
    top = F.lit(cap * 100 * UNIT).cast("long")
    open_before = F.col("cap_run") - F.col("cap_add") < top
    met = F.min(F.when((F.col("ded_run") >= F.col("deductible").cast("long") * UNIT) & open_before, F.col("month")))
    capped = F.min(F.when(F.col("cap_run") >= top, F.col("month")))
    return costs.groupBy(*groups).agg(F.sum("cost").alias("year"), met.alias("met"), capped.alias("capped"), *more)


def change_points(monthly: DataFrame, groups: Sequence[str], least: int) -> DataFrame:
    """The first month, and each whose cost differs by more than least from that of the last such month.

    A fold over a group's months, which are twelve.
    """
    rows = monthly.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("month", "cost"))).alias("_all"))
    kind = rows.schema["_all"].dataType
    differs = lambda kept, x: F.coalesce(F.abs(F.element_at(kept, -1)["cost"] - x["cost"]) > least, F.lit(True))
    kept = F.aggregate(F.slice("_all", 2, 12), F.slice("_all", 1, 1).cast(kind), lambda kept, x: F.when(differs(kept, x), F.array_append(kept, x)).otherwise(kept))
    return rows.select(*groups, F.explode(kept).alias("_x")).select(*groups, "_x.month", "_x.cost")


def spans(changes: DataFrame, groups: Sequence[str], last: int) -> DataFrame:
    """first_month and last_month of each run of equal months."""
    until = F.lead("month").over(Window.partitionBy(*groups).orderBy("month")) - 1
    return changes.withColumn("last_month", F.coalesce(until, F.lit(last)).cast("int")).withColumnRenamed("month", "first_month")


def ramp(changes: DataFrame, typical: DataFrame, groups: Sequence[str], last: int, near: int) -> DataFrame:
    """The spans before the first month that costs what is typical, to within near; typical: groups, typical."""
    both = spans(changes, groups, last).join(typical, list(groups))
    usual = F.abs(F.col("cost") - F.col("typical")) <= near
    start = F.min(F.when(usual, F.col("first_month"))).over(Window.partitionBy(*groups))
    return both.withColumn("_start", start).where(F.col("first_month") < F.col("_start")).drop("_start", "typical")


def typical_month(monthly: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The most frequent cost that is not zero; of equals, that of the later month."""
    counted = monthly.where("cost > 0").groupBy(*groups, "cost").agg(F.count(F.lit(1)).alias("n"), F.max("month").alias("last"))
    return counted.groupBy(*groups).agg(F.max_by("cost", F.struct("n", "last")).alias("typical"))
