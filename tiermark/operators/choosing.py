"""Which plans are offered, selected and compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EVERYWHERE, NOTHING = "All Counties", "none"
#: A network fit for each plan, as a column of its row, which has what the plan and the client have.
Fit = Callable[[DataFrame], Column]


def eligible(counties: DataFrame, area: DataFrame) -> DataFrame:
    """county and plan: plans offered in a county or in all, but stand-alone drug plans, PACE and special needs plans.

    counties: county; area: plan, plan_name, plan_type, county, list_status. The drug list
    must be there or pending.
    """
    fine = ~F.col("plan_type").isin("PDP", "PD", "PACE") & ~F.upper("plan_name").contains("SNP") & F.col("list_status").isin("present", "pending")
    asked = counties.select(F.col("county").alias("_asked"), F.explode(F.array(F.col("county"), F.lit(EVERYWHERE))).alias("county"))
    return asked.join(area.where(fine), "county").select(F.col("_asked").alias("county"), "plan").distinct()


def visible(plans: DataFrame, hidden: DataFrame) -> DataFrame:
    """plans without the hidden ones; hidden: plan (text), in which `none` means that none is hidden."""
    off = hidden.agg(F.coalesce(F.bool_or(F.lower(F.trim("plan")) == NOTHING), F.lit(False)).alias("_off"))
    names = hidden.crossJoin(F.broadcast(off)).where("not _off").select(F.trim("plan").alias("_plan"))  # with one row
    return plans.join(names, F.col("plan").cast("string") == F.col("_plan"), "left_anti")


def neutral(rows: DataFrame) -> Column:
    """A fit that knows nothing of networks."""
    return F.lit("UNKNOWN")


def by_systems(rows: DataFrame) -> Column:
    """ALL, SOME or NONE of the client's systems that the plan has; UNKNOWN if the client names none."""
    wanted, has = rows["wanted"], F.coalesce(rows["systems"], F.array().cast(rows.schema["wanted"].dataType))
    n = F.size(F.array_intersect(wanted, has))
    return F.when(wanted.isNull() | (F.size(wanted) == 0), "UNKNOWN").when(n == F.size(F.array_distinct(wanted)), "ALL").when(n == 0, "NONE").otherwise("SOME")


FITS = ("ALL", "SOME", "UNKNOWN", "NONE")


def selected(candidates: DataFrame, client: list[str], fit: Fit = neutral, doctors_first: bool = True, most: int = 3) -> DataFrame:
    """candidates with fit, cost, rank and dropped: why a plan is not among the client's `most` best.

    candidates: client's columns, plan, appointed, offered, premium, drug_premium, drugs,
    giveback. What is not appointed or not offered is dropped before the ranking; the cost
    is a year's. doctors_first ranks by fit, then cost; else by cost, then fit.
    """
    year = (12 * F.col("premium") + 12 * F.col("drug_premium") + F.col("drugs") - 12 * F.col("giveback")).cast("long")
    why = F.when(~F.col("appointed"), "carrier not appointed").when(~F.col("offered"), "not offered here")
    rows = candidates.withColumn("fit", fit(candidates)).withColumn("cost", year).withColumn("dropped", why)
    place = F.array_position(F.array(*map(F.lit, FITS)), F.col("fit"))
    order = [place, F.col("cost")] if doctors_first else [F.col("cost"), place]
    rank = F.row_number().over(Window.partitionBy(*client).orderBy(F.col("dropped").isNotNull(), *order, "plan"))
    rows = rows.withColumn("rank", F.when(F.col("dropped").isNull(), rank))
    return rows.withColumn("dropped", F.when(F.col("rank") > most, "over limit").otherwise(F.col("dropped")))


def shown(area: DataFrame, first: int = 5, drug_plans: int = 3) -> DataFrame:
    """county, plan, place: each family's best plan with drugs, filled up with the cheapest paid ones, then the cheapest drug plan of each of some families.

    area: county, plan, family, plan_type, premium, deductible. Best is by premium, type,
    deductible, then plan. A county with more families than `first` shows the cheapest.
    """
    kind = F.when(F.col("plan_type") == "MA", 0).otherwise(1)
    order = ["premium", kind, "deductible", "plan"]
    family = Window.partitionBy("county", "family", F.col("plan_type") == "PD").orderBy(*order)
    ranked = area.withColumn("_nth", F.row_number().over(family)).withColumn("_pd", F.col("plan_type") == "PD")
    # only the best of a family may cost nothing, or be a drug plan
    tries = ranked.where((F.col("_nth") == 1) | (~F.col("_pd") & (F.col("premium") > 0)))
    within = Window.partitionBy("county", "_pd").orderBy(F.col("_nth") > 1, *order)
    most = F.when(F.col("_pd"), drug_plans).otherwise(first)
    kept = tries.withColumn("_k", F.row_number().over(within)).where(F.col("_k") <= most)
    return kept.select("county", "plan", F.when(F.col("_pd"), F.col("_k") + first).otherwise(F.col("_k")).alias("place"))


def routed(plans: DataFrame, prior: DataFrame, alike: DataFrame) -> DataFrame:
    """plan, source and how: where each plan's rows of last year come from.

    plans, prior: plan, this year's and last year's; alike: plan, source. A plan of last
    year that is there this year feeds itself alone; others feed all plans alike to them.
    """
    same = prior.join(plans, "plan", "left_semi").select("plan", F.col("plan").alias("_same"))
    lent = prior.join(plans, "plan", "left_anti").select(F.col("plan").alias("source"))
    other = alike.join(lent, "source").groupBy("plan").agg(F.min("source").alias("_other"))
    how = F.when(F.col("_same").isNotNull(), "same").when(F.col("_other").isNotNull(), "alike").otherwise("none")
    return plans.join(same, "plan", "left").join(other, "plan", "left").select("plan", F.coalesce("_same", "_other").alias("source"), how.alias("how"))


def carried(rows: DataFrame, plans: DataFrame, prior: DataFrame, alike: DataFrame) -> DataFrame:
    """Last year's rows (plan and others) as those of this year's plans.

    As in routed, but a plan takes the rows of all last year's plans that it is alike to,
    and one of last year's plans feeds all this year's plans alike to it; one that is there
    this year feeds itself alone. Routes are pairs of plans, as small as the plan tables.
    """
    same = prior.join(plans, "plan", "left_semi").select(F.col("plan").alias("source"), "plan")
    lent = prior.join(plans, "plan", "left_anti").select(F.col("plan").alias("source"))
    fallback = alike.join(plans.join(prior, "plan", "left_anti"), "plan", "left_semi").join(lent, "source").select("source", "plan")
    routes = same.unionByName(fallback).distinct()
    return rows.withColumnRenamed("plan", "source").join(routes, "source")
