"""Queries of the terms of fills (Y1, Y3, Y14) over the proxy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermark.operators import terms
from tiermark.plans.compare_queries import INSULIN_SQL, y2
from tiermark.plans.proxies import Tables
from tiermark.plans.registry import query

FIELDS = ("price", "fee", "cost_type", "cost_amt", "ded_applies", "flat")

#: A plan's prices of a tier for the two kinds of store and by mail; some plans use one kind only, some lack the tier.
TIER_SQL = """priced_tiers as (select plan, tier, case when (plan + tier) % 4 = 0 then 0 else cost_type end as pref_type, cost_amt as pref_amount, case when (plan + tier) % 5 = 0 then 0 when (plan + tier) % 20 = 7 then null else cost_type end as std_type, cost_amt + 5 as std_amount,
    case when (plan + tier) % 3 = 0 then 0 else cost_type end as mail_type, case when cost_type = 1 then cost_amt * 2 + 100 else cost_amt - 5 end as mail_amount, case when ded_applies then 'Y' when plan % 9 = 4 then null else 'N' end as ded from tier_cost where (plan * 3 + tier) % 13 <> 0)"""
FILLS_SQL = f"""{TIER_SQL}, insulin as ({INSULIN_SQL}), fills as (select t.client, t.plan, t.drug, t.tier, t.price, case when t.drug % 7 = 0 then p.cents // 2 end as negotiated, case when t.plan % 4 = 0 then 0 else 150 end as brand_fee, 50 + t.plan % 4 * 10 as generic_fee, (t.client + t.plan) % 2 = 0 as preferred, t.plan % 3 = 0 as captured,
    t.flat is not null as insulin, i.month_cost, case when t.plan % 5 > 0 then t.price * 2 end as mail_price, k.plan is not null as has_row, pref_type, pref_amount, std_type, std_amount, mail_type, mail_amount, coalesce(ded, 'Y') <> 'N' as ded from terms t join products p on p.drug = t.drug left join insulin i on i.client = t.client and i.plan = t.plan and i.drug = t.drug left join priced_tiers k on k.plan = t.plan and k.tier = t.tier),
    shared as (select *, pref_type in (1, 2) as p_said, std_type in (1, 2) as s_said from fills)"""


def priced_tiers(t: Tables) -> DataFrame:
    k = F.col("plan") + F.col("tier")
    kind, amount = F.col("cost_type"), F.col("cost_amt")
    rows = t.tier_cost.where((F.col("plan") * 3 + F.col("tier")) % 13 != 0)
    return rows.select(
        "plan", "tier", F.when(k % 4 == 0, 0).otherwise(kind).alias("pref_type"), amount.alias("pref_amount"), F.when(k % 5 == 0, 0).when(k % 20 != 7, kind).alias("std_type"), (amount + 5).alias("std_amount"),
        F.when(k % 3 == 0, 0).otherwise(kind).alias("mail_type"), F.when(kind == 1, amount * 2 + 100).otherwise(amount - 5).alias("mail_amount"),
        F.when(F.col("ded_applies"), "Y").when(F.col("plan") % 9 != 4, "N").alias("ded_applies"), F.lit(True).alias("has_row"),
    )


def fills(t: Tables) -> DataFrame:
    plan = F.col("plan")
    rows = t.terms.select("client", "plan", "drug", "tier", "price", F.col("flat").isNotNull().alias("insulin")).join(t.products.select("drug", "cents"), "drug")
    rows = rows.join(y2(t).withColumnRenamed("month_cost", "month"), ["client", "plan", "drug"], "left").join(priced_tiers(t), ["plan", "tier"], "left")
    return rows.withColumns({
        "negotiated": F.when(F.col("drug") % 7 == 0, F.expr("cents div 2")), "brand_fee": F.when(plan % 4 == 0, 0).otherwise(150), "generic_fee": 50 + plan % 4 * 10,
        "preferred": (F.col("client") + plan) % 2 == 0, "captured": plan % 3 == 0, "mail_price": F.when(plan % 5 > 0, F.col("price") * 2),
    })


def flat_sql() -> str:
    return "case when insulin then case when captured then coalesce(month_cost, 3500) else 3500 end"


KIND = "case when preferred then case when p_said then pref_type when s_said then std_type else 0 end else case when s_said then std_type when p_said then pref_type else 0 end end"
AMOUNT = "case when preferred then case when p_said then pref_amount when s_said then std_amount else 0 end else case when s_said then std_amount when p_said then pref_amount else 0 end end"


@query("y1_terms", f"""with {FILLS_SQL} select client, plan, drug, (case when insulin then case when captured then price end when has_row then case when not captured and negotiated is not null then negotiated else price end end)::bigint as price,
    (case when insulin or not has_row then null when captured then 0 when (negotiated is not null or tier >= 3) and brand_fee > 0 then brand_fee else generic_fee end)::bigint as fee, case when not insulin and has_row then {KIND} end::int as cost_type, case when not insulin and has_row then {AMOUNT} end::bigint as cost_amt,
    case when not insulin and has_row then ded end as ded_applies, ({flat_sql()} when not has_row then 0 end)::bigint as flat from shared""")
def y1(t: Tables) -> DataFrame:
    return terms.fill_terms(fills(t)).select("client", "plan", "drug", *[f"terms.{f}" for f in FIELDS])


@query("y3_mail_terms", f"""with {FILLS_SQL} select client, plan, drug, insulin or coalesce(mail_type in (1, 2), false) as offered, (case when insulin then case when captured and mail_price > 0 then mail_price // 3 end when mail_type in (1, 2) then case when captured then case when mail_price > 0 then mail_price // 3 end else coalesce(negotiated, price) end end)::bigint as price,
    case when not insulin and mail_type in (1, 2) then 0 end::bigint as fee, case when not insulin and mail_type in (1, 2) then mail_type end::int as cost_type, (case when insulin then null when mail_type = 2 then mail_amount when mail_type = 1 then mail_amount // 3 end)::bigint as cost_amt,
    case when not insulin and mail_type in (1, 2) then ded end as ded_applies, ({flat_sql()} end)::bigint as flat from shared""")
def y3(t: Tables) -> DataFrame:
    return terms.mail_terms(fills(t)).select("client", "plan", "drug", "offered", *[f"terms.{f}" for f in FIELDS])


PHASE = "case when k.plan is null then null when kind = 0 then 0 when kind = 2 then retail * amount // 100 else least(amount, retail) end"


@query("y14_predicted_phase", f"""with {TIER_SQL}, said as (select *, pref_type in (1, 2) as p_said, std_type in (1, 2) as s_said from priced_tiers), kinds as (select *, {KIND} as kind, {AMOUNT} as amount from said, (values (true), (false)) v(preferred)),
    asked as (select c.*, p.tier, c.l_linenumber % 2 = 0 as preferred, c.drug % 17 = 0 as insulin, case when c.plan % 3 > 0 then case when c.l_linenumber % 2 = 0 then 900 * p.tier else 1200 * p.tier end end as copay, case when c.plan % 2 = 0 then 5 * p.tier end as coins from captures c join products p on p.drug = c.drug)
    select l_orderkey, l_linenumber, (case when insulin then least(3500, copay, coins * retail // 100, nullif(retail, 0)) when coalesce(k.ded, 'Y') <> 'N' and k.plan is not null then retail else {PHASE} end)::bigint as deductible_phase, (case when insulin then least(3500, copay, coins * retail // 100, nullif(retail, 0)) else {PHASE} end)::bigint as initial_phase
    from asked a left join kinds k on k.plan = a.plan and k.tier = a.tier and k.preferred = a.preferred""")
def y14(t: Tables) -> DataFrame:
    """What a captured price should be before and after the deductible, by the kind of store, as evidence of which phase it was in."""
    preferred = F.col("l_linenumber") % 2 == 0
    rows = t.captures.withColumnRenamed("retail", "price").join(t.products.select("drug", "tier"), "drug").join(priced_tiers(t), ["plan", "tier"], "left")
    copay = F.when(F.col("plan") % 3 > 0, F.when(preferred, 900 * F.col("tier")).otherwise(1200 * F.col("tier")))
    asked = rows.withColumns({"preferred": preferred, "insulin": F.col("drug") % 17 == 0, "copay": copay, "coins": F.when(F.col("plan") % 2 == 0, 5 * F.col("tier"))})
    return terms.phases(asked).select("l_orderkey", "l_linenumber", "deductible_phase", "initial_phase")
