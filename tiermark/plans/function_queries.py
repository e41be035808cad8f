"""Queries of parsing, cleaning and text functions (B and H rows) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermark.functions import clean, labels, said, text
from tiermark.functions.geo import miles
from tiermark.operators import benefits, gates
from tiermark.plans.proxies import Tables
from tiermark.plans.registry import query


@query("b1_money", """select o_orderkey, try_cast(replace(replace(case when o_orderkey % 50 = 0 then 'n/a' else '$' || floor(o_totalprice)::bigint || ',' || '000' end, '$', ''), ',', '') as double) as amount from orders""")
def b1(t: Tables) -> DataFrame:
    written = F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"), F.lit(",000")))
    return t.read("orders").select("o_orderkey", clean.money(written).alias("amount"))


@query("b2_numbers", """select p_partkey, coalesce(try_cast(trim(v) as double), 0) as or_zero, try_cast(trim(v) as double) as or_null from (select p_partkey, case p_partkey % 4 when 0 then '.' when 1 then '' when 2 then ' ' || p_size else 'x' end as v from part)""")
def b2(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, ".").when(k == 1, "").when(k == 2, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("x")
    return t.read("part").select("p_partkey", clean.number_or_zero(v).alias("or_zero"), F.trim(v).try_cast("double").alias("or_null"))


@query("b3_total_premium", "select plan, coalesce(case when plan % 3 <> 0 then premium end, giveback + deductible)::bigint as premium from plans")
def b3(t: Tables) -> DataFrame:
    total = F.when(F.col("plan") % 3 != 0, F.col("premium"))
    return t.plans.select("plan", clean.total_premium(total, F.col("giveback"), F.col("deductible")).cast("long").alias("premium"))


@query("b4_ids", """select s_suppkey, case when length(s_suppkey::varchar) >= 3 then s_suppkey::varchar else lpad(s_suppkey::varchar, 3, '0') end as plan_id,
    case when length(n) = 12 and n like '10%' then substr(n, 3) else n end as npi from (select s_suppkey, case when s_suppkey % 2 = 0 then '10' || lpad(s_suppkey::varchar, 10, '0') else lpad(s_suppkey::varchar, 10, '1') end as n from supplier)""")
def b4(t: Tables) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    n = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("10"), F.lpad(k, 10, "0"))).otherwise(F.lpad(k, 10, "1"))
    return t.read("supplier").select("s_suppkey", clean.padded(k, 3).alias("plan_id"), clean.pharmacy_id(n).alias("npi"))


@query("b5_first_rule", """select p_partkey, case when regexp_matches(p_name, '^red') then 'Red family' when regexp_matches(p_name, 'widget|gear') then 'Machine' else p_name end as label from part""")
def b5(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", clean.first_rule(F.col("p_name"), [("^red", "Red family"), ("widget|gear", "Machine")]).alias("label"))


#: How official names are written in the proxy, and what is left of them, by a plan's remainder.
OFFICIAL = [("AARP Medicare Advantage from UHC MN-1 (PPO)", "UHC MN-1 (PPO)", "UHC"), ("HumanaChoice H5216-275 (PPO)", "Choice (PPO)", "Choice (PPO)"), ("Medica", "Medica", "Medica"), ("AARP Rx Saver from UHC (PDP)", "AARP Rx Saver (PDP)", "UHC"), ("Other Plan S1234-001", "Other Plan", "Other Plan"), ("", None, None)]


@query("b5_plan_names", f"""with carriers as (select n_nationkey, 'H' || lpad(n_nationkey::varchar, 4, '0') as contract, n_name as carrier from nation where n_nationkey % 3 <> 0), named as (select plan, plan_name, family as nation, plan % 7 as k from plans)
    select plan, case k {' '.join(f"when {i} then '{b}'" for i, (_, b, _) in enumerate(OFFICIAL) if b)} else plan_name end as shown, case k {' '.join(f"when {i} then '{c}'" for i, (_, _, c) in enumerate(OFFICIAL) if c)} else plan_name end as family, coalesce(carrier, case when plan % 2 = 0 then 'org ' || nation else 'H' || lpad(nation::varchar, 4, '0') end) as carrier from named left join carriers on n_nationkey = nation""")
def b5_names(t: Tables) -> DataFrame:
    """Plans' official names as they are shown, their carrier by contract, else the organisation, else the contract."""
    nation = t.read("nation").select(F.format_string("H%04d", "n_nationkey").alias("contract"), F.col("n_name").alias("known"), "n_nationkey")
    official = F.get(F.array(*[F.lit(o) for o, _, _ in OFFICIAL], F.lit(None).cast("string")), (F.col("plan") % 7).cast("int"))
    rows = t.plans.select("plan", "plan_name", official.alias("official"), labels.contract_key(F.format_string(" h%04d ", "family")).alias("contract"), F.when(F.col("plan") % 2 == 0, F.format_string(" org %d", "family")).alias("org"))
    both = rows.join(nation.where("n_nationkey % 3 <> 0").select("contract", "known"), "contract", "left")
    shown = labels.plan_name(F.col("official"), F.col("plan_name"))
    return both.select("plan", shown.alias("shown"), labels.family(shown).alias("family"), F.coalesce("known", F.trim("org"), "contract").alias("carrier"))


COST_COLUMNS = "select plan, tier, (plan + tier) % 3 as pt, cost_amt * 1.0 as pa, (plan * tier) % 3 as st, cost_amt + 5.0 as sa from tier_cost"


@query("b8_cost_columns", f"""select plan, tier, case when pt in (1, 2) then pt when st in (1, 2) then st else 0 end::int as kind, case when pt in (1, 2) then pa when st in (1, 2) then sa else 0 end::double as amount from ({COST_COLUMNS})""")
def b8(t: Tables) -> DataFrame:
    pt, st = (F.col("plan") + F.col("tier")) % 3, (F.col("plan") * F.col("tier")) % 3
    chosen = clean.chosen_cost(pt.cast("int"), F.col("cost_amt"), st.cast("int"), F.col("cost_amt") + 5)
    return t.tier_cost.select("plan", "tier", chosen.alias("x")).select("plan", "tier", "x.kind", "x.amount")


@query("b9_mail_fallback", f"select plan, tier, case when pt in (1, 2) then pa else sa end::double as mail_amount from ({COST_COLUMNS})")
def b9(t: Tables) -> DataFrame:
    pt = (F.col("plan") + F.col("tier")) % 3
    return t.tier_cost.select("plan", "tier", F.when(pt.isin(1, 2), F.col("cost_amt") * 1.0).otherwise(F.col("cost_amt") + 5.0).alias("mail_amount"))


@query("b10_unpivot", """select plan, tier, months, case when tier % 2 = 0 then amt else amt / 100.0 end::double as amount, tier % 2 = 0 as copay from
    (select plan, premium % (10 * tier + 7) as amt, tier, months from plans, (values (1), (2), (3)) a(tier), (values (1), (3)) m(months))""")
def b10(t: Tables) -> DataFrame:
    """Wide columns, one for each tier and supply, as rows."""
    cols = {(k, m): f"tier_{k}_{m}m" for k in (1, 2, 3) for m in (1, 3)}
    wide = t.plans.select("plan", *[(F.col("premium") % (10 * k + 7)).alias(c) for (k, _), c in cols.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(m).alias("months"), F.col(c).alias("amt")) for (k, m), c in cols.items()])
    long = wide.select("plan", F.explode(rows).alias("x")).select("plan", "x.*")
    copay = F.col("tier") % 2 == 0
    return long.select("plan", "tier", "months", F.when(copay, F.col("amt").cast("double")).otherwise(F.col("amt") / 100.0).alias("amount"), copay.alias("copay"))


@query("b11_synthesised", """select plan, tier, 'initial' as level, cost_amt::bigint as amt from tier_cost where plan % 9 <> 0 union all select plan, tier, 'catastrophic', 0 from tier_cost where plan % 9 <> 0
    union all select plan, tier, 'standard', 25 from plans, (values (1), (2), (3), (4), (5)) v(tier) where plan % 9 = 0""")
def b11(t: Tables) -> DataFrame:
    has = t.tier_cost.where("plan % 9 <> 0").select("plan", "tier", F.lit("initial").alias("level"), F.col("cost_amt").cast("long").alias("amt"))
    zero = has.select("plan", "tier", F.lit("catastrophic").alias("level"), F.lit(0).cast("long").alias("amt"))
    none = t.plans.select("plan").join(has.select("plan").distinct(), "plan", "left_anti")
    standard = none.select("plan", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("tier"), F.lit("standard").alias("level"), F.lit(25).cast("long").alias("amt"))
    return has.unionByName(zero).unionByName(standard)


@query("b12_gated_benefits", """select plan, case when plan % 2 = 1 then case when plan % 4 = 1 then premium % 50 else null end end::bigint as copay, case when plan % 2 = 1 then coalesce(case when plan % 4 = 1 then premium % 50 end, premium % 30) end::bigint as share from plans""")
def b12(t: Tables) -> DataFrame:
    offered = F.col("plan") % 2 == 1
    copay = F.when(F.col("plan") % 4 == 1, F.col("premium") % 50)
    return t.plans.select("plan", F.when(offered, copay).alias("copay"), F.when(offered, F.coalesce(copay, F.col("premium") % 30)).alias("share"))


#: How a plan fills a gated pair of columns: a flag of yes or no, and an amount or a blank, by two remainders of its number.
def filled(yn: int, amount: int, n: int) -> tuple[Column, Column]:
    k = F.col("plan")
    return F.when(k % yn == 0, "1").when(k % yn == 1, "2"), F.when(k % amount == 0, " ").otherwise((k * n % 400 + 1).cast("string"))


def filled_sql(yn: int, amount: int, n: int) -> tuple[str, str]:
    return f"(plan % {yn} = 0)", f"(case when plan % {amount} > 0 then (plan * {n} % 400 + 1)::double end)"


#: Gates and amounts of the columns that benefit rules read, by their place among them.
def shape(i: int) -> tuple[int, int, int]:
    return 2 + i % 3, 2 + i % 4, 3 + 2 * i


GATED = [c for c in benefits.columns_of(benefits.RULES) if c.endswith("_yn")]
Y, N = ({c: filled_sql(*shape(i))[j] for i, c in enumerate(GATED)} for j in (0, 1))


def share_sql(area: str, name: str) -> str:
    copay, coins = f"pbp_{area}_copay_yn", f"pbp_{area}_coins_yn"
    return f"case when {Y[copay]} then coalesce({N[copay]}, 0) when {Y[coins]} then null else 0 end as {name}_copay, case when {Y[copay]} then null when {Y[coins]} then {N[coins]} end as {name}_coins"


def gated_sql(*names: str) -> str:
    return "coalesce(" + ", ".join(f"case when {Y[n + '_yn']} then {N[n + '_yn']} end" for n in names) + ", null)"


BENEFITS_SQL = f"""select plan, case when {Y['pbp_d_out_pocket_amt_yn']} then {N['pbp_d_out_pocket_amt_yn']} end as oop_max_inn, case when {Y['pbp_d_comb_max_enr_amt_yn']} then {N['pbp_d_comb_max_enr_amt_yn']} end as oop_max_comb,
  coalesce({gated_sql('pbp_d_ann_deduct', 'pbp_d_inn_deduct', 'pbp_d_comb_deduct')}, 0) as medical_deductible, {gated_sql('pbp_d_mco_pay_reduct')} as part_b_giveback, {share_sql('b7a', 'pcp')}, {share_sql('b7d', 'spec')}, {share_sql('b4a', 'er')},
  case when {Y['pbp_b1a_copay_yn']} then coalesce({N['pbp_b1a_copay_yn']}, (plan % 90)::double) when {Y['pbp_b1a_coins_yn']} then null else 0 end as hosp_copay, case when {Y['pbp_b1a_copay_yn']} then null when {Y['pbp_b1a_coins_yn']} then {N['pbp_b1a_coins_yn']} end as hosp_coins,
  case when {Y['pbp_b1a_copay_yn']} and {N['pbp_b1a_copay_yn']} is not null then 1.0 end::double as hosp_day_begin, case when {Y['pbp_b1a_copay_yn']} and {N['pbp_b1a_copay_yn']} is not null then (plan % 7 + 1)::double end as hosp_day_end,
  {gated_sql('pbp_b16c_maxplan_cmp', 'pbp_b16b_maxplan_pv')} as dental_allowance, {gated_sql('pbp_b17b_comb_maxplan')} as vision_allowance, {gated_sql('pbp_b18b_maxplan')} as hearing_allowance, {gated_sql('pbp_b13b_maxplan')} as otc_amount, case when plan % 4 = 0 or plan % 6 = 1 then 1.0 end::double as fitness_included from plans"""


@query("b12_benefit_rules", BENEFITS_SQL)
def b12_rules(t: Tables) -> DataFrame:
    """All gated benefits of a plan, by rules that are data."""
    k = F.col("plan")
    given = {}
    for i, gate in enumerate(GATED):
        flag, amount = filled(*shape(i))
        stem = gate.removesuffix("_yn")
        given[gate] = flag
        of = {s.source for r in benefits.RULES.values() for s in r.steps if s.gate == gate and s.source}
        given |= {c: amount for c in of if c in (stem, f"{stem}_amt", f"{stem}_amt_mc_min", f"{stem}_pct_mc_min", f"{stem}_mcs_amt_int1_t1", f"{stem}_mcs_pct_t1")}
    given |= {"pbp_b1a_copay_mcs_amt_t1": (k % 90).cast("string"), "pbp_b1a_copay_mcs_bgnd_int1_t1": F.lit("1"), "pbp_b1a_copay_mcs_endd_int1_t1": (k % 7 + 1).cast("string")}
    given |= {"pbp_b14c_bendesc_amo_mhc": F.when(k % 4 == 0, "1").otherwise("2"), "pbp_b14c_bendesc_typ_mhc": F.when(k % 6 == 1, "gym").otherwise(" ")}
    return benefits.benefits(t.plans.select("plan", *[v.alias(c) for c, v in given.items()]), ["plan"])


#: A tier column's number, if its plan and tier fill it: by prefix, kind and months.
TIER_PREFIXES = ("rspfd", "rsstd", "rstd", "mospfd", "mosstd", "mostd")


def tier_number(i: int, kind: int, months: int) -> str:
    return f"case when (plan + tier * {i + 2} + {3 * kind + months}) % {3 + (i + kind) % 3} = 0 then (plan * {i + 3} + tier * {kind + 5} + {months}) % 90 end"


def cost_sql(i: int, m: int) -> str:
    return f"case when ({tier_number(i, 0, m)}) is not null then {{t: 1, a: ({tier_number(i, 0, m)})::double}} when ({tier_number(i, 1, m)}) is not null then {{t: 2, a: ({tier_number(i, 1, m)}) / 100.0::double}} end"


def supply_sql(m: int) -> str:
    split = lambda i: f"case when plan % 3 = 0 then {cost_sql(i, m)} else {cost_sql(2, m)} end"
    return f"select plan, tier, {1 if m == 1 else 2} as days, coalesce({split(0)}, {split(1)}) as p, coalesce({split(1)}, {split(0)}) as s, coalesce({cost_sql(3, m)}, {cost_sql(4, m)}, {cost_sql(5, m)}, {{t: 0, a: 0.0::double}}) as o from plans, (values (1), (2), (3), (4), (5)) v(tier)"


TIERS_SQL = f"select plan, tier, days, p.t as pref_type, p.a as pref_amount, s.t as std_type, s.a as std_amount, o.t as mail_type, o.a as mail_amount from ({supply_sql(1)} union all {supply_sql(3)}) where p is not null"


@query("b10_tier_costs", TIERS_SQL)
def b10_tiers(t: Tables) -> DataFrame:
    """Wide tier columns as rows, by the grammar of their names: copay before coinsurance, split before unsplit prefixes."""
    each = t.plans.select("plan", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("tier"))
    wide = {f"mrx_tier_{p}_{kind}_{m}m": F.expr(tier_number(i, j, m)).cast("string") for i, p in enumerate(TIER_PREFIXES) for j, kind in enumerate(("copay", "coins")) for m in (1, 3)}
    wide["mrx_tier_locat_rsplt"] = F.when(F.col("plan") % 3 == 0, "1").otherwise(" ")
    return benefits.tier_costs(each.select("plan", "tier", *[c.alias(n) for n, c in wide.items()]), ["plan", "tier"])


def dollars_sql(x: str) -> str:
    return f"('$' || format('{{:,}}', round_even(({x})::double, 0)::bigint))"


def percent_sql(x: str) -> str:
    return f"(round_even(({x})::double, 0)::bigint || '%')"


def visit_sql(name: str) -> str:
    return f"coalesce({dollars_sql(name + '_copay')}, {percent_sql(name + '_coins')}, '—')"


ALLOWANCES = {"dental": "dental_allowance", "vision": "vision_allowance", "hearing": "hearing_allowance", "otc": "otc_amount"}


@query("b13_benefit_text", f"""with raw as ({BENEFITS_SQL}), large as (select * replace (case when plan % 10 = 3 then 0.0::double else oop_max_inn * 41 end as oop_max_inn, case when plan % 8 = 0 then 0.0::double else part_b_giveback end as part_b_giveback, medical_deductible * 11.5 as medical_deductible) from raw)
    select plan, coalesce({dollars_sql("case when oop_max_inn is null or oop_max_inn = 0 then oop_max_comb else oop_max_inn end")}, '—') as oop_max, coalesce({dollars_sql("medical_deductible")}, '—') as deductible, case when part_b_giveback <> 0 then '+' || {dollars_sql("part_b_giveback")} || ' / mo' end as part_b_giveback,
    {visit_sql("pcp")} as pcp_visit, {visit_sql("spec")} as specialist_visit, {visit_sql("er")} as emergency_room, {visit_sql("hosp")} as hospital_amount, case when hosp_copay is not null then case when hosp_day_begin is not null and hosp_day_end is not null then 'days ' || hosp_day_begin::bigint || '–' || hosp_day_end::bigint else 'per stay' end end as hospital_note,
    {", ".join(f"coalesce({dollars_sql(c)}, 'See plan') as {n}" for n, c in ALLOWANCES.items())}, case when fitness_included = 1 then 'Included' else '—' end as fitness, case when plan % 6 > 0 then 2 + (plan % 6) * 0.5 end::double as star_rating from large""")
def b13(t: Tables) -> DataFrame:
    """The benefits of the rules as text; limits are made larger, some zero, for the separators and the fall-backs."""
    k = F.col("plan")
    large = b12_rules(t).withColumns({
        "oop_max_inn": F.when(k % 10 == 3, 0.0).otherwise(F.col("oop_max_inn") * 41),
        "part_b_giveback": F.when(k % 8 == 0, 0.0).otherwise(F.col("part_b_giveback")),
        "medical_deductible": F.col("medical_deductible") * 11.5,
    })
    stars = F.when(k % 6 > 0, 2 + (k % 6) * 0.5).alias("star_rating")
    rows = large.select("plan", *[c.alias(n) for n, c in said.benefit_texts().items()], stars)
    return rows.select("*", F.col("hospital_per_day.amount").alias("hospital_amount"), F.col("hospital_per_day.note").alias("hospital_note")).drop("hospital_per_day")


def share_text_sql(k: str) -> str:
    return f"case when {k}_type = 1 then replace(format('${{:,.2f}}', coalesce({k}_amount, 0)::double) || ' copay', '.00 ', ' ') when {k}_type = 2 then case when coalesce({k}_amount, 0) = 0 then '$0' else format('{{:g}}', {k}_amount * 100) || '% coinsurance' end end"


SHARES_SQL = f"""shares as (select plan, tier, segment, days, {share_text_sql("pref")} as pref, {share_text_sql("std")} as std, {share_text_sql("mail")} as mail, coalesce(ded, 'Y') <> 'N' as applies, insulin from (select plan, tier, days, segment, case when pref_type = 1 then pref_amount + (plan % 4) * 0.25 + (plan % 3) * 1000 else pref_amount end as pref_amount, case when segment = 2 then 0 else pref_type end as pref_type, std_type, std_amount, mail_type, mail_amount,
    case when (plan + tier) % 3 = 0 then 'N' when (plan + tier) % 3 = 1 then 'Y' end as ded, tier = 3 and plan % 5 = 0 as insulin from ({TIERS_SQL}), (values (1), (2)) v(segment) where not (segment = 1 and plan % 7 = 0)) x),
    firsts as (select *, row_number() over (partition by plan, tier, days order by segment) as rn from shares),
    paired as (select o.plan, o.tier, coalesce(o.pref, o.std) as retail, nullif(coalesce(o.std, o.pref), coalesce(o.pref, o.std)) as standard, m.mail, o.applies, o.insulin from (select * from firsts where rn = 1 and days = 1) o left join (select * from firsts where rn = 1 and days = 2) m using (plan, tier))"""


@query("b14_cost_share_text", f"""with {SHARES_SQL} select plan, tier, retail, standard as retail_standard, mail as mail_90, applies as deductible_applies, insulin as insulin_cap,
    case when insulin then '$35/month max (insulin)' else coalesce(retail || case when standard is not null then ' (preferred pharmacy) · ' || standard || ' standard' else '' end || ' · ', '') || case when applies then 'deductible applies' else 'no deductible' end end as text,
    case when insulin then '$35/mo max (insulin)' else coalesce(replace(retail, ' coinsurance', ''), '') || case when standard is not null then ' pref.' else '' end || case when applies then ' · ded. applies' else ' · no ded.' end end as short from paired""")
def b14(t: Tables) -> DataFrame:
    """What each tier asks, from the tier columns of the benefit files, the first of a plan's segments."""
    k, tier = F.col("plan"), F.col("tier")
    amount = F.when(F.col("pref_type") == 1, F.col("pref_amount") + (k % 4) * 0.25 + (k % 3) * 1000).otherwise(F.col("pref_amount"))
    rows = b10_tiers(t).withColumn("segment", F.explode(F.array(F.lit(1), F.lit(2)))).where(~((F.col("segment") == 1) & (k % 7 == 0)))
    rows = rows.withColumn("pref_amount", amount).withColumn("pref_type", F.when(F.col("segment") == 2, 0).otherwise(F.col("pref_type")))
    applies = F.when((k + tier) % 3 == 0, "N").when((k + tier) % 3 == 1, "Y")
    return benefits.cost_shares(rows.withColumn("ded_applies", applies).withColumn("insulin", (tier == 3) & (k % 5 == 0)), ["plan", "tier"])


STATUS = """case when price is not null and flat is not null then 'insulin' when price is not null then 'covered' when drug % 5 = 0 then 'not on list' when flat is not null then 'flat only' else 'not covered' end"""


@query("b15_status", f"select client, plan, drug, {STATUS} as status from terms")
def b15(t: Tables) -> DataFrame:
    return t.terms.select("client", "plan", "drug", status().alias("status"))


def status():
    """What a plan says of a drug; the order of the cases matters."""
    known, flat = F.col("price").isNotNull(), F.col("flat").isNotNull()
    return F.when(known & flat, "insulin").when(known, "covered").when(F.col("drug") % 5 == 0, "not on list").when(flat, "flat only").otherwise("not covered")


@query("b16_yes_flags", """select p_partkey, case when f is not null then upper(trim(f)) in ('Y', 'YES', '1', 'TRUE') end as restricted from (select p_partkey, case p_partkey % 6 when 0 then ' y' when 1 then 'TRUE ' when 2 then '0' when 3 then 'No' when 4 then '1' end as f from part)""")
def b16(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 6
    f = F.when(k == 0, " y").when(k == 1, "TRUE ").when(k == 2, "0").when(k == 3, "No").when(k == 4, "1")
    return t.read("part").select("p_partkey", clean.yes(f).alias("restricted"))


@query("b17_gates", """with meta as (select p_name as key, (r_regionkey % 2)::varchar as value from region, (values (1, 'prices_estimated'), (2, 'network_estimated')) v(place, p_name) where r_regionkey = place union all select 'stars_year', '2027' from region where r_regionkey = 0 union all select 'year', ' 2027' from region where r_regionkey = 3),
    lists as (select plan % 40 as list, min(coalesce(case when plan % 40 % 3 = 0 then 'carrier' when plan % 40 % 3 = 1 then 'cms' end, 'cms')) <> 'carrier' as official from plans where plan % 40 <> 7 group by 1)
    select plan, case when coalesce((select max(value) from meta where key = 'prices_estimated'), '') <> '1' then premium end as premium, case when coalesce((select max(value) from meta where key = 'network_estimated'), '') <> '1' then family end as family, (case when (select max(value) from meta where key = 'stars_year')::int = (select max(value) from meta where key = 'year')::int then plan % 6 end)::bigint as stars,
    case when coalesce(official, false) then deductible end as deductible, coalesce(official, false) as list_official from plans p left join lists l on l.list = case when p.plan % 9 > 0 then p.plan % 40 end""")
def b17(t: Tables) -> DataFrame:
    """Columns only where their source is official: prices, networks, stars by their year, and the drug list's own source."""
    r = F.col("r_regionkey")
    keys = F.when(r == 1, "prices_estimated").when(r == 2, "network_estimated").when(r == 0, "stars_year").when(r == 3, "year")
    meta = t.read("region").select(keys.alias("key"), F.when(r.isin(1, 2), (r % 2).cast("string")).when(r == 0, "2027").otherwise(" 2027").alias("value"))
    n = F.col("plan") % 40
    lists = t.plans.where(n != 7).select(n.alias("list"), F.when(n % 3 == 0, "carrier").when(n % 3 == 1, "cms").alias("source"))
    rows = t.plans.select("plan", "premium", "family", "deductible", (F.col("plan") % 6).alias("stars"), F.when(F.col("plan") % 9 > 0, n).alias("list"))
    return gates.masked(rows, meta, {"premium": "prices", "family": "networks", "stars": "stars", "deductible": "list"}, lists).drop("list")


NEGOTIATED = "negotiated as (select name, min(cents)::bigint as price from (select split_part(drug_name, ' ', 1) as name, cents from products where drug % 7 = 0 union all select drug_name, cents from products where drug % 11 = 0) group by name)"


@query("b19_negotiated", f"with {NEGOTIATED} select drug, coalesce(a.price, b.price, cents) as price from products left join negotiated a on a.name = split_part(drug_name, ' ', 1) left join negotiated b on b.name = drug_name")
def b19(t: Tables) -> DataFrame:
    first = F.element_at(F.split("drug_name", " "), 1)
    some = t.products.where("drug % 7 = 0").select(first.alias("name"), "cents").union(t.products.where("drug % 11 = 0").select("drug_name", "cents"))
    prices = some.groupBy("name").agg(F.min("cents").alias("price"))
    a, b = prices.select(F.col("name").alias("n1"), F.col("price").alias("p1")), prices.select(F.col("name").alias("n2"), F.col("price").alias("p2"))
    return t.products.join(a, first == F.col("n1"), "left").join(b, F.col("drug_name") == F.col("n2"), "left").select("drug", F.coalesce("p1", "p2", "cents").alias("price"))


@query("b20_months_left", """select o_orderkey, m::int as month from orders, generate_series(case when year(o_orderdate) > 1996 then 1 else month(o_orderdate) end, 12) g(m)""")
def b20(t: Tables) -> DataFrame:
    months = clean.months_left(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1996))
    return t.read("orders").select("o_orderkey", F.explode(months).alias("month"))


@query("b23_fallback_premium", """select p.plan, coalesce(case when p.plan % 4 <> 0 then p.premium end, a.premium) as premium from plans p left join (select plan, min(premium) as premium from service_area group by plan) a on p.plan = a.plan""")
def b23(t: Tables) -> DataFrame:
    area = t.service_area.groupBy("plan").agg(F.min("premium").alias("area_premium"))
    return t.plans.join(area, "plan", "left").select("plan", F.coalesce(F.when(F.col("plan") % 4 != 0, F.col("premium")), F.col("area_premium")).alias("premium"))


@query("b24_state_zips", "select npi, zip from stores where lpad(zip, 5, '0') between '55001' and '55500'")
def b24(t: Tables) -> DataFrame:
    return t.stores.where(F.lpad("zip", 5, "0").between("55001", "55500")).select("npi", "zip")


@query("b25_file_label", """select o_orderkey, strftime(o_orderdate, '%b %Y') || ' file' as label from orders""")
def b25(t: Tables) -> DataFrame:
    named = F.concat(F.lit("prices_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".zip"))
    day = F.to_date(F.regexp_extract(named, r"(\d{8})", 1), "yyyyMMdd")
    return t.read("orders").select("o_orderkey", F.concat(F.date_format(day, "MMM yyyy"), F.lit(" file")).alias("label"))


WORDS_SQL = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query("h2_place_key", f"""select c_custkey, {WORDS_SQL.format("regexp_replace(regexp_replace(regexp_replace(lower(p), '[.,]', ' ', 'g'), '\\bsaint\\b', 'st', 'g'), '\\b(city|township|cdp|village)\\b', ' ', 'g')")} as place from (select c_custkey, case c_custkey % 3 when 0 then 'Saint ' when 1 then 'St. ' else '' end || c_mktsegment || case c_custkey % 2 when 0 then ' city' else ', Village' end as p from customer)""")
def h2(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    p = F.concat(F.when(k % 3 == 0, "Saint ").when(k % 3 == 1, "St. ").otherwise(""), F.col("c_mktsegment"), F.when(k % 2 == 0, " city").otherwise(", Village"))
    return t.read("customer").select("c_custkey", text.place_key(p).alias("place"))


@query("h4_street_key", """select npi, (npi % 90 + 1) || case npi % 3 when 0 then ' N' when 1 then ' S' else ' E' end || ' ST' as street, case when npi % 2 = 0 then (npi % 7)::varchar end as suite from stores""")
def h4(t: Tables) -> DataFrame:
    k = F.col("npi")
    way = F.when(k % 3 == 0, " north").when(k % 3 == 1, " South").otherwise(" East")
    street = F.concat((k % 90 + 1).cast("string"), way, F.lit(" street"), F.when(k % 2 == 0, F.concat(F.lit(", Suite #"), (k % 7).cast("string"))).otherwise(""))
    return t.stores.select("npi", text.street_key(street).alias("street"), text.suite(street).alias("suite"))


@query("h5_chain", """select s_suppkey, case s_suppkey % 4 when 0 then 'cvs' when 1 then 'mail order' when 2 then 'hy-vee' else lower(s_name) end as chain from supplier""")
def h5(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, F.concat(F.lit("CVS Pharmacy "), "s_name")).when(k == 1, F.concat("s_name", F.lit(" Mail"))).when(k == 2, F.lit("HyVee 7")).otherwise(F.col("s_name"))
    return t.read("supplier").select("s_suppkey", text.chain_of(name).alias("chain"))


DOSES = ["1 tab daily", "40 mg twice daily", "2 tablets weekly", "half pill every other day", "10 mg as needed", "5 mg q8h", "20 mg", "three capsules at bedtime"]
DOSE_SQL = "case p_partkey % 8 " + " ".join(f"when {i} then '{d}'" for i, d in enumerate(DOSES)) + " end"


def dose():
    return F.element_at(F.array(*map(F.lit, DOSES)), (F.col("p_partkey") % 8 + 1).cast("int"))


@query("h6_strip_amounts", f"""select p_partkey, case p_partkey % 8 when 0 then 'daily' when 1 then '40 mg twice daily' when 2 then 'weekly' when 3 then 'half pill every other day' when 4 then '10 mg as needed' when 5 then '5 mg' when 6 then '20 mg' else 'three capsules at bedtime' end as dose, p_partkey % 8 in (1, 4, 5, 6) as has_strength from part""")
def h6(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", text.strip_amounts(dose()).alias("dose"), text.has_strength(dose()).alias("has_strength"))


@query("h7_monthly_amount", """select p_partkey, case p_partkey % 8 when 0 then 30 when 1 then 60 when 2 then 8 when 3 then 8 when 5 then 90 when 7 then 90 end::bigint as amount from part""")
def h7(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", text.monthly_amount(dose()).alias("amount"))


@query("h8_amount_note", f"""select p_partkey, case when a is not null and p_size % 2 = 0 and a <> 30 then 'sheet says "' || d || '" (about ' || a || ' a month) - priced at 30 a month, verify' else '' end as note from (select p_partkey, p_size, {DOSE_SQL} as d, case p_partkey % 8 when 0 then 30 when 1 then 60 when 2 then 8 when 3 then 8 when 5 then 90 when 7 then 90 end as a from part)""")
def h8(t: Tables) -> DataFrame:
    label = F.when(F.col("p_size") % 2 == 0, "x 10 mg Tablet").otherwise("x cream")
    return t.read("part").select("p_partkey", text.amount_note(dose(), label, F.lit(30)).alias("note"))


@query("h9_mcg", """select p_partkey, case when p_partkey % 2 = 0 then (p_size + 1) || ' mcg' else '0.' || lpad((p_size + 1)::varchar, 3, '0') || ' mg' end as dose from part""")
def h9(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, "Synthroid tab").otherwise("Other")
    written = F.concat(F.lit("0."), F.lpad((F.col("p_size") + 1).cast("string"), 3, "0"), F.lit(" mg"))
    return t.read("part").select("p_partkey", text.display_dose(name, written).alias("dose"))


@query("h10_short_store", "select npi, left(trim(replace(split_part(store_name || ' Pharmacy #12', '#', 1), ' Pharmacy', '')), 22) as store from stores")
def h10(t: Tables) -> DataFrame:
    return t.stores.select("npi", text.short_store(F.concat("store_name", F.lit(" Pharmacy #12"))).alias("store"))


@query("h11_money_text", """select plan, case when plan % 6 = 0 then '—' else '$' || case when premium >= 100000 then (premium // 100000) || ',' || lpad((premium // 100 % 1000)::varchar, 3, '0') else (premium // 100)::varchar end || '.' || lpad((premium % 100)::varchar, 2, '0') end as said from plans""")
def h11(t: Tables) -> DataFrame:
    return t.plans.select("plan", text.money_text(F.when(F.col("plan") % 6 != 0, F.col("premium"))).alias("said"))


@query("h12_short_system", """select n_nationkey, n_name as short, n_nationkey % 3 <> 0 as legible from nation""")
def h12(t: Tables) -> DataFrame:
    mark = F.when(F.col("n_nationkey") % 3 == 0, "?").otherwise("")
    return t.read("nation").select("n_nationkey", text.short_system(F.concat("n_name", F.lit(" (formerly (other"), F.lit(")"))).alias("short"), text.legible(F.concat("n_name", mark)).alias("legible"))


@query("h13_tidy", "select p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) || ' listed' as note from part")
def h13(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", text.tidy(F.concat(F.lit("drugs["), F.col("p_size").cast("string"), F.lit("].dosage:  "), "p_name", F.lit("  listed"))).alias("note"))


@query("h14_written_name", """select c_custkey, case c_custkey % 3 when 0 then 'Dr. ' || c_name when 1 then c_mktsegment else 'as written' end as doctor from customer""")
def h14(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 3
    return t.read("customer").select("c_custkey", text.written_name(F.lit(""), F.when(k == 0, F.col("c_name")).otherwise(""), F.when(k == 1, F.col("c_mktsegment")).otherwise(""), F.lit("as written")).alias("doctor"))


@query("h1_distance", """select c_custkey, s_suppkey, floor(10 * 2 * 3958.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))::bigint as tenths
    from (select client as c_custkey, zip, lat, lon from clients) a join (select npi as s_suppkey, zip, lat, lon from stores) b on a.zip = b.zip""")
def h1(t: Tables) -> DataFrame:
    a = t.clients.select(F.col("client").alias("c_custkey"), "zip", F.col("lat").alias("a1"), F.col("lon").alias("o1"))
    b = t.stores.select(F.col("npi").alias("s_suppkey"), "zip", "lat", "lon")
    return a.join(b, "zip").select("c_custkey", "s_suppkey", F.floor(miles(F.col("a1"), F.col("o1"), F.col("lat"), F.col("lon")) * 10).cast("long").alias("tenths"))


@query("b21_parallel_lists", """with lists as (select client, string_agg(d.drug_name, ', ' order by r.pos) as names, string_agg(d.strength || case when d.drug % 3 = 0 then ',000 mg' else ' mg' end, ',' order by r.pos) || case when client % 9 = 0 then ',7' else '' end as doses from regimen r join products d on r.drug = d.drug group by client),
    cut as (select client, string_split(names, ',') as n, list_transform(string_split(regexp_replace(doses, '(\\d),(000 )', '\\1;\\2', 'g'), ','), lambda x: replace(x, ';', ',')) as d from lists)
    select client, i::int as pos, trim(n[i]) as name, case when len(n) = len(d) then d[i] end as dose from (select *, unnest(range(1, len(n) + 1)) as i from cut)""")
def b21(t: Tables) -> DataFrame:
    """Comma lists of names and doses as pairs; thousands keep their comma."""
    dose_ = F.concat(F.col("strength").cast("string"), F.when(F.col("drug") % 3 == 0, ",000 mg").otherwise(" mg"))
    rows = t.regimen.join(t.products.select("drug", "drug_name", "strength"), "drug").groupBy("client").agg(F.sort_array(F.collect_list(F.struct("pos", "drug_name", dose_.alias("dose")))).alias("x"))
    extra = F.when(F.col("client") % 9 == 0, ",7").otherwise("")
    lists = rows.select("client", F.array_join("x.drug_name", ", ").alias("names"), F.concat(F.array_join("x.dose", ","), extra).alias("doses"))
    made = lists.select("client", F.posexplode(clean.paired_lists(F.col("names"), F.col("doses"))).alias("i", "p"))
    return made.select("client", (F.col("i") + 1).alias("pos"), "p.name", F.col("p.value").alias("dose"))


@query("b22_zips", """select client, case when regexp_matches(z, '^\\d{5}(-\\d{4})?$') then substr(z, 1, 5) else z end as zip, regexp_matches(z, '^\\d{5}(-\\d{4})?$') as fine from (select client, case client % 4 when 0 then zip when 1 then zip || '-1234' when 2 then zip || '-12' else substr(zip, 2) end as z from clients)""")
def b22(t: Tables) -> DataFrame:
    """ZIPs that are valid, and the rows set aside as they were written."""
    k = F.col("client") % 4
    z = F.when(k == 0, F.col("zip")).when(k == 1, F.concat("zip", F.lit("-1234"))).when(k == 2, F.concat("zip", F.lit("-12"))).otherwise(F.substring("zip", 2, 4))
    fine, others = clean.split_valid(t.clients.select("client", z.alias("z")), clean.zip5(F.col("z")), "zip")
    return fine.select("client", "zip", F.lit(True).alias("fine")).union(others.select("client", "z", F.lit(False)))


@query("h3_name_norm", f"""select doc_id, md5({WORDS_SQL.format("regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), '.', ' '), '[''’]', '', 'g'), '\\bsaint\\b', 'st', 'g'), '[^a-z0-9& ]', ' ', 'g')")}) as name from documents""")
def h3(t: Tables) -> DataFrame:
    """Whole texts as names, by their digests."""
    return t.read("documents").select("doc_id", F.md5(text.name_norm(F.col("text"))).alias("name"))
