"""Queries of comparison, ranking and reconciliation (C15-C20, D10-D20, F, G, Q, U, Y1-Y3, Y14 rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.operators import loads, quality, rows
from tiermark.plans.function_queries import STATUS, status
from tiermark.plans.proxies import Tables
from tiermark.plans.registry import query
from tiermark.plans.year_queries import YEAR_SQL, costs
from tiermark.sources.files import shared_folder

STATUS_SQL = f"st as (select client, plan, drug, {STATUS} as status from terms)"


def statuses(t: Tables) -> DataFrame:
    return t.terms.select("client", "plan", "drug", status().alias("status"))


@query("d12_status_counts", f"with {STATUS_SQL} select plan, count(case when status = 'covered' then 1 end) as covered, count(case when status = 'insulin' then 1 end) as insulin, count(case when status = 'not covered' then 1 end) as not_covered, count(case when status = 'not on list' then 1 end) as not_on_list from st group by plan")
def d12(t: Tables) -> DataFrame:
    names = ["covered", "insulin", "not covered", "not on list"]
    wide = statuses(t).groupBy("plan").pivot("status", names).count()
    return wide.select("plan", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n.replace(" ", "_")) for n in names])


@query("d15_all_unchecked", "select entity, bool_and(source <> 'purchase') as unchecked, count(*) as n from evidence group by entity")
def d15(t: Tables) -> DataFrame:
    return t.evidence.groupBy("entity").agg(F.bool_and(F.col("source") != "purchase").alias("unchecked"), F.count(F.lit(1)).alias("n"))


PAIRED = "paired as (select l_orderkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint) as ours, cast(round(l_extendedprice * 100) as bigint) + (l_orderkey * 37 % 4001) - 2000 as theirs, l_quantity < 3 as odd_qty, l_tax > 0.07 as taxed from lineitem)"


def paired(t: Tables) -> DataFrame:
    ours = F.round(F.col("l_extendedprice") * 100).cast("long")
    return t.read("lineitem").select("l_orderkey", "l_linenumber", ours.alias("ours"), (ours + F.col("l_orderkey") * 37 % 4001 - 2000).alias("theirs"), (F.col("l_quantity") < 3).alias("odd_qty"), (F.col("l_tax") > 0.07).alias("taxed"))


@query("d17_distinct_counts", "select plan, count(distinct county) as counties, count(distinct segment_id) as segments from service_area group by plan having count(distinct county) > 6")
def d17(t: Tables) -> DataFrame:
    made = t.service_area.groupBy("plan").agg(F.count_distinct("county").alias("counties"), F.count_distinct("segment_id").alias("segments"))
    return made.where("counties > 6")


@query("d19_buckets", f"with {STATUS_SQL} select client, plan, count(case when status in ('covered', 'insulin') then 1 end) as covered, coalesce(string_agg(case when status = 'not covered' then drug::varchar end, ',' order by drug), '') as missing, count(case when status in ('not on list', 'flat only') then 1 end) as unverified from st group by client, plan")
def d19(t: Tables) -> DataFrame:
    s = F.col("status")
    missing = F.sort_array(F.collect_list(F.when(s == "not covered", F.col("drug"))))
    made = statuses(t).groupBy("client", "plan").agg(F.count(F.when(s.isin("covered", "insulin"), 1)).alias("covered"), missing.alias("m"), F.count(F.when(s.isin("not on list", "flat only"), 1)).alias("unverified"))
    return made.select("client", "plan", "covered", F.array_join(F.transform("m", lambda d: d.cast("string")), ",").alias("missing"), "unverified")


@query("f1_sorted_plans", "select county, plan, row_number() over (partition by county order by (plan_type <> 'MA')::int, family, plan_name, plan) as place from service_area")
def f1(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("county").orderBy(F.col("plan_type") != "MA", "family", "plan_name", "plan"))
    return t.service_area.select("county", "plan", place.alias("place"))


@query("f3_worst_misses", f"with {PAIRED} select l_orderkey, l_linenumber, abs(ours - theirs) as miss from paired where abs(ours - theirs) > 500 order by miss desc, l_orderkey, l_linenumber limit 25")
def f3(t: Tables) -> DataFrame:
    """A report of the 25 largest, which is what is asked for."""
    missed = paired(t).withColumn("miss", F.abs(F.col("ours") - F.col("theirs"))).where("miss > 500")
    return missed.orderBy(F.desc("miss"), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber", "miss")


@query("f5_mail_or_store", f"""{YEAR_SQL}, sums as (select client, plan, sum(cost)::bigint as store, sum(case when drug % 4 <> 0 then cost * 9 // 10 end)::bigint as mail, bool_or(drug % 4 = 0) as partial from costs group by client, plan)
    select client, plan, case when mail is null then 'none' when mail - store > 10000 then 'costs more' when store - mail > 10000 then 'saves' else 'same' end as said, partial from sums""")
def f5(t: Tables) -> DataFrame:
    mailed = F.when(F.col("drug") % 4 != 0, F.expr("cost * 9 div 10"))
    sums = costs(t).groupBy("client", "plan").agg(F.sum("cost").alias("store"), F.sum(mailed).alias("mail"), F.bool_or(F.col("drug") % 4 == 0).alias("partial"))
    gap = F.col("mail") - F.col("store")
    said = F.when(F.col("mail").isNull(), "none").when(gap > 10000, "costs more").when(gap < -10000, "saves").otherwise("same")
    return sums.select("client", "plan", said.alias("said"), "partial")


@query("g1_left_out_everywhere", f"with {STATUS_SQL}, n as (select client, count(distinct plan) as n from st group by client) select st.client, drug, count(distinct plan) = max(n.n) as everywhere from st join n on n.client = st.client where status not in ('covered', 'insulin') group by st.client, drug")
def g1(t: Tables) -> DataFrame:
    st = statuses(t)
    n = st.groupBy("client").agg(F.count_distinct("plan").alias("n"))
    out = st.where("status not in ('covered', 'insulin')").groupBy("client", "drug").agg(F.count_distinct("plan").alias("k"))
    return out.join(n, "client").select("client", "drug", (F.col("k") == F.col("n")).alias("everywhere"))


@query("g2_year_changes", """with a as (select plan, premium from plans where plan % 7 <> 0), b as (select plan, premium + case when plan % 5 = 0 then 100 else 0 end as premium from plans where plan % 6 <> 0)
    select coalesce(a.plan, b.plan) as plan, case when a.plan is null then 'new' when b.plan is null then 'gone' when a.premium <> b.premium then 'premium ' || a.premium || ' to ' || b.premium else 'same' end as change from a full outer join b on a.plan = b.plan""")
def g2(t: Tables) -> DataFrame:
    a = t.plans.where("plan % 7 <> 0").select("plan", F.col("premium").alias("old"))
    b = t.plans.where("plan % 6 <> 0").select("plan", (F.col("premium") + F.when(F.col("plan") % 5 == 0, 100).otherwise(0)).alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), F.format_string("premium %d to %d", "old", "new")).otherwise("same")
    return a.join(b, "plan", "full").select("plan", change.alias("change"))


@query("g4_list_overlap", """with a as (select drug, tier from products where drug % 5 <> 0), b as (select drug, case when drug % 9 = 0 then 1 else tier end as tier from products where drug % 4 <> 0)
    select count(a.drug) as left_size, count(b.drug) as right_size, count(case when a.drug = b.drug then 1 end) as both, count(case when a.tier = b.tier then 1 end) as same_tier from a full outer join b on a.drug = b.drug""")
def g4(t: Tables) -> DataFrame:
    a = t.products.where("drug % 5 <> 0").select("drug", F.col("tier").alias("a"))
    b = t.products.where("drug % 4 <> 0").select("drug", F.when(F.col("drug") % 9 == 0, 1).otherwise(F.col("tier")).alias("b"))
    return a.join(b, "drug", "full").agg(F.count("a").alias("left_size"), F.count("b").alias("right_size"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("same_tier"))


@query("g5_label_union", "select o_custkey, array_to_string(list_sort(list(distinct o_orderpriority)), '|') as labels from orders group by o_custkey")
def g5(t: Tables) -> DataFrame:
    """Sets of labels, one of each half of the orders, united without repeats."""
    half = F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    rest = F.collect_set(F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderpriority")))
    made = t.read("orders").groupBy("o_custkey").agg(half.alias("a"), rest.alias("b"))
    return made.select("o_custkey", F.array_join(F.sort_array(F.array_union("a", "b")), "|").alias("labels"))


@query("q1_row_floors", "select 'plans' as name, count(*) as observed, 30 as floor, count(*) >= 30 as ok from plans union all select 'stores', count(*), 50, count(*) >= 50 from stores union all select 'captures', count(*), 1000, count(*) >= 1000 from captures")
def q1(t: Tables) -> DataFrame:
    return quality.floors({"plans": (t.plans, 30), "stores": (t.stores, 50), "captures": (t.captures, 1000)})


@query("q2_one_value", "select l_returnflag as file, count(distinct year(l_shipdate)) as years, count(distinct year(l_shipdate)) = 1 as ok from lineitem group by l_returnflag")
def q2(t: Tables) -> DataFrame:
    return quality.single_valued(t.read("lineitem").select(F.col("l_returnflag").alias("file"), F.year("l_shipdate").alias("year")), "file", "year").withColumnRenamed("values", "years")


@query("q2_gated_load", """with years as (select l_orderkey, l_linenumber, year(l_shipdate) as year from lineitem), good as (select * from years where year = 1997), next as (select * from years where year = 1997 and l_orderkey % 2 = 0)
    select 'good' as step, '' as refused, count(*) as n, sum(l_orderkey)::bigint as keys from good union all select 'mixed years', 'one year', count(*), sum(l_orderkey)::bigint from good
    union all select 'no rows', 'rows,one year', count(*), sum(l_orderkey)::bigint from good union all select 'good again', '', count(*), sum(l_orderkey)::bigint from next""")
def q2_gated(t: Tables) -> DataFrame:
    """Loads one after the other, measured in the pass that writes them: a file of another year, or without rows, changes nothing."""
    rows_ = t.read("lineitem").select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"))
    good = rows_.where("year = 1997")
    turns = [("good", good), ("mixed years", rows_.where("year >= 1997")), ("no rows", rows_.where("year = 1")), ("good again", good.where("l_orderkey % 2 = 0"))]
    measures = {"n": F.count(F.lit(1)), "years": F.collect_set("year")}
    gates = {"rows": loads.at_least("n", 1), "one year": loads.one_value("years", 1997)}
    table = shared_folder(t.spark, "q2")
    return loads.load_in_turn(turns, table, measures, gates, "l_orderkey long, l_linenumber int, year int", lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys")))


@query("q3_unmatched", "select 'plans without area' as what, count(*) as n from plans where plan not in (select plan from service_area) union all select 'products never captured', count(*) from products where drug not in (select drug from captures)")
def q3(t: Tables) -> DataFrame:
    return quality.unmatched({"plans without area": (t.plans, t.service_area, "plan"), "products never captured": (t.products, t.captures, "drug")})


@query("q4_reconciled", f"with {PAIRED} select l_orderkey, l_linenumber, ours - theirs as diff, array_to_string(list_filter([case when odd_qty then 'quantity' end, case when taxed then 'tax' end], lambda x: x is not null), ',') as reasons from paired")
def q4(t: Tables) -> DataFrame:
    reasons = quality.reasons({"quantity": F.col("odd_qty"), "tax": F.col("taxed")})
    return paired(t).select("l_orderkey", "l_linenumber", (F.col("ours") - F.col("theirs")).alias("diff"), F.array_join(reasons, ",").alias("reasons"))


@query("q5_latest_run", "select entity, arg_max(source, (source <> 'error', ts, event_id)) as source, bool_and(source = 'error') as only_errors from evidence group by entity")
def q5(t: Tables) -> DataFrame:
    good = F.col("source") != "error"
    return t.evidence.groupBy("entity").agg(F.max_by("source", F.struct(good, "ts", "event_id")).alias("source"), F.bool_and(~good).alias("only_errors"))


@query("q6_replace_if_rows", "select plan, premium from plans where plan_type = 'MA'")
def q6(t: Tables) -> DataFrame:
    """The new load if it has rows, else what there was: here the first new load has none."""
    old = t.plans.where("plan_type = 'PD'").select("plan", "premium")
    kept = quality.replace_if_rows(old, t.plans.where("plan_type = 'none'").select("plan", "premium"))
    return quality.replace_if_rows(kept, t.plans.where("plan_type = 'MA'").select("plan", "premium"))


@query("d14_grouped_warnings", f"""with {STATUS_SQL}, n as (select client, count(distinct plan) as n from st group by client), w as (select distinct client, plan, lower(case when plan % 2 = 0 then upper(drug_name) else drug_name end) as name from st join products p on p.drug = st.drug where status = 'not covered')
    select w.client, name, case when count(*) = max(n.n) and max(n.n) > 1 then 'all ' || max(n.n) || ' plans' else string_agg(plan::varchar, ', ' order by plan) end as said from w join n on n.client = w.client group by w.client, name""")
def d14(t: Tables) -> DataFrame:
    """Warnings once for a drug, however it is written, with the plans that they hold for."""
    st = statuses(t)
    n = st.groupBy("client").agg(F.count_distinct("plan").alias("n"))
    said = F.when(F.col("plan") % 2 == 0, F.upper("drug_name")).otherwise(F.col("drug_name"))
    named = st.where("status = 'not covered'").join(t.products.select("drug", "drug_name"), "drug").select("client", "plan", said.alias("written"))
    return quality.warnings(named, n, ["client"], "written", "plan").withColumnRenamed("written", "name")


@query("d16_error_bands", f"""with {PAIRED}, b as (select *, case when abs(ours - theirs) <= 100 then 'match' when abs(ours - theirs) <= 500 then 'near' when abs(ours - theirs) <= 1500 then 'off' else 'far' end as band, l_orderkey % 12 = theirs % 12 as same_month from paired)
    select band, count(*) as n, (count(*) * 10000 // (select count(*) from b))::bigint as share, count(case when same_month then 1 end) as months, count(case when odd_qty then 1 end) as quantity, count(case when taxed then 1 end) as tax from b group by band""")
def d16(t: Tables) -> DataFrame:
    """How far two sources are apart, how often their months agree, and what may be the reason."""
    rows_ = paired(t).withColumn("same_month", F.col("l_orderkey") % 12 == F.col("theirs") % 12)
    counts = {"months": F.col("same_month"), "quantity": F.col("odd_qty"), "tax": F.col("taxed")}
    counted = quality.bands(rows_, F.abs(F.col("ours") - F.col("theirs")), [(100, "match"), (500, "near"), (1500, "off")], "far", counts)
    total = counted.agg(F.sum("n").alias("all"))
    return counted.crossJoin(F.broadcast(total)).select("band", "n", F.expr("n * 10000 div all").alias("share"), *counts)  # with one row


@query("d18_tier_grid", """with asked as (select distinct p_name as name from part union select 'unknown ' || n_name from nation) select name, case when count(drug) = 0 then '?' else coalesce(min(case when form = 'STANDARD' then tier end)::varchar, '-') end as standard, case when count(drug) = 0 then '?' else coalesce(min(case when form = 'SMALL' then tier end)::varchar, '-') end as small, case when count(drug) = 0 then '?' else coalesce(min(case when form = 'PROMO' then tier end)::varchar, '-') end as promo from asked left join products on drug_name = name group by name""")
def d18(t: Tables) -> DataFrame:
    """Names by lists: the least tier, - where a list does not have it, ? for a name that no list has."""
    asked = t.read("part").select(F.col("p_name").alias("name")).union(t.read("nation").select(F.concat(F.lit("unknown "), "n_name"))).distinct()
    forms = ["STANDARD", "SMALL", "PROMO"]
    grid = t.products.groupBy(F.col("drug_name").alias("name")).pivot("form", forms).agg(F.min("tier"))
    both = asked.join(grid.withColumn("known", F.lit(True)), "name", "left")
    return both.select("name", *[F.when(F.col("known"), F.coalesce(F.col(f).cast("string"), F.lit("-"))).otherwise("?").alias(f.lower()) for f in forms])


@query("d20_system_presence", """with dir as (select s_nationkey as system, s_suppkey % 30 as town from supplier)
    select s.n_nationkey as system, count(d.town) as places, array_to_string(list_slice(list_sort(list(distinct d.town)), 1, 4), ',') as towns, case when count(d.town) > 0 then 'in' else 'verify' end as status from nation s left join dir d on s.n_nationkey = d.system group by s.n_nationkey""")
def d20(t: Tables) -> DataFrame:
    places = t.read("supplier").groupBy(F.col("s_nationkey").alias("system")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_set(F.col("s_suppkey") % 30)), 1, 4).alias("t"))
    both = t.read("nation").select(F.col("n_nationkey").alias("system")).join(places, "system", "left")
    towns = F.array_join(F.transform("t", lambda x: x.cast("string")), ",")
    return both.select("system", F.coalesce("n", F.lit(0)).cast("long").alias("places"), towns.alias("towns"), F.when(F.col("n") > 0, "in").otherwise("verify").alias("status"))


@query("g3_county_deltas", "with a as (select county, count(*) as n from service_area where plan % 2 = 0 group by county), b as (select county, count(*) as n from service_area where plan % 2 = 1 and county % 3 <> 0 group by county), d as (select coalesce(a.county, b.county) as county, coalesce(b.n, 0) - coalesce(a.n, 0) as delta, b.county is null as missing from a full outer join b on a.county = b.county) select *, row_number() over (order by delta, county) as place from d")
def g3(t: Tables) -> DataFrame:
    """Plans of a county this year and last, the largest drops first; counties are few."""
    a = t.service_area.where("plan % 2 = 0").groupBy("county").agg(F.count(F.lit(1)).alias("a"))
    b = t.service_area.where("plan % 2 = 1 and county % 3 <> 0").groupBy("county").agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, "county", "full").select("county", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta"), F.col("b").isNull().alias("missing"))
    return both.withColumn("place", F.row_number().over(Window.orderBy("delta", "county")))


INSULIN = "rates as (select plan, tier, case when plan % 6 = 0 then '.' else tier::varchar end as at, case when (plan + tier) % 3 <> 0 then 1000 * tier end as copay_pref, case when (plan + tier) % 4 <> 0 then 1500 * tier end as copay, case when plan % 5 = 0 then 10 * tier end as coins_pref, case when plan % 2 = 0 then 12 * tier end as coins from tier_cost where plan % 6 <> 0 or tier = 1)"


INSULIN_SQL = f"""with {INSULIN}, asked as (select t.client, t.plan, t.drug, t.tier, t.price, (t.client + t.plan) % 2 = 0 as preferred from terms t where t.flat is not null),
    found as (select a.*, r.at, r.copay_pref, r.copay, r.coins_pref, r.coins, row_number() over (partition by a.client, a.plan, a.drug order by (r.at = '.')::int) as rn from asked a left join rates r on r.plan = a.plan and r.at in (a.tier::varchar, '.'))
    select client, plan, drug, least(3500, case when preferred then coalesce(copay_pref, copay) else coalesce(copay, copay_pref) end, price * case when preferred then coalesce(coins_pref, coins) else coalesce(coins, coins_pref) end // 100, price)::bigint as month_cost from found where rn = 1"""


@query("y2_insulin_month", INSULIN_SQL)
def y2(t: Tables) -> DataFrame:
    """An insulin's month: the least of the cap, the plan's copay or share by the kind of store, and the price; a tier's own row before the one for all."""
    k, tier = F.col("plan"), F.col("tier")
    rates = t.tier_cost.where((k % 6 != 0) | (tier == 1)).select("plan", F.when(k % 6 == 0, ".").otherwise(tier.cast("string")).alias("at"), F.when((k + tier) % 3 != 0, 1000 * tier).alias("copay_pref"), F.when((k + tier) % 4 != 0, 1500 * tier).alias("copay"), F.when(k % 5 == 0, 10 * tier).alias("coins_pref"), F.when(k % 2 == 0, 12 * tier).alias("coins"))
    asked = t.terms.where("flat is not null").select("client", "plan", "drug", "price", ((F.col("client") + k) % 2 == 0).alias("preferred"), F.explode(F.array(F.struct(F.lit(0).alias("rank"), tier.cast("string").alias("at")), F.struct(F.lit(1).alias("rank"), F.lit(".").alias("at")))).alias("x")).select("client", "plan", "drug", "price", "preferred", "x.*")
    best = rows.first_by(asked.join(rates.withColumn("has", F.lit(True)), ["plan", "at"], "left"), ["client", "plan", "drug"], [F.col("has").isNull().alias("none"), F.col("rank")], ["price", "preferred", "copay_pref", "copay", "coins_pref", "coins"])
    own = lambda name: F.when(F.col("preferred"), F.coalesce(f"{name}_pref", name)).otherwise(F.coalesce(name, f"{name}_pref"))
    share = best.withColumn("_share", own("coins"))
    return share.select("client", "plan", "drug", F.least(F.lit(3500), own("copay"), F.expr("price * _share div 100"), F.col("price")).cast("long").alias("month_cost"))
