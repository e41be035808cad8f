"""Queries of eligibility, coverage and stores (C, D, E rows) over the proxy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.functions import clean
from tiermark.functions.geo import RADIUS as EARTH
from tiermark.operators import listed, rows, stores
from tiermark.plans.proxies import Tables
from tiermark.plans.registry import query

MILES_SQL = f"(2 * {EARTH} * asin(sqrt(least(1.0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2)))))"
#: Distances are compared and shown in tenths of a mile, so that both engines agree.
NEAR_SQL = f"near as (select client, npi, store_name, chain, preferred, floor(d * 10)::bigint as tenths from (select c.client, s.npi, s.store_name, s.chain, s.preferred, {MILES_SQL} as d from clients c join stores s on abs(s.lat - c.lat) < 1 and abs(s.lon - c.lon) < 1.5) where d <= 30)"


def near(t: Tables) -> DataFrame:
    found = stores.nearby(t.clients.select("client", "lat", "lon"), t.stores.select("npi", "store_name", "chain", "preferred", "lat", "lon"))
    return found.withColumn("tenths", F.floor(F.col("distance") * 10).cast("long"))


def near_places(t: Tables, shops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The clients' places with the stores near them, place, shops' columns and tenths; and each client with its place.

    shops: lat, lon and others: those of t.stores that can be chosen at all. Of stores at one
    point that a choice does not tell apart but by npi, the first ones are enough.
    """
    places, members = stores.by_place(t.clients.select("client", "lat", "lon"))
    return stores.nearby(places, shops).withColumn("tenths", F.floor(F.col("distance") * 10).cast("long")), members


@query("c2_our_rows", "select l_orderkey, l_linenumber, l_suppkey from lineitem where l_suppkey in (select plan from plans where plan_type = 'PD')")
def c2(t: Tables) -> DataFrame:
    ours = t.plans.where("plan_type = 'PD'").select(F.col("plan").alias("l_suppkey"))
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(ours, "l_suppkey", "left_semi")


@query("c3_list_replaced", """select distinct l_suppkey as plan, l_partkey as drug, 'published' as origin from lineitem where l_returnflag = 'R' union all
    select distinct l_suppkey, l_partkey, 'hand' from lineitem where l_returnflag = 'A' and l_suppkey not in (select l_suppkey from lineitem where l_returnflag = 'R' and l_suppkey is not null)""")
def c3(t: Tables) -> DataFrame:
    of = lambda flag, name: t.read("lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("plan"), F.col("l_partkey").alias("drug"), F.lit(name).alias("origin")).distinct()
    return rows.replaced(of("A", "hand"), of("R", "published"), ["plan"])


@query("c5_price_pools", "select p.brand, c.qty, count(*) as n, sum(c.retail)::bigint as total, min(c.retail) as least from captures c join products p on c.drug = p.drug group by p.brand, c.qty")
def c5(t: Tables) -> DataFrame:
    both = t.captures.join(t.products.select("drug", "brand"), "drug")
    return both.groupBy("brand", "qty").agg(F.count(F.lit(1)).alias("n"), F.sum("retail").alias("total"), F.min("retail").alias("least"))


@query("c6_captured_price", "select c.l_orderkey, c.l_linenumber, p.plan_name, d.drug_name, c.retail from captures c join plans p on c.plan = p.plan join products d on c.drug = d.drug where p.plan_type = 'MA' and d.tier = 2")
def c6(t: Tables) -> DataFrame:
    return t.captures.join(t.plans.where("plan_type = 'MA'").select("plan", "plan_name"), "plan").join(t.products.where("tier = 2").select("drug", "drug_name"), "drug").select("l_orderkey", "l_linenumber", "plan_name", "drug_name", "retail")


@query("c7_best_coverage", """with wants as (select client, drug as wanted, drug + k as drug from regimen, (values (0), (1), (2)) v(k)), cand as (select w.client, e.plan, w.wanted, p.p_partkey as drug, 1 + p.p_size % 5 as tier, case when (e.plan * 31 + w.drug * 17) % 10 < 8 then cast(round(p.p_retailprice * 100) as bigint) end as price from wants w join eligible e on e.client = w.client join part p on p.p_partkey = w.drug),
    best as (select client, plan, wanted, min(tier * 1000000000000 + (price is null)::int * 500000000000 + coalesce(price, 0) * 1000 + drug - wanted) as k from cand group by client, plan, wanted)
    select client, plan, wanted, (wanted + k % 1000)::bigint as drug, (k // 1000000000000)::int as tier, case when k // 500000000000 % 2 = 0 then (k % 500000000000) // 1000 end::bigint as price from best""")
def c7(t: Tables) -> DataFrame:
    """Of the products that a written drug may be, the one with the best tier and price on each plan."""
    wants = t.regimen.select("client", F.col("drug").alias("wanted"), F.explode(F.array(F.col("drug"), F.col("drug") + 1, F.col("drug") + 2)).alias("drug"))
    cand = wants.join(t.products.select("drug", "tier", "cents"), "drug").join(t.eligible, "client")
    listed = (F.col("plan") * 31 + F.col("drug") * 17) % 10 < 8
    cand = cand.withColumn("price", F.when(listed, F.col("cents")))
    best = F.min_by(F.struct("drug", "tier", "price"), F.struct("tier", F.col("price").isNull(), "price", "drug"))
    return cand.groupBy("client", "plan", "wanted").agg(best.alias("x")).select("client", "plan", "wanted", "x.drug", "x.tier", "x.price")


@query("c8_generic_fallback", """with thin as (select distinct l_suppkey as plan, l_partkey as drug from lineitem), own as (select t.client, t.plan, t.drug, x.drug as own from terms t left join thin x on x.plan = t.plan and x.drug = t.drug)
    select o.client, o.plan, o.drug, coalesce(o.own, y.drug) as used, case when o.own is not null then 'brand' when y.drug is not null then 'generic' else 'none' end as how from own o left join thin y on y.plan = o.plan and y.drug = o.drug + 7""")
def c8(t: Tables) -> DataFrame:
    thin = t.read("lineitem").select(F.col("l_suppkey").alias("plan"), F.col("l_partkey").alias("x")).distinct()
    asked = t.terms.select("client", "plan", "drug")
    tries = asked.withColumn("p", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("drug").alias("x")), F.struct(F.lit(1).alias("rank"), (F.col("drug") + 7).alias("x"))))).select("client", "plan", "drug", "p.*")
    found = tries.join(thin.withColumn("hit", F.lit(True)), ["plan", "x"], "left")
    best = found.groupBy("client", "plan", "drug").agg(F.min(F.when(F.col("hit"), F.struct("rank", "x"))).alias("b"))
    how = F.when(F.col("b.rank") == 0, "brand").when(F.col("b.rank") == 1, "generic").otherwise("none")
    return best.select("client", "plan", "drug", F.col("b.x").alias("used"), how.alias("how"))


@query("c9_store_match", """with a as (select npi, zip, npi % 30 as street, chain from stores), pairs as (select x.npi as store, y.npi, x.chain = y.chain as named from a x join a y on x.zip = y.zip and x.street = y.street)
    select store, npi from (select *, bool_or(named) over (partition by store) as anyone from pairs) where named or not anyone""")
def c9(t: Tables) -> DataFrame:
    """Stores at the same address; those that share a name word, if any do."""
    a = t.stores.select("npi", "zip", (F.col("npi") % 30).alias("street"), "chain")
    b = a.withColumnsRenamed({"npi": "store", "chain": "own"})
    pairs = b.join(a, ["zip", "street"])
    return rows.soft_filter(pairs, ["store"], F.col("own") == F.col("chain")).select("store", "npi")


#: How captures and the network write a store's name; the first two share a word.
CAPTURED_AS, NETWORK_AS = ("Cub Pharmacy #12", "Sanford Health Drug", "Coborn's Pharmacy"), ("CUB PHARMACY", "SANFORD CLINIC NORTH", "Thrifty White")


@query("c9_by_words", """with s as (select npi, npi // 8 as place, npi % 3 as name, npi % 4 as suite, (npi + 1) % 4 as other, npi % 5 as plan, npi % 11 = 0 as odd from stores),
    p as (select a.npi as store, b.npi, a.suite, b.other, a.name = b.name and a.name < 2 as named from s a join s b on a.place = b.place and a.plan = b.plan where not a.odd),
    n as (select * from (select *, bool_or(named) over (partition by store) as any_named from p) where named or not any_named)
    select store, npi from (select *, bool_or(suite > 0 and suite = other) over (partition by store) as any_suite from n) where (suite > 0 and suite = other) or not any_suite""")
def c9_by_words(t: Tables) -> DataFrame:
    """Captured stores as the network's: street and ZIP as normalised, then name words, then suites."""
    k = F.col("npi")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    place = F.floor(k / 8).cast("long")
    zip_ = F.lpad((55001 + place % 900).cast("string"), 5, "0")
    address = F.concat(place.cast("string"), F.lit(" North Main Street"), pick(("", " Suite A", ", Ste B", " Unit #C"), k % 4), F.lit(", Duluth, MN "), zip_)
    captured = t.stores.select(k.alias("store"), (k % 5).alias("plan"), pick(CAPTURED_AS, k % 3).alias("store_name"), F.when(k % 11 == 0, "no address").otherwise(address).alias("address"))
    street = F.concat(place.cast("string"), F.lit(" N. MAIN ST"), pick(("", " STE A", " ROOM B", " UNIT C"), (k + 1) % 4))
    network = t.stores.select((k % 5).alias("plan"), "npi", pick(NETWORK_AS, k % 3).alias("name"), street.alias("street"), zip_.alias("zip"))
    return stores.store_match(captured, network, ["store"])


@query("c10_nearby", f"with {NEAR_SQL} select client, npi, tenths from near")
def c10(t: Tables) -> DataFrame:
    """All pairs: distances are taken once for each place, and pairs are made where they are returned."""
    found, members = near_places(t, t.stores.select("npi", "lat", "lon"))
    return stores.of_clients(found.select("place", "npi", "tenths"), members)


AREAS_SQL = "areas as (select zip, 43.5 + (k * 77 % 900) * 0.0055 as lat, -97.0 + (k * 191 % 900) * 0.0075 as lon from (select distinct zip, zip::int - 55001 as k from stores))"
SPREAD_SQL = f"{AREAS_SQL}, shops as (select s.npi, s.zip, case when s.npi % 7 = 0 then null when s.npi % 11 = 0 then 0 else a.lat + (s.npi % 9 - 4) * 0.02 end as lat, a.lon + (s.npi % 5 - 2) * 0.02 as lon from stores s join areas a on a.zip = s.zip)"


@query("c10_by_area", f"""with {SPREAD_SQL}, reached as (select c.client, c.lat as clat, c.lon as clon, s.zip, {MILES_SQL} as centre from clients c join areas s on abs(s.lat - c.lat) < 1 and abs(s.lon - c.lon) < 1.5)
    select client, npi, floor(10 * case when s.lat is null or s.lat = 0 then centre else {MILES_SQL.replace("c.lat", "c.clat").replace("c.lon", "c.clon")} end)::bigint as tenths, s.lat is null or s.lat = 0 as approximate from reached c join shops s on s.zip = c.zip where centre <= 30""")
def c10_by_area(t: Tables) -> DataFrame:
    """Stores of the ZIP areas near a client; some have no coordinates of their own."""
    k = F.col("zip").cast("int") - 55001
    areas = t.stores.select("zip").distinct().select("zip", (43.5 + (k * 77 % 900) * 0.0055).alias("lat"), (-97.0 + (k * 191 % 900) * 0.0075).alias("lon"))
    n = F.col("npi")
    own = t.stores.select("npi", "zip").join(areas, "zip").withColumn("lat", F.when(n % 7 == 0, None).when(n % 11 == 0, 0.0).otherwise(F.col("lat") + (n % 9 - 4) * 0.02)).withColumn("lon", F.col("lon") + (n % 5 - 2) * 0.02)
    places, members = stores.by_place(t.clients.select("client", "lat", "lon"))
    found = stores.nearby_by_area(places.withColumnRenamed("place", "client"), areas, own)
    return stores.of_clients(found.select(F.col("client").alias("place"), "npi", F.floor(F.col("distance") * 10).cast("long").alias("tenths"), "approximate"), members)


@query("c11_price_key", """with keys as (select distinct plan, 'chain' || (l_orderkey % 6) as key from captures where l_orderkey % 6 <> 5 union select distinct plan, 'npi:' || (l_orderkey % 200) from captures)
    select p.plan, s.npi, coalesce(a.key, b.key) as key from plans p join stores s on (p.plan + s.npi) % 20 = 0 left join keys a on a.plan = p.plan and a.key = s.chain left join keys b on b.plan = p.plan and b.key = 'npi:' || s.npi""")
def c11(t: Tables) -> DataFrame:
    """A store's price key on a plan: its chain if that was captured, else itself if it was; the plan's network has one store in twenty."""
    k = F.col("l_orderkey")
    by_chain = t.captures.where(k % 6 != 5).select("plan", F.concat(F.lit("chain"), (k % 6).cast("string")).alias("key"))
    by_store = t.captures.select("plan", F.concat(F.lit("npi:"), (k % 200).cast("string")).alias("key"))
    keys = by_chain.union(by_store).distinct()
    pairs = t.plans.select("plan", F.pmod(-F.col("plan"), F.lit(20)).alias("k")).join(t.stores.select("npi", "chain", (F.col("npi") % 20).alias("k")), "k")
    pairs = pairs.withColumn("ka", F.col("chain")).withColumn("kb", F.concat(F.lit("npi:"), F.col("npi").cast("string")))
    a, b = keys.select("plan", F.col("key").alias("ka"), F.lit(True).alias("ha")), keys.select("plan", F.col("key").alias("kb"), F.lit(True).alias("hb"))
    both = pairs.join(a, ["plan", "ka"], "left").join(b, ["plan", "kb"], "left")
    return both.select("plan", "npi", F.coalesce(F.when(F.col("ha"), F.col("ka")), F.when(F.col("hb"), F.col("kb"))).alias("key"))


@query("c13_counties_of_plan", "select plan, count(distinct county) as counties, array_to_string(list_sort(list(distinct county)), ',') as sold_in, bool_or(county = 3) as in_three from service_area group by plan")
def c13(t: Tables) -> DataFrame:
    made = t.service_area.groupBy("plan").agg(F.sort_array(F.collect_set("county")).alias("c"))
    return made.select("plan", F.size("c").cast("long").alias("counties"), F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("sold_in"), F.array_contains("c", 3).alias("in_three"))


@query("c14_picked_plans", """with picks as (select o_orderkey, o_custkey as client, 1 + o_orderkey % 40 as plan from orders), numbered as (select p.*, row_number() over (partition by client, plan order by o_orderkey) as nth, row_number() over (partition by client order by o_orderkey) as pick from picks p)
    select n.o_orderkey, n.client, n.plan, case when pl.plan is null then 'unknown' when nth > 1 then 'duplicate' when e.plan is null then 'not sold here' when pick > 6 then 'over limit' else 'ok' end as verdict
    from numbered n left join plans pl on pl.plan = n.plan left join eligible e on e.client = n.client and e.plan = n.plan""")
def c14(t: Tables) -> DataFrame:
    picks = t.read("orders").select("o_orderkey", F.col("o_custkey").alias("client"), (1 + F.col("o_orderkey") % 40).alias("plan"))
    picks = picks.withColumn("nth", F.row_number().over(Window.partitionBy("client", "plan").orderBy("o_orderkey"))).withColumn("pick", F.row_number().over(Window.partitionBy("client").orderBy("o_orderkey")))
    both = picks.join(t.plans.select("plan", F.lit(True).alias("known")), "plan", "left").join(t.eligible.withColumn("sold", F.lit(True)), ["client", "plan"], "left")
    verdict = F.when(F.col("known").isNull(), "unknown").when(F.col("nth") > 1, "duplicate").when(F.col("sold").isNull(), "not sold here").when(F.col("pick") > 6, "over limit").otherwise("ok")
    return both.select("o_orderkey", "client", "plan", verdict.alias("verdict"))


@query("c18_dose_choice", """with labels as (select drug, drug_name || ' ' || (strength % 3) as label, strength % 3 = 0 as usual from products), asked as (select r.client, r.drug, l.label, l.usual from regimen r join labels l on l.drug in (r.drug, r.drug + 1)),
    kept as (select * from (select *, bool_or(usual) over (partition by client, drug) as anyone from asked) where usual or not anyone)
    select client, drug, case when count(distinct label) = 1 then min(label) end as label, count(distinct label) as choices from kept group by client, drug""")
def c18(t: Tables) -> DataFrame:
    labels = t.products.select(F.col("drug").alias("id"), F.concat_ws(" ", "drug_name", (F.col("strength") % 3).cast("string")).alias("label"), (F.col("strength") % 3 == 0).alias("usual"))
    asked = t.regimen.select("client", "drug", F.explode(F.array(F.col("drug"), F.col("drug") + 1)).alias("id")).join(labels, "id")
    kept = rows.soft_filter(asked, ["client", "drug"], F.col("usual"))
    n = F.count_distinct("label")
    return kept.groupBy("client", "drug").agg(F.when(n == 1, F.min("label")).alias("label"), n.alias("choices"))


LIMITS = ("QL", "PA ST", "BEST", "QL;PA", "step", "ST/QL 30")


def limits_sql(n: str) -> str:
    return f"case when ({n}) % 7 < 6 then [{', '.join(repr(x) for x in LIMITS)}][({n}) % 7 + 1] end"


@query("c19_hand_list", f"""with listed as (select p_brand as list, p_partkey as id, 1 + p_size % 5 as tier, p_partkey * 2 as pos, {limits_sql("p_partkey")} as limits from part union all select p_brand, p_partkey, 5 - p_size % 3, p_partkey * 2 - 1, {limits_sql("p_partkey + 3")} from part),
    best as (select *, min(pos) over (partition by list, id) as first, row_number() over (partition by list, id order by tier, pos) as rn from listed), codes as (select distinct l_partkey as id, l_suppkey as ndc from lineitem),
    coded as (select list, b.id, tier, limits, first, coalesce(ndc::varchar, 'RX' || b.id) as code from best b left join codes c on c.id = b.id where rn = 1)
    select list, id, code, tier, coalesce(limits like '%QL%', false) as quantity_limit, coalesce(limits like '%PA%', false) as prior_auth, coalesce(regexp_matches(limits, '\\bST\\b'), false) as step_therapy from (select *, row_number() over (partition by list, code order by first, id) as k from coded) where k = 1""")
def c19(t: Tables) -> DataFrame:
    """Lists by brand, each part on two lines; codes of all suppliers that sell it."""
    k = F.col("p_partkey")

    def line(tier, pos, n):
        limits = F.when(n % 7 < 6, F.element_at(F.array(*map(F.lit, LIMITS)), (n % 7 % 6 + 1).cast("int")))
        return F.struct(tier.cast("int").alias("tier"), pos.alias("pos"), limits.alias("limits"))

    lines = F.array(line(1 + F.col("p_size") % 5, k * 2, k), line(5 - F.col("p_size") % 3, k * 2 - 1, k + 3))
    listed_ = t.read("part").select(F.col("p_brand").alias("list"), k.alias("id"), F.explode(lines).alias("x")).select("list", "id", "x.*")
    return listed.hand_lists(listed_, t.read("lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("code")))


@query("d1_one_row_a_plan", "select plan, min(premium) as premium, arg_min(plan_name, county) as plan_name, count(distinct segment_id) as segments, count(*) as counties from service_area group by plan")
def d1(t: Tables) -> DataFrame:
    return t.service_area.groupBy("plan").agg(F.min("premium").alias("premium"), F.min_by("plan_name", "county").alias("plan_name"), F.count_distinct("segment_id").alias("segments"), F.count(F.lit(1)).alias("counties"))


@query("d2_labels", "select plan, family || case when count(*) over (partition by family) > 1 then ' ($' || premium || ')' else '' end as label from plans")
def d2(t: Tables) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("family"))
    return t.plans.select("plan", F.concat(F.col("family").cast("string"), F.when(n > 1, F.format_string(" ($%d)", "premium")).otherwise("")).alias("label"))


@query("d5_usual_quantity", "select drug, qty from (select drug, qty, row_number() over (partition by drug order by count(*) desc, max((captured_at, l_orderkey, l_linenumber)) desc) as rn from captures group by drug, qty) where rn = 1")
def d5(t: Tables) -> DataFrame:
    counted = t.captures.groupBy("drug", "qty").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("captured_at", "l_orderkey", "l_linenumber")).alias("last"))
    return counted.groupBy("drug").agg(F.max_by("qty", F.struct("n", "last")).alias("qty"))


@query("d6_plan_price", """with ranked as (select plan, drug, retail, chain, case chain when 'AF' then 1 when 'NO' then 2 end as rank, l_orderkey, l_linenumber from captures), first as (select plan, drug, arg_min(retail, (rank, l_orderkey, l_linenumber)) as price from ranked where rank is not null group by plan, drug),
    modal as (select plan, drug, retail from (select plan, drug, retail, row_number() over (partition by plan, drug order by count(*) desc, retail) as rn from ranked group by plan, drug, retail) where rn = 1)
    select m.plan, m.drug, coalesce(f.price, m.retail) as price from modal m left join first f on f.plan = m.plan and f.drug = m.drug""")
def d6(t: Tables) -> DataFrame:
    rank = F.when(F.col("chain") == "AF", 1).when(F.col("chain") == "NO", 2)
    c = t.captures.withColumn("rank", rank)
    counted = c.groupBy("plan", "drug", "retail").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "l_orderkey", "l_linenumber"))).alias("first"))
    return counted.groupBy("plan", "drug").agg(F.coalesce(F.min_by("retail", F.when(F.col("first").isNotNull(), F.col("first"))), F.max_by("retail", F.struct("n", -F.col("retail")))).alias("price"))


@query("d7_min_tier", "select brand, min(tier) as tier, count(*) as n from products group by brand")
def d7(t: Tables) -> DataFrame:
    return t.products.groupBy("brand").agg(F.min("tier").alias("tier"), F.count(F.lit(1)).alias("n"))


@query("e1_preferred_row", """with levels as (select plan, tier, level, plan % 3 as segment, (plan * level) % 50 as amt from tier_cost, (values (0), (1), (2)) v(level) where (plan + level) % 4 <> 0)
    select plan, tier, level, amt::int as amt from (select *, row_number() over (partition by plan, tier order by (level <> 1)::int, level, segment) as rn from levels) where rn = 1""")
def e1(t: Tables) -> DataFrame:
    levels = t.tier_cost.select("plan", "tier", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("level")).where("(plan + level) % 4 <> 0").withColumn("amt", ((F.col("plan") * F.col("level")) % 50).cast("int"))
    return rows.first_by(levels, ["plan", "tier"], [(F.col("level") != 1).alias("o"), F.col("level")])


@query("e2_newest_capture", "select plan, drug, chain, qty, retail from (select *, row_number() over (partition by plan, drug, chain order by captured_at desc, l_orderkey desc, l_linenumber desc) as rn from captures) where rn = 1")
def e2(t: Tables) -> DataFrame:
    return rows.newest(t.captures, ["plan", "drug", "chain"], ["captured_at", "l_orderkey", "l_linenumber"], ["qty", "retail"])


@query("e4_nearest_per_chain", f"with {NEAR_SQL} select client, chain, npi, tenths from (select *, row_number() over (partition by client, chain order by tenths, npi) as rn from near) where rn = 1")
def e4(t: Tables) -> DataFrame:
    """Once for each place, from the first store of a chain at each point."""
    found, members = near_places(t, t.stores.groupBy("lat", "lon", "chain").agg(F.min("npi").alias("npi")))
    return stores.of_clients(rows.first_by(found, ["place", "chain"], ["tenths", "npi"], ["npi", "tenths"]), members)


def greedy_sql(found: str, same: float) -> str:
    """The greedy choice as a recursive query: a client's stores one after the other, with those kept so far as a list."""
    close = f"case when k.lat is not null and r.lat is not null then {MILES_SQL.replace('c.', 'k.').replace('s.', 'r.')} < {same} else abs(k.d - r.d) < 0.05 and k.zip is not distinct from r.zip end"
    return f"""with recursive found as ({found}), ranked as (select *, row_number() over (partition by client order by d, npi) as i from found),
    walk as (select client, 0::bigint as i, []::struct(npi bigint, lat double, lon double, d double, zip varchar)[] as kept from (select distinct client from found)
      union all select w.client, r.i, case when coalesce(list_bool_or(list_transform(w.kept, lambda k: {close})), false) then w.kept else list_append(w.kept, {{npi: r.npi, lat: r.lat, lon: r.lon, d: r.d, zip: r.zip}}) end
      from walk w join ranked r on r.client = w.client and r.i = w.i + 1)
    select client, unnest(kept).npi as npi from (select client, kept, row_number() over (partition by client order by i desc) as last from walk) where last = 1"""


#: Stores near clients; with gaps, every third without coordinates, its ZIP one of few.
FOUND_SQL = "select client, npi, {lat} as lat, {lon} as lon, {zip} as zip, d from (select c.client, s.npi, s.lat, s.lon, {miles} as d from clients c join stores s on abs(s.lat - c.lat) < 1 and abs(s.lon - c.lon) < 1.5) where d <= 30"


@query("e5_spread_out", greedy_sql(FOUND_SQL.format(lat="lat", lon="lon", zip="null::varchar", miles=MILES_SQL), 2.0))
def e5(t: Tables) -> DataFrame:
    """Greedy, in rounds over the pairs that are too close, once for all clients of a place; of stores at one point the first rules out the others."""
    places, members = stores.by_place(t.clients.select("client", "lat", "lon"))
    first = t.stores.groupBy("lat", "lon").agg(F.min("npi").alias("npi"))
    found = stores.nearby(places, first).select("place", "npi", "lat", "lon", "distance")
    return stores.of_clients(stores.spread_out(found, ["place"], same=2.0).select("place", "npi"), members)


@query("e5_without_coordinates", greedy_sql(FOUND_SQL.format(lat="case when npi % 3 > 0 then lat end", lon="case when npi % 3 > 0 then lon end", zip="(npi % 2)::varchar", miles=MILES_SQL).replace("d from", "floor(d * 10) / 10 as d from", 1), 15.0))
def e5_bare(t: Tables) -> DataFrame:
    """Stores without coordinates: too close by ZIP and like distance from the client. Of stores at one point that are alike in ZIP and in having coordinates the first rules out the others."""
    places, members = stores.by_place(t.clients.select("client", "lat", "lon"))
    shops = t.stores.select("npi", "lat", "lon", (F.col("npi") % 3 > 0).alias("known"), (F.col("npi") % 2).cast("string").alias("zip"))
    first = shops.groupBy("lat", "lon", "known", "zip").agg(F.min("npi").alias("npi"))
    known = F.col("known")
    found = stores.nearby(places, first).select("place", "npi", F.when(known, F.col("lat")).alias("lat"), F.when(known, F.col("lon")).alias("lon"), (F.floor(F.col("distance") * 10) / 10).alias("distance"), "zip")
    return stores.of_clients(stores.spread_out(found, ["place"], same=15.0).select("place", "npi"), members)


@query("e6_top_stores", f"with {NEAR_SQL} select client, npi from (select *, row_number() over (partition by client order by (not preferred)::int, (chain = 'chain0')::int, tenths, npi) as rn from near) where rn <= 4")
def e6(t: Tables) -> DataFrame:
    """Once for each place, from the first four of the stores at each point that are alike in what counts."""
    last = F.col("chain") == "chain0"
    first = rows.top(t.stores.select("npi", "lat", "lon", "preferred", last.alias("last")), ["lat", "lon", "preferred", "last"], ["npi"], 4)
    found, members = near_places(t, first)
    return stores.of_clients(rows.top(found, ["place"], [~F.col("preferred"), "last", "tenths", "npi"], 4).select("place", "npi"), members)


@query("e11_unique_labels", "select client, pos, name || case when nth > 1 then ' (' || nth || ')' else '' end as label from (select r.client, r.pos, p.form as name, row_number() over (partition by r.client, p.form order by r.pos) as nth from regimen r join products p on r.drug = p.drug)")
def e11(t: Tables) -> DataFrame:
    named = t.regimen.join(t.products.select("drug", "form"), "drug").withColumn("nth", F.row_number().over(Window.partitionBy("client", "form").orderBy("pos")))
    return named.select("client", "pos", F.concat("form", F.when(F.col("nth") > 1, F.format_string(" (%d)", "nth")).otherwise("")).alias("label"))


@query("e12_pick_order", """with picks as (select county, plan, plan_type, row_number() over (partition by county, plan_type order by plan) as nth from service_area)
    select county, plan, plan_type from picks where (plan_type = 'MA' and nth <= 3) or (plan_type = 'PD' and nth = 1)""")
def e12(t: Tables) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("county", "plan_type").orderBy("plan"))
    return t.service_area.withColumn("nth", nth).where("(plan_type = 'MA' and nth <= 3) or (plan_type = 'PD' and nth = 1)").select("county", "plan", "plan_type")


FIT_SQL = """fit as (select s.county, s.plan, 12 * s.premium + s.deductible - 12 * p.giveback as cost, case when s.family % 4 = 0 then 3 when s.family % 4 = 1 then 0 when s.family % 4 = 2 then 1 else 2 end as fit from service_area s join plans p on s.plan = p.plan)"""


@query("e14_network_fit", """with net as (select plan, list(distinct county) as inside from service_area group by plan), wants as (select c.client, [c.county, (c.county + 1) % 25, (c.county + 7) % 25] as wanted from clients c)
    select w.client, e.plan, case when n.plan is null then 'UNKNOWN' when len(list_intersect(wanted, inside)) = 3 then 'ALL' when len(list_intersect(wanted, inside)) = 0 then 'NONE' else 'SOME' end as fit, (3 - len(list_intersect(wanted, inside)))::int as missing
    from wants w join eligible e on e.client = w.client left join net n on n.plan = e.plan""")
def e14(t: Tables) -> DataFrame:
    net = t.service_area.groupBy("plan").agg(F.collect_set("county").alias("inside"))
    k = F.col("county")
    wants = t.clients.select("client", F.array(k, (k + 1) % 25, (k + 7) % 25).alias("wanted"))
    both = wants.join(t.eligible, "client").join(net, "plan", "left")
    n = F.size(F.array_intersect("wanted", "inside"))
    fit = F.when(F.col("inside").isNull(), "UNKNOWN").when(n == 3, "ALL").when(n == 0, "NONE").otherwise("SOME")
    return both.select("client", "plan", fit.alias("fit"), F.size(F.array_except("wanted", "inside")).alias("missing"))
