"""Queries of matching text and evidence to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermark.functions import text
from tiermark.operators import matching
from tiermark.plans.proxies import Tables
from tiermark.plans.registry import query

# Names that the queries give to the tables' keys.
BRANDS = ("Lantus pen", "Ozempic", "Humalog kwikpen", "Metformin tablet", "Enoxaparin syringe", "Novolin vial", "Pencil", "Lisinopril", "Humira", "Epipen", "Saline injection", "Regular Insulin")
CARRIERS = ("blue cross", "healthpartners", "medica", "humana", "aetna", "uhc", "align")
ALIASES = {"bc": "blue cross", "bcbs": "blue cross", "hp": "healthpartners", "health partners": "healthpartners", "allina": "aetna", "aarp": "uhc", "united": "uhc"}
KEYWORDS = (
    "core", "comfort", "choice", "complete", "pace", "stride", "steady", "smart", "birch", "cedar", "value", "preferred", "select", "solution", "basic", "premier",
    "saver", "classic", "signature", "enhanced", "grand", "eagle", "fit", "freedom", "elite", "plus", "standard", "focus", "thrift", "essential", "gold", "securechoice", "assurance",
)
FIRST_NAMES = ("Ann", "Anna", "Andrew", "Bo", "Bob", "Bobby", "Chris", "Christine", "Di", "Diana")


def picked(values, key):
    """The value at key, counted round."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def picked_sql(values, key) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{key} % {len(values)} + 1]"


@query("b18_keywords", f"""with named as (select p_partkey as drug, {picked_sql(BRANDS, "p_partkey")} || ' ' || p_name as name from part)
    select drug, regexp_matches(lower(name), '{"|".join(text.INSULINS)}') as insulin, regexp_matches(' ' || lower(name), '{"|".join(text.INJECTED)}') and not regexp_matches(lower(name), '{"|".join(text.INSULINS)}') as injected from named""")
def b18(t: Tables) -> DataFrame:
    name = F.concat_ws(" ", picked(BRANDS, F.col("p_partkey")), "p_name")
    return t.read("part").select(F.col("p_partkey").alias("drug"), text.is_insulin(name).alias("insulin"), text.is_injected(name).alias("injected"))


SAID_SQL = "said as (select o_orderkey, string_agg(p_name, ' ' order by l_linenumber, l_partkey) as txt from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey group by o_orderkey)"


@query("c15_contained_pattern", f"""with {SAID_SQL}, pats as (select distinct p_name as pat from part union select distinct p_name || ' ' || split_part(p_name, ' ', 1) from part where p_size > 25)
    select o_orderkey, arg_max(pat, (length(pat), pat)) as found from said join pats on contains(' ' || txt || ' ', ' ' || pat || ' ') group by o_orderkey""")
def c15(t: Tables) -> DataFrame:
    """The longest pattern that a text contains: all lines of an order, all names, of two words and of three."""
    names = t.read("part").select("p_partkey", "p_name", "p_size")
    longer = F.concat_ws(" ", "p_name", F.substring_index("p_name", " ", 1))
    pats = names.select(F.col("p_name").alias("pat")).union(names.where("p_size > 25").select(longer)).distinct()
    lines = t.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(names, F.col("l_partkey") == F.col("p_partkey"))
    texts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name")))["p_name"], " ").alias("txt"))
    return matching.contained(texts, "txt", pats, "pat").groupBy("o_orderkey").agg(F.max_by("pat", F.struct(F.length("pat"), "pat")).alias("found"))


@query("c16_doctor_directory", f"""with dir as (select c_custkey as id, 'Customer' || (c_custkey % 200) as last, {picked_sql(FIRST_NAMES, "c_custkey")} as first, c_nationkey as city, c_custkey % 2 = 0 as accepting from customer), docs as (select s_suppkey as doctor, 'CUSTOMER' || (s_suppkey % 200) as last, {picked_sql(FIRST_NAMES, "(s_suppkey * 3)")} as first, s_nationkey as city from supplier)
    select doctor, id from (select d.doctor, r.id, row_number() over (partition by d.doctor order by (not (starts_with(lower(r.first), lower(d.first)) or starts_with(lower(d.first), lower(r.first))))::int, (r.city <> d.city)::int, (not r.accepting)::int, r.id) as rn from docs d join dir r on lower(d.last) = lower(r.last) and lower(left(d.first, 1)) = lower(left(r.first, 1))) where rn = 1""")
def c16(t: Tables) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    last = lambda head, x: F.concat(F.lit(head), (x % 200).cast("string")).alias("last")
    entries = t.read("customer").select(k.alias("id"), last("Customer", k), picked(FIRST_NAMES, k).alias("first"), F.col("c_nationkey").alias("city"), (k % 2 == 0).alias("accepting"))
    doctors = t.read("supplier").select(s.alias("doctor"), last("CUSTOMER", s), picked(FIRST_NAMES, s * 3).alias("first"), F.col("s_nationkey").alias("city"))
    return matching.in_directory(doctors, entries)


TRUST = ("purchase", "signup", "view")


@query("c17_precedence", """with ev as (select entity, case when amount % 3 <> 0 then amount % 3 end as scope, source, amount, ts, event_id, case source when 'purchase' then 1 when 'signup' then 2 when 'view' then 3 end as rank from evidence where source in ('purchase', 'signup', 'view')),
    asked as (select distinct e.entity, s.scope from evidence e, (values (1), (2), (7)) s(scope)), best as (select a.entity, a.scope, ev.source, ev.amount, row_number() over (partition by a.entity, a.scope order by rank, (ev.scope is null)::int, ts desc, event_id desc) as rn from asked a join ev on ev.entity = a.entity and (ev.scope is null or ev.scope = a.scope))
    select a.entity, a.scope::int as scope, coalesce(b.source, 'none') as source, coalesce('status ' || (b.amount % 4), 'not checked') as status from asked a left join (select * from best where rn = 1) b on b.entity = a.entity and b.scope = a.scope""")
def c17(t: Tables) -> DataFrame:
    """What is known of each entity for three scopes: confirmations before directories before systems."""
    scope = F.when(F.col("amount") % 3 != 0, (F.col("amount") % 3).cast("int"))
    known = t.evidence.select("entity", scope.alias("scope"), "source", F.concat(F.lit("status "), (F.col("amount") % 4).cast("string")).alias("status"), "ts", F.col("event_id").alias("id"))
    asked = t.evidence.select("entity").distinct().withColumn("scope", F.explode(F.array(*map(F.lit, (1, 2, 7)))))
    return matching.by_precedence(asked, known, TRUST)


FRIENDLY = f"friendly as (select s_suppkey as plan, {picked_sql(CARRIERS, 's_suppkey')} as carrier, {picked_sql(CARRIERS, 's_suppkey')} || ' ' || {picked_sql(KEYWORDS, 's_suppkey * 5')} || ' ' || {picked_sql(('Journey', 'Rx', 'Advantage'), 's_suppkey')} as name from supplier)"
REQUESTS = ("bcbs", "HP", "health partners", "Medica", "AARP", "united", "Align", "somewhere", "humana")


@query("c20_fuzzy_request", f"""with {FRIENDLY}, raw as (select c_custkey as id, {picked_sql(REQUESTS, "c_custkey")} || ' ' || {picked_sql(KEYWORDS, "(c_custkey * 7)")} || case when c_custkey % 3 = 0 then '  Journey' else '' end as said from customer),
    asked as (select id, trim(replace(replace(replace(replace(replace(replace(replace(' ' || regexp_replace(lower(trim(said)), '\\s+', ' ', 'g') || ' ', ' health partners ', ' healthpartners '), ' allina ', ' aetna '), ' united ', ' uhc '), ' aarp ', ' uhc '), ' bcbs ', ' blue cross '), ' bc ', ' blue cross '), ' hp ', ' healthpartners ')) as request from raw),
    words as (select plan, lower(carrier) as term, 10 as weight from friendly union all select plan, w, (w in ({", ".join(f"'{k}'" for k in KEYWORDS)}))::int * 8 + (length(w) > 3)::int * 3 from (select distinct plan, unnest(string_split(lower(name), ' ')) as w from friendly)),
    scored as (select r.request, plan, sum(weight)::bigint as score from (select distinct request from asked) r join words on contains(' ' || request || ' ', ' ' || term || ' ') group by r.request, plan),
    best as (select request, plan, score from (select *, row_number() over (partition by request order by score desc, plan) as rn from scored) where rn = 1 and score >= 8)
    select id, a.request, plan, score from asked a left join best b on b.request = a.request""")
def c20(t: Tables) -> DataFrame:
    """The plan that a request means; a request that many make is matched once."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    name = F.concat_ws(" ", picked(CARRIERS, s), picked(KEYWORDS, s * 5), picked(("Journey", "Rx", "Advantage"), s))
    plans = t.read("supplier").select(s.alias("plan"), picked(CARRIERS, s).alias("carrier"), name.alias("name"))
    said = F.concat(picked(REQUESTS, k), F.lit(" "), picked(KEYWORDS, k * 7), F.when(k % 3 == 0, "  Journey").otherwise(""))
    asked = t.read("customer").select(k.alias("id"), matching.expanded(said, ALIASES).alias("request"))
    return asked.join(matching.requested(asked.select("request").distinct(), plans, KEYWORDS), "request", "left").select("id", "request", "plan", "score")


@query("d8_agreement", """with rows_ as (select c.drug as label, c.drug, c.retail % 89 = 0 as flipped, p.tier <= 3 as listed from captures c join products p on p.drug = c.drug),
    votes as (select r.label, p.drug as candidate, hash(p.drug_name) as kind, (p.tier <= 3) = (listed <> flipped) as agree, (listed <> flipped) as covered from (select rows_.*, drug + k as candidate from rows_, (values (0), (1)) v(k)) r join products p on p.drug = r.candidate),
    sums as (select label, candidate, kind, sum(agree::int)::bigint as agreed, count(*) as seen, sum((agree and covered)::int)::bigint as covered from votes group by label, candidate, kind), ranked as (select *, agreed > 0 and agreed = max(agreed) over (partition by label) as top from sums)
    select label, candidate, agreed, seen, covered, top and agreed = seen and seen >= 2 and covered >= 1 and min(case when top then kind end) over (partition by label) = max(case when top then kind end) over (partition by label) as accepted from ranked""")
def d8(t: Tables) -> DataFrame:
    """A label's own product and the next one as candidates; what a plan covers must agree in all captured rows."""
    listed = F.col("tier") <= 3
    own = t.captures.join(t.products.select("drug", listed.alias("listed")), "drug").select(F.col("drug").alias("label"), (F.col("listed") != (F.col("retail") % 89 == 0)).alias("covered"))
    tries = own.withColumn("candidate", F.explode(F.array(F.col("label"), F.col("label") + 1)))
    votes = tries.join(t.products.select(F.col("drug").alias("candidate"), F.col("drug_name").alias("kind"), listed.alias("has")), "candidate")
    return matching.agreed(votes.select("label", "candidate", "kind", (F.col("has") == F.col("covered")).alias("agree"), "covered"))
