"""Domain tables derived from the driver's tables, each as a DataFrame and as SQL.

Money is in whole cents, or in hundredths of a cent where a percentage is taken, so
that sums are exact and do not depend on their order.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.operators.rows import tasks

#: Plans that a client's yearly costs are computed for, and drugs of a client.
PLANS, DRUGS = 4, 25

# How the proxies spread keys. They are the same in SQL below.
SQL = {
    "clients": "select c_custkey as client, c_nationkey as county, lpad(cast(55001 + c_custkey % 900 as varchar), 5, '0') as zip, 43.5 + (c_custkey * 37 % 1000) * 0.0055 as lat, -97.0 + (c_custkey * 53 % 1000) * 0.0075 as lon, c_mktsegment as segment from customer",
    "plans": "select s_suppkey as plan, s_name as plan_name, s_nationkey as family, case s_suppkey % 5 when 0 then 'PD' when 1 then 'SNP' else 'MA' end as plan_type, s_suppkey * 7919 % 12000 as premium, case s_suppkey % 3 when 0 then 0 when 1 then 30000 else 70000 end as deductible, s_suppkey % 2 = 1 as gross, s_suppkey % 7 as giveback from supplier",
    "service_area": "select plan, plan_name, n_nationkey as county, premium, plan_type, deductible, family, 1 + plan % 3 as segment_id from plans, nation where (plan + n_nationkey) % 4 = 0 or plan % 11 = 0",
    "products": "select p_partkey as drug, p_name as drug_name, p_size as strength, p_type as form, p_brand as brand, 1 + p_size % 5 as tier, cast(round(p_retailprice * 100) as bigint) as cents from part",
    "tier_cost": "select plan, t.tier, case when t.tier <= 3 then 1 else 2 end as cost_type, case t.tier when 1 then 0 when 2 then 800 when 3 then 4700 when 4 then 25 else 30 end as cost_amt, t.tier >= 3 as ded_applies from plans, (values (1), (2), (3), (4), (5)) t(tier)",
    "regimen": "select client, drug, pos from (select client, drug, row_number() over (partition by client order by drug) as pos from (select distinct o_custkey as client, l_partkey as drug from orders join lineitem on o_orderkey = l_orderkey)) where pos <= 25",
    "eligible": "select client, plan from (select c.client, s.plan, row_number() over (partition by c.client order by s.premium, s.plan) as rn from clients c join service_area s on c.county = s.county where s.plan_type <> 'SNP') where rn <= 4",
    "terms": "select e.client, e.plan, r.drug, r.pos, p.tier, case when (e.plan * 31 + r.drug * 17) % 10 < 8 then (p.cents * (1 + e.plan % 7) * (1 + p.strength % 9)) // 160 end as price, (p.tier >= 3)::int * 100 + 50 as fee, t.cost_type, t.cost_amt, t.ded_applies, case when p.strength % 17 = 0 then 3500 end as flat, n.deductible, case when n.gross then 'gross' else 'classic' end as rule from eligible e join regimen r on e.client = r.client join products p on r.drug = p.drug join tier_cost t on t.plan = e.plan and t.tier = p.tier join plans n on n.plan = e.plan",
    "stores": "select s_suppkey as npi, s_name as store_name, 'chain' || (s_suppkey % 6) as chain, lpad(cast(55001 + s_suppkey * 13 % 900 as varchar), 5, '0') as zip, 43.5 + (s_suppkey * 101 % 1000) * 0.0055 as lat, -97.0 + (s_suppkey * 211 % 1000) * 0.0075 as lon, s_suppkey % 3 = 0 as preferred from supplier",
    "captures": "select l_suppkey as plan, l_partkey as drug, l_returnflag || l_linestatus as chain, cast(l_quantity as bigint) as qty, cast(round(l_extendedprice * 100) as bigint) as retail, l_shipdate as captured_at, l_orderkey, l_linenumber from lineitem",
    "evidence": "select event_id, user_id as entity, event_type as source, ts, cast(floor(value) as bigint) as amount from events",
}


def with_proxies(sql: str) -> str:
    """sql with the proxy tables that it names, directly or by way of others, as WITH clauses."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in need:
                add(SQL[name])
                need.append(name)

    add(sql)
    clauses = [f"{n} as ({SQL[n]})" for n in need]
    if not clauses:
        return sql
    if m := re.match(r"\s*with(\s+recursive)?\b", sql, re.I):
        return f"with{m[1] or ''} {', '.join(clauses)}, {sql[m.end() :]}"
    return "with " + ", ".join(clauses) + " " + sql


class Tables:
    """The driver's tables and the proxies, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def clients(self) -> DataFrame:
        k = F.col("c_custkey")
        zip5 = F.lpad((55001 + k % 900).cast("string"), 5, "0")
        return self.read("customer").select(k.alias("client"), F.col("c_nationkey").alias("county"), zip5.alias("zip"), (43.5 + (k * 37 % 1000) * 0.0055).alias("lat"), (-97.0 + (k * 53 % 1000) * 0.0075).alias("lon"), F.col("c_mktsegment").alias("segment"))

    @cached_property
    def plans(self) -> DataFrame:
        k = F.col("s_suppkey")
        kind = F.when(k % 5 == 0, "PD").when(k % 5 == 1, "SNP").otherwise("MA")
        deductible = F.when(k % 3 == 0, 0).when(k % 3 == 1, 30000).otherwise(70000)
        return self.read("supplier").select(k.alias("plan"), F.col("s_name").alias("plan_name"), F.col("s_nationkey").alias("family"), kind.alias("plan_type"), (k * 7919 % 12000).alias("premium"), deductible.alias("deductible"), (k % 2 == 1).alias("gross"), (k % 7).alias("giveback"))

    @cached_property
    def service_area(self) -> DataFrame:
        """Plans by county: each plan meets the counties of its own residue only, or all of them."""
        counties = self.read("nation").select(F.col("n_nationkey").cast("long").alias("county"), F.explode(F.array(F.pmod(-F.col("n_nationkey").cast("long"), F.lit(4)), F.lit(-1).cast("long"))).alias("class"))
        classed = self.plans.withColumn("class", F.explode(F.when(F.col("plan") % 11 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array(F.col("plan") % 4))))
        return classed.join(counties, "class").select("plan", "plan_name", F.col("county").cast("int").alias("county"), "premium", "plan_type", "deductible", "family", (1 + F.col("plan") % 3).alias("segment_id"))

    @cached_property
    def products(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("drug"), F.col("p_name").alias("drug_name"), F.col("p_size").alias("strength"), F.col("p_type").alias("form"), F.col("p_brand").alias("brand"), (1 + F.col("p_size") % 5).alias("tier"), F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))

    @cached_property
    def tier_cost(self) -> DataFrame:
        tier = F.col("tier")
        amount = F.when(tier == 1, 0).when(tier == 2, 800).when(tier == 3, 4700).when(tier == 4, 25).otherwise(30)
        return self.plans.select("plan", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("tier")).select("plan", "tier", F.when(tier <= 3, 1).otherwise(2).alias("cost_type"), amount.alias("cost_amt"), (tier >= 3).alias("ded_applies"))

    @cached_property
    def regimen(self) -> DataFrame:
        """A client's drugs: dealt by client once, for both the distinct pairs and their order."""
        pairs = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("client")).join(self.read("lineitem").select("l_orderkey", F.col("l_partkey").alias("drug")), F.col("o_orderkey") == F.col("l_orderkey")).select("client", "drug")
        pairs = pairs.repartition(tasks(self.spark), "client").distinct()
        return pairs.withColumn("pos", F.row_number().over(Window.partitionBy("client").orderBy("drug"))).where(F.col("pos") <= DRUGS)

    @cached_property
    def cheapest(self) -> DataFrame:
        """The cheapest plans of each county, PLANS of them at most."""
        best = Window.partitionBy("county").orderBy("premium", "plan")
        ranked = self.service_area.where("plan_type <> 'SNP'").withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= PLANS)
        return ranked.select("county", "plan")

    @cached_property
    def eligible(self) -> DataFrame:
        """The cheapest plans of each client's county: ranked by county, then joined."""
        return self.clients.select("client", "county").join(self.cheapest, "county").select("client", "plan")

    @cached_property
    def terms(self) -> DataFrame:
        """Drugs with what is known of them meet their client first, and plans last: a county's plans, with their tiers, are few
        and sent to all tasks, so that nothing that is repeated by plan is shuffled. Rows are dealt by client."""
        drugs = self.regimen.join(self.products.select("drug", "tier", "cents", "strength"), "drug").repartition(n := tasks(self.spark), "client")
        offers = self.cheapest.join(self.plans.select("plan", "deductible", "gross"), "plan").join(self.tier_cost, "plan")
        both = drugs.join(self.clients.select("client", "county").repartition(n, "client"), "client").join(F.broadcast(offers), ["county", "tier"])
        covered = (F.col("plan") * 31 + F.col("drug") * 17) % 10 < 8
        price = F.expr("(cents * (1 + plan % 7) * (1 + strength % 9)) div 160")
        return both.select("client", "plan", "drug", "pos", "tier", F.when(covered, price).alias("price"), (F.when(F.col("tier") >= 3, 100).otherwise(0) + 50).alias("fee"), "cost_type", "cost_amt", "ded_applies", F.when(F.col("strength") % 17 == 0, 3500).alias("flat"), "deductible", F.when(F.col("gross"), "gross").otherwise("classic").alias("rule"))

    @cached_property
    def stores(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.read("supplier").select(k.alias("npi"), F.col("s_name").alias("store_name"), F.concat(F.lit("chain"), (k % 6).cast("string")).alias("chain"), F.lpad((55001 + k * 13 % 900).cast("string"), 5, "0").alias("zip"), (43.5 + (k * 101 % 1000) * 0.0055).alias("lat"), (-97.0 + (k * 211 % 1000) * 0.0075).alias("lon"), (k % 3 == 0).alias("preferred"))

    @cached_property
    def captures(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_suppkey").alias("plan"), F.col("l_partkey").alias("drug"), F.concat("l_returnflag", "l_linestatus").alias("chain"), F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("retail"), F.col("l_shipdate").alias("captured_at"), "l_orderkey", "l_linenumber")

    @cached_property
    def evidence(self) -> DataFrame:
        return self.read("events").select("event_id", F.col("user_id").alias("entity"), F.col("event_type").alias("source"), "ts", F.floor("value").cast("long").alias("amount"))
