"""Queries of sources, sinks and streams (A rows, S1): driver tables are written out and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermark.functions import clean
from tiermark.sources import files
from tiermark.streaming import captures
from tiermark.plans.proxies import Tables
from tiermark.plans.registry import query


@query("a1_header_scan", "select s_suppkey::varchar as id, s_name as name, cast(floor(s_acctbal * 100 + 0.5) as bigint) as cents from supplier where s_nationkey % 5 = 2")
def a1(t: Tables) -> DataFrame:
    path = files.shared_folder(t.spark, "a1")
    t.read("supplier").select((F.col("s_nationkey") % 5).alias("State Code"), F.col("s_suppkey").alias(" Plan ID "), F.col("s_name").alias("Plan Name"), F.concat(F.lit("$"), F.col("s_acctbal").cast("string")).alias("Amount")).write.option("header", True).csv(path)
    rows = files.read_delimited(t.spark, path, {"State Code": "state", "Plan ID": "id", "Plan Name": "name", "Amount": "amount"})
    return rows.where("state = '2'").select("id", "name", clean.cents(clean.money(F.col("amount"))).alias("cents"))


@query("a2_tab_latin", "select p_partkey::varchar as part, p_name || chr(233) as name, p_size::varchar as size from part")
def a2(t: Tables) -> DataFrame:
    path = files.shared_folder(t.spark, "a2")
    twice = t.read("part").select("p_partkey", F.concat("p_name", F.lit("é")).alias("name"), F.explode(F.array(F.lit(0), F.lit(1))).alias("line"), "p_size").withColumn("size", F.when(F.col("line") == 1, F.col("p_size")).otherwise(-1)).drop("p_size")
    twice.write.options(header=True, sep="\t", encoding="ISO-8859-1").csv(path)
    rows = files.read_delimited(t.spark, path, {"p_partkey": "part", "name": "name", "size": "size", "line": "line"}, "\t", "ISO-8859-1")
    return files.last_per_key(rows, ["part"], "line").select("part", "name", "size")


@query("a3_keys_before_parse", "select l_suppkey::varchar as plan, count(*) as n from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey = 3) group by l_suppkey")
def a3(t: Tables) -> DataFrame:
    path = files.shared_folder(t.spark, "a3")
    t.read("lineitem").select("l_suppkey", "l_partkey", "l_quantity").write.options(header=True, sep="|").csv(path)
    ours = t.read("supplier").where("s_nationkey = 3").select(F.col("s_suppkey").cast("string").alias("key"))
    rows = files.read_prefixed(t.spark, path, "plan string, drug string, qty string", ours)
    return rows.groupBy("plan").agg(F.count(F.lit(1)).alias("n"))


@query("a4_json_searches", """select c_custkey::varchar as plan_id, 'store' || k as store, ((c_custkey * k) % 1000)::double as cost, 2 as drugs, case when k < 3 then 'month ' || (c_custkey % 12 + 1) end as met, case when k <> 2 then (k * 1.5)::double end as distance from customer, (values (1), (2), (3)) v(k) where c_custkey % 7 <> 0
    union all select c_custkey::varchar, null, null, 2, null, null from customer where c_custkey % 7 = 0""")
def a4(t: Tables) -> DataFrame:
    """JSON lines, one in a hundred of them broken, which are set aside; one in seven searches has no costs."""
    path = files.shared_folder(t.spark, "a4")
    k = F.col("c_custkey")
    costs = F.when(k % 7 != 0, F.map_from_arrays(F.array(*[F.lit(f"store{i}") for i in (1, 2, 3)]), F.array(*[(k * i % 1000).cast("double") for i in (1, 2, 3)])))
    shops = F.array(*[F.struct(F.lit(f"store{i}").alias("name"), F.lit(i * 1.5).alias("distance")) for i in (1, 3)])
    met = F.map_from_arrays(F.array(F.lit("store1"), F.lit("store2")), F.array_repeat(F.concat(F.lit("month "), (k % 12 + 1).cast("string")), 2))
    doc = F.to_json(F.struct(k.cast("string").alias("plan_id"), F.lit("55001").alias("zip"), F.array(F.lit("a"), F.lit("b")).alias("drugs_entered"), shops.alias("pharmacies"), costs.alias("yearly_drug_cost"), met.alias("deductible_met")))
    lines = t.read("customer").select(doc.alias("value")).union(t.read("customer").where("c_custkey % 100 = 0").select(F.lit("{broken")))
    lines.write.text(path)
    good, _ = files.read_searches(t.spark, path)
    return good.select("plan_id", "store", "cost", "drugs", "met", "distance")


@query("a5_case_scan", "select p_name as name, p_size::varchar as dosage, case when p_partkey % 2 = 0 then 'near' end as hint, count(*) as n from part group by 1, 2, 3")
def a5(t: Tables) -> DataFrame:
    """Lines of six or seven fields, with comments among them."""
    path = files.shared_folder(t.spark, "a5")
    base = F.concat_ws("|", "p_name", F.col("p_size").cast("string"), F.lit("x"), F.lit("y"), F.lit("z"), F.lit("f"))
    lines = t.read("part").select(F.concat(base, F.when(F.col("p_partkey") % 2 == 0, "|near").otherwise("")).alias("value"))
    lines.union(t.read("nation").select(F.concat(F.lit("# "), "n_name"))).write.text(path)
    return files.read_cases(t.spark, path).groupBy("name", "dosage", "hint").agg(F.count(F.lit(1)).alias("n"))


@query("a6_newest_file", "select p_partkey, p_size from part where p_size % 3 = (select max(p_size % 3) from part)")
def a6(t: Tables) -> DataFrame:
    path = files.shared_folder(t.spark, "a6")
    for year in (2024, 2025, 2026):
        t.read("part").where(F.col("p_size") % 3 == year - 2024).select("p_partkey", "p_size").write.parquet(f"{path}/ratings/{year}_stars")
    rows = t.spark.read.option("recursiveFileLookup", True).parquet(f"{path}/ratings")
    folder = F.regexp_replace(F.input_file_name(), r"/[^/]*$", "")
    return files.newest_year(rows, folder).select("p_partkey", "p_size")


@query("a7_keyed_sink", "select plan, drug, arg_max(retail, (l_orderkey * 10 + l_linenumber) * 100000000 + retail) as retail from captures group by plan, drug")
def a7(t: Tables) -> DataFrame:
    path = files.shared_folder(t.spark, "a7")
    rows = t.captures.select("plan", "drug", "retail", ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000 + F.col("retail")).alias("line"))
    files.write_keyed(rows, path, ["plan", "drug"], "line")
    return t.spark.read.parquet(path).select("plan", "drug", "retail")


@query("a8_resumable_sink", "select o_orderkey, o_custkey from orders")
def a8(t: Tables) -> DataFrame:
    """Half the inputs, then all of them: those done before are not done again."""
    path = files.shared_folder(t.spark, "a8")
    rows = t.read("orders").select("o_orderkey", "o_custkey")
    files.append_new(rows.where("o_orderkey % 2 = 0"), path, ["o_orderkey"])
    files.append_new(rows, path, ["o_orderkey"])
    return t.spark.read.parquet(path)


@query("a9_grid_sink", "select p_brand, coalesce(min(case when p_type = 'PROMO' then p_size end)::varchar, '-') as \"PROMO\", coalesce(min(case when p_type = 'SMALL' then p_size end)::varchar, '-') as \"SMALL\" from part group by p_brand")
def a9(t: Tables) -> DataFrame:
    path = files.shared_folder(t.spark, "a9")
    files.write_grid(t.read("part"), path, "p_brand", "p_type", ["PROMO", "SMALL"], F.min("p_size"))
    return t.spark.read.option("header", True).csv(path)


@query("s1_capture_stream", "select plan, drug, chain, qty, retail from (select *, row_number() over (partition by plan, drug, chain order by captured_at desc, l_orderkey desc, l_linenumber desc) as rn from captures) where rn = 1")
def s1(t: Tables) -> DataFrame:
    """Captures replayed as a stream in three batches of files."""
    path = files.shared_folder(t.spark, "s1")
    t.captures.repartition(3).write.parquet(f"{path}/in")
    order = ["captured_at", "l_orderkey", "l_linenumber"]
    stream = captures.keep_newest_parts(t.spark, f"{path}/in", t.captures.schema, f"{path}/out", f"{path}/checkpoint", ["plan", "drug", "chain"], order)
    stream.awaitTermination()
    return captures.newest_parts(t.spark, t.captures.schema, f"{path}/out").select("plan", "drug", "chain", "qty", "retail")


@query("s2_windows_streamed", """with each as (select event_type, ts, date_trunc('hour', ts) - interval (hour(ts) % 6) hour as w from events), last as (select max(ts) as newest from events)
    select w as window_start, event_type, count(*) as n from each, last where w + interval 6 hour <= newest - interval 1 day group by w, event_type""")
def s2_streamed(t: Tables) -> DataFrame:
    """Events as a stream in order of time, three files: windows that the watermark has closed."""
    path = files.shared_folder(t.spark, "s2")
    events = t.read("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(f"{path}/in")
    # a day of slack is counted from the newest event, in whole milliseconds
    captures.stream_windowed_counts(t.spark, f"{path}/in", events.schema, f"{path}/out", f"{path}/checkpoint", files=100).awaitTermination()
    return t.spark.read.parquet(f"{path}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("s2_event_windows", "select time_bucket(interval '6 hours', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def s2(t: Tables) -> DataFrame:
    made = captures.windowed_counts(t.read("events"))
    return made.select(F.col("w.start").alias("window_start"), "event_type", "n")
