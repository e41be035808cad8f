"""Queries of entity resolution (R rows): products are parts, mentions their names as written elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermark.operators import resolve
from tiermark.plans.proxies import Tables
from tiermark.plans.registry import query

#: A part's name as that of a product, a word for an ingredient.
CONCEPTS = "concepts as (select p_partkey as rxcui, split_part(p_name, ' ', 1) || ' ' || p_size || ' MG / ' || split_part(p_name, ' ', 2) || ' 5 MG ' || p_type || case when p_partkey % 3 = 0 then ' [' || p_brand || ']' else '' end as name from part)"
DICTIONARY = f"{CONCEPTS}, dict as (select p_partkey as rxcui, list_sort([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) as ingredients, p_size::double as strength, lower(p_type) as form, case when p_partkey % 3 = 0 then lower(p_brand) end as brand from part)"
#: Every order line as a written request: a name and a strength.
MENTIONS = "mentions as (select l_orderkey * 10 + l_linenumber as mention, split_part(p_name, ' ', 2) as second, split_part(p_name, ' ', 1) as first, p_size as strength, l_orderkey % 4 as kind, p_type as form from lineitem join part on l_partkey = p_partkey)"


def concepts(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    brand = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" ["), "p_brand", F.lit("]"))).otherwise("")
    name = F.concat(words[0], F.lit(" "), F.col("p_size").cast("string"), F.lit(" MG / "), words[1], F.lit(" 5 MG "), "p_type", brand)
    return t.read("part").select(F.col("p_partkey").alias("rxcui"), name.alias("name"))


def mentions(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(t.read("part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention"), words[0].alias("first"), words[1].alias("second"), F.col("p_size").alias("strength"), (F.col("l_orderkey") % 4).alias("kind"), F.col("p_type").alias("form"))


@query("r1_dictionary", f"with {DICTIONARY} select rxcui, array_to_string(ingredients, '+') as ingredients, strength, 5.0::double as second, form, brand from dict")
def r1(t: Tables) -> DataFrame:
    made = resolve.dictionary(concepts(t))
    return made.select("rxcui", F.array_join("ingredients", "+").alias("ingredients"), F.col("strengths")[0].alias("strength"), F.col("strengths")[1].alias("second"), "form", "brand")


@query("r2_postings", f"with {DICTIONARY} select distinct unnest(ingredients) as word, rxcui from dict")
def r2(t: Tables) -> DataFrame:
    return resolve.postings(resolve.dictionary(concepts(t)))


@query("r3_prepared", f"with {MENTIONS} select mention, first || ' ' || second || ' ' || strength || '000 mg 0.5 mg tablet' as written from mentions")
def r3(t: Tables) -> DataFrame:
    raw = F.concat(F.initcap("first"), F.lit("  "), F.upper("second"), F.lit(" "), F.col("strength").cast("string"), F.lit(",000mg, .5mg tab"))
    return mentions(t).select("mention", resolve.prepared(raw, {"tab": "tablet"}).alias("written"))


@query("r4_names_only", f"with {MENTIONS} select mention, first || '|' || second as names from mentions where first <> second")
def r4(t: Tables) -> DataFrame:
    said = F.split(resolve.prepared(F.concat_ws(" ", "first", "second", F.col("strength").cast("string"), F.lit("mg tab")), {"tab": "tablet"}), " ")
    named = mentions(t).where("first <> second").select("mention", resolve.names_only(said, ["tablet"]).alias("n"))
    return named.select("mention", F.array_join("n", "|").alias("names"))


@query("r5_strengths", f"with {MENTIONS} select mention, strength::double as mg, (strength * 0.001)::double as from_mcg, abs(strength - strength * 1.01) <= 0.015 * strength * 1.01 + 1e-9 as close from mentions")
def r5(t: Tables) -> DataFrame:
    s = F.col("strength").cast("string")
    both = resolve.strengths(F.concat(s, F.lit(" MG and "), s, F.lit("mcg")))
    return mentions(t).select("mention", both[0].alias("mg"), both[1].alias("from_mcg"), resolve.same_strength(F.col("strength").cast("double"), F.col("strength") * 1.01).alias("close"))


@query("r7_brands", f"with {DICTIONARY}, brands as (select distinct brand from dict where brand is not null) select p_partkey, brand from part join brands on lower(p_brand) = brand")
def r7(t: Tables) -> DataFrame:
    """The longest leading run of words that is a brand."""
    brands = resolve.dictionary(concepts(t)).where("brand is not null").select("brand").distinct()
    said = F.split(F.lower(F.concat_ws(" ", "p_brand", "p_name")), " ")
    runs = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size(said))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(said, F.lit(1), n), " ").alias("brand"))))
    tries = t.read("part").select("p_partkey", runs.alias("r")).select("p_partkey", "r.n", "r.brand")
    return tries.join(brands, "brand").groupBy("p_partkey").agg(F.max_by("brand", "n").alias("brand"))


#: Distinct written names, so that the join's size follows the dictionary's.
ASKED = f"{DICTIONARY}, {MENTIONS}, asked as (select distinct first || '+' || second || '+' || strength as mention, list_sort(list_distinct([first, second])) as words, strength, form from mentions), cand as (select a.mention || '+' || a.form as mention, a.strength, a.form as want, d.rxcui, d.strength as has, d.form, d.brand from asked a join dict d on list_sort(list_distinct(d.ingredients)) = a.words)"


def asked(t: Tables) -> DataFrame:
    m = mentions(t).select("first", "second", "strength", "form").distinct()
    return m.select(F.concat_ws("+", "first", "second", F.col("strength").cast("string"), "form").alias("mention"), F.array_distinct(F.array("first", "second")).alias("words"), "strength", F.lower("form").alias("want"))


def found(t: Tables) -> DataFrame:
    products = resolve.dictionary(concepts(t))
    return resolve.candidates(asked(t), products).join(asked(t).drop("words"), "mention").join(products.select("rxcui", F.col("strengths")[0].alias("has"), "form", "brand"), "rxcui")


@query("r8_candidates", f"with {ASKED} select mention, count(*) as products, sum(rxcui)::bigint as ids from cand group by mention")
def r8(t: Tables) -> DataFrame:
    return found(t).groupBy("mention").agg(F.count(F.lit(1)).alias("products"), F.sum("rxcui").alias("ids"))


NARROWED = f"{ASKED}, n1 as (select * from (select *, bool_or(has = strength) over (partition by mention) as s from cand) where has = strength or not s), n2 as (select * from (select *, bool_or(form = lower(want)) over (partition by mention) as f from n1) where form = lower(want) or not f), n3 as (select * from (select *, bool_or(brand is null) over (partition by mention) as b from n2) where brand is null or not b)"


@query("r9_narrowed", f"with {NARROWED} select mention, count(*) as products, min(rxcui) as rxcui from n3 group by mention")
def r9(t: Tables) -> DataFrame:
    """Candidates narrowed by strength, form, then no brand."""
    made = resolve.narrowed(found(t), [F.col("has") == F.col("strength"), F.col("form") == F.col("want"), F.col("brand").isNull()])
    return made.groupBy("mention").agg(F.count(F.lit(1)).alias("products"), F.min("rxcui").alias("rxcui"))


@query("r10_twins", f"with {DICTIONARY} select a.rxcui, count(b.rxcui) as twins, min(b.rxcui) as twin from dict a left join dict b on a.ingredients = b.ingredients and a.strength = b.strength and a.form = b.form and b.brand is null and b.rxcui <> a.rxcui group by a.rxcui")
def r10(t: Tables) -> DataFrame:
    """Generic products of the same ingredients, strengths and form, by groups: no pairs are made."""
    signature = ["ingredients", "strengths", "form"]
    products = resolve.dictionary(concepts(t))
    generic = products.where("brand is null").groupBy(*signature).agg(F.count(F.lit(1)).alias("n"), F.min("rxcui").alias("first"))
    # the one after the first stands for the first itself
    second = products.where("brand is null").join(generic.select(*signature, "first"), signature).where("rxcui > first").groupBy(*signature).agg(F.min("rxcui").alias("second"))
    both = products.join(generic, signature, "left").join(second, signature, "left")
    own = F.col("brand").isNull()
    other = F.when(F.col("first") != F.col("rxcui"), F.col("first")).otherwise(F.col("second"))
    return both.select("rxcui", (F.coalesce("n", F.lit(0)) - F.when(own, 1).otherwise(0)).cast("long").alias("twins"), other.alias("twin"))


@query("r11_combination", f"with {DICTIONARY} select strength, case when count(distinct array_to_string(ingredients, '+')) = 1 then min(array_to_string(ingredients, '+')) end as only_kind, count(*) as n from dict group by strength")
def r11(t: Tables) -> DataFrame:
    kind = F.array_join("ingredients", "+")
    products = resolve.dictionary(concepts(t)).select(F.col("strengths")[0].alias("strength"), kind.alias("kind"))
    return products.groupBy("strength").agg(F.when(F.count_distinct("kind") == 1, F.min("kind")).alias("only_kind"), F.count(F.lit(1)).alias("n"))


SPELT = "names as (select distinct split_part(p_name, ' ', 1) || split_part(p_name, ' ', 2) as name from part), wrong as (select name as mention, left(name, length(name) - 2) || substr(name, length(name), 1) as written from names)"


@query("r12_spelling", f"""with {SPELT}, pairs as (select mention, name, 1 - levenshtein(written, name)::double / greatest(length(written), length(name)) as score from wrong, names), best as (select *, lead(score) over (partition by mention order by score desc, name) as nxt, row_number() over (partition by mention order by score desc, name) as rn from pairs where score >= 0.8)
    select mention, name from best where rn = 1 and (nxt is null or score - nxt >= 0.04)""")
def r12(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    names = t.read("part").select(F.concat(words[0], words[1]).alias("name")).distinct()
    wrong = names.select(F.col("name").alias("mention"), F.expr("left(name, length(name) - 2) || right(name, 1)").alias("written"))
    return resolve.spelled(wrong, names).select("mention", "name")


@query("r14_statuses", f"with {NARROWED} select a.mention || '+' || a.form as mention, case when count(n.rxcui) = 0 then 'unknown' when not bool_or(n.has = a.strength) then 'strength' when count(n.rxcui) = 1 then 'ok' else 'several' end as status, array_to_string(list_slice(list_sort(list(n.rxcui)), 1, 3), ',') as suggestions from asked a left join n3 n on n.mention = a.mention || '+' || a.form group by a.mention, a.form")
def r14(t: Tables) -> DataFrame:
    made = resolve.narrowed(found(t), [F.col("has") == F.col("strength"), F.col("form") == F.col("want"), F.col("brand").isNull()]).select("mention", "rxcui", "has")
    both = asked(t).select("mention", "strength").join(made, "mention", "left").groupBy("mention").agg(F.count("rxcui").alias("n"), F.bool_or(F.col("has") == F.col("strength")).alias("s"), F.slice(F.sort_array(F.collect_list("rxcui")), 1, 3).alias("top"))
    status = F.when(F.col("n") == 0, "unknown").when(~F.col("s"), "strength").when(F.col("n") == 1, "ok").otherwise("several")
    return both.select("mention", status.alias("status"), F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("suggestions"))


@query("r15_match_rate", f"with {NARROWED} select a.form as file, count(*) as listed, count(n.mention) as matched from asked a left join (select distinct mention from n3 where has = strength) n on n.mention = a.mention || '+' || a.form group by a.form")
def r15(t: Tables) -> DataFrame:
    hits = found(t).where("has = strength").select("mention").distinct().withColumn("hit", F.lit(1))
    both = asked(t).join(hits, "mention", "left")
    return both.groupBy(F.upper("want").alias("file")).agg(F.count(F.lit(1)).alias("listed"), F.count("hit").alias("matched"))


@query("r18_siblings", f"with {DICTIONARY} select rxcui, count(*) over (partition by ingredients[1], strength) - 1 as siblings from dict")
def r18(t: Tables) -> DataFrame:
    """Products of the same first ingredient and strength: counts by key, joined back."""
    products = resolve.dictionary(concepts(t)).select("rxcui", F.col("ingredients")[0].alias("head"), F.col("strengths")[0].alias("s"))
    counts = products.groupBy("head", "s").agg(F.count(F.lit(1)).alias("n"))
    return products.join(counts, ["head", "s"]).select("rxcui", (F.col("n") - 1).alias("siblings"))


@query("r13_alternates", f"""with {DICTIONARY}, {MENTIONS}, tries as (select distinct first || '+' || second || '+' || kind as mention, case kind when 0 then first else 'zz' end as t1, case kind when 1 then second else 'yy' end as t2, first as t3, kind from mentions),
    words as (select distinct unnest(ingredients) as word from dict where rxcui % 2 = 0)
    select mention, case when t1 in (select word from words) then 0 when t2 in (select word from words) then 1 when kind < 3 and t3 in (select word from words) then 2 end::int as attempt from tries""")
def r13(t: Tables) -> DataFrame:
    """The first of several readings that the dictionary has: the name, another name, then the spelling."""
    known = resolve.postings(resolve.dictionary(concepts(t)).where("rxcui % 2 = 0")).select("word").distinct()
    k = F.col("kind")
    asked_ = mentions(t).select("first", "second", "kind").distinct().select(F.concat_ws("+", "first", "second", k.cast("string")).alias("mention"), F.array(F.when(k == 0, F.col("first")), F.when(k == 1, F.col("second")), F.when(k < 3, F.col("first"))).alias("tries"))
    return resolve.first_known(asked_, known).select("mention", "attempt")


SAID_FORMS = ("%s 5 mg tablet", "%s ER 24 hr capsule", "%s chewable tab", "%s ophth soln", "%s nasal spray 50 mcg/act", "%s HFA inhaler", "%s pen-injector", "%s cream 1%%", "%s DR cap", "%s oral suspension", "%s patch 0.1 mg/24 hr", "%s")
FORM_TEXT = "[" + ", ".join("'" + f.replace("%%", "%") + "'" for f in SAID_FORMS) + f"][p_partkey % {len(SAID_FORMS)} + 1]"


def has_sql(words: str) -> str:
    return f"regexp_matches(f, '\\b({'|'.join(words.split())})\\b')" if words else "true"


def forms_sql() -> str:
    form = " ".join(f"when {has_sql(w)} then '{k}'" for k, w, _ in resolve.FORMS)
    kind = " ".join(f"when {has_sql(w)} then case {' '.join(f'when {has_sql(x)} then {chr(39)}{n}{chr(39)}' for n, x in kinds)} else '' end" if kinds else f"when {has_sql(w)} then ''" for _, w, kinds in resolve.FORMS)
    return f"case {form} end as form, case {kind} else '' end as kind"


@query("r6_forms", f"""with said as (select p_partkey, replace({FORM_TEXT}, '%s', p_name) as raw from part), t as (select p_partkey, replace(lower(raw), '-', ' ') as f, regexp_replace(lower(raw), '/\\s*(24|12)?\\s*(hr|hrs|hour|hours|day)\\b', ' ', 'g') as r from said)
    select p_partkey, {forms_sql()}, case when regexp_matches(r, '\\b({resolve.RELEASES[0][1].replace(" ", "|")})\\b') or regexp_matches(r, '\\b(12|24) ?(hr|hour)\\b') then 'er' when regexp_matches(r, '\\b({resolve.RELEASES[1][1].replace(" ", "|")})\\b') then 'dr' else 'ir' end as release from t""")
def r6(t: Tables) -> DataFrame:
    """Form, its kind and the release class of a product's text."""
    said = F.element_at(F.array(*[F.format_string(f, "p_name") for f in SAID_FORMS]), (F.col("p_partkey") % len(SAID_FORMS) + 1).cast("int"))
    return t.read("part").select("p_partkey", resolve.dose_form(said).alias("x"), resolve.release(said).alias("release")).select("p_partkey", "x.form", "x.kind", "release")


@query("r16_scored", f"with {MENTIONS} select kind::int as \"group\", count(*) as cases, count(case when kind < 3 then 1 end) as answered, count(*) as right_drug, count(*) as \"right\" from mentions group by kind")
def r16(t: Tables) -> DataFrame:
    """The resolver against what each line was written from: as it is, turned round, with a salt and a form, and junk that must not be resolved."""
    m = mentions(t)
    k, mg = F.col("kind"), F.concat(F.col("strength").cast("string"), F.lit(" mg"))
    said = F.when(k == 0, F.concat_ws(" ", F.initcap("first"), "second", mg)).when(k == 1, F.concat_ws(" ", F.upper("second"), "first", mg)).when(k == 2, F.concat_ws(" ", "first", "second", F.lit("hydrochloride"), mg, F.lit("tab"))).otherwise(F.concat_ws(" ", F.lit("xq"), "first", F.lit("zzv")))
    labels = m.select(said.alias("mention"), k.alias("group"), F.when(k < 3, F.array_join(F.array_sort(F.array_distinct(F.array("first", "second"))), "+")).alias("ingredients"), F.when(k < 3, F.col("strength").cast("double")).alias("strength"))
    labels = labels.groupBy("mention", "group", "ingredients", "strength").agg(F.count(F.lit(1)).alias("n"))
    read = labels.select("mention", F.split(resolve.prepared(F.col("mention"), {"tab": "tablet"}), " ").alias("w"), F.get(resolve.strengths(F.col("mention")), F.lit(0)).alias("said"))
    asked_ = read.select("mention", resolve.names_only(F.col("w"), ["tablet", "hydrochloride"]).alias("words"), "said")
    products = resolve.dictionary(concepts(t)).select("rxcui", F.array_distinct("ingredients").alias("ingredients"), F.col("strengths")[0].alias("strength"))
    # products alike in all that is asked for are one
    kinds = products.groupBy("ingredients", "strength").agg(F.min("rxcui").alias("rxcui"))
    met = resolve.candidates(asked_.select("mention", "words"), kinds).join(kinds, "rxcui").join(asked_.select("mention", "said"), "mention")
    best = resolve.narrowed(met, [resolve.same_strength(F.col("strength"), F.col("said"))])
    told = best.groupBy("mention").agg(F.min_by(F.struct(F.array_join("ingredients", "+").alias("ingredients"), "strength"), "rxcui").alias("x")).select("mention", "x.*")
    return resolve.scored(told, labels)


GUESSES = "guesses as (select p_partkey, split_part(p_name, ' ', 1) as guess, case p_partkey % 4 when 0 then split_part(p_name, ' ', 1) when 1 then left(split_part(p_name, ' ', 1), greatest(1, length(split_part(p_name, ' ', 1)) - 1)) when 2 then 'x' || split_part(p_name, ' ', 2) else ' ' || upper(split_part(p_name, ' ', 1)) || 'qqq ' end as written from part)"


@query("r17_confidence", f"with {GUESSES}, c as (select *, 1 - levenshtein(lower(trim(written)), guess)::double / greatest(length(trim(written)), length(guess)) as confidence from guesses) select p_partkey, case when confidence >= 0.7 then guess else trim(written) end as name, case when confidence < 0.7 and lower(trim(written)) <> guess then 'possibly ' || guess end as note from c")
def r17(t: Tables) -> DataFrame:
    """Below the gate the name as written stays, and the guess is a note; confidence is how alike they are."""
    words, k = F.split("p_name", " "), F.col("p_partkey") % 4
    written = F.when(k == 0, words[0]).when(k == 1, F.left(words[0], F.greatest(F.lit(1), F.length(words[0]) - 1))).when(k == 2, F.concat(F.lit("x"), words[1])).otherwise(F.concat(F.lit(" "), F.upper(words[0]), F.lit("qqq ")))
    rows_ = t.read("part").select("p_partkey", words[0].alias("guess"), written.alias("written"))
    sure = resolve.similarity(F.lower(F.trim("written")), F.col("guess"))
    return rows_.select("p_partkey", resolve.gated(F.col("written"), F.col("guess"), sure).alias("x")).select("p_partkey", "x.name", "x.note")
