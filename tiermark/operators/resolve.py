"""From written names to products: a dictionary, postings, candidates, soft narrowing, one best each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiermark.functions.clean import mapped
from tiermark.operators.rows import soft_filter

#: How far two strengths may be apart that count as one; how alike spellings must be, and by how much the best.
TOLERANCE, ALIKE, MARGIN = 0.015, 0.8, 0.04
STRENGTH = r"(\d+(?:\.\d+)?)\s*(mcg|mg|g|%)"


def dictionary(concepts: DataFrame) -> DataFrame:
    """rxcui, ingredients, strengths (milligrams), form and brand of products named like "a 5 MG / b 10 MG Oral Tablet [Brand]"."""
    name = F.col("name")
    parts = F.split(F.regexp_replace(name, r"\s*\[[^\]]*\]", ""), " / ")
    brand = F.regexp_extract(name, r"\[([^\]]*)\]", 1)
    ingredients = F.array_sort(F.transform(parts, lambda p: F.lower(F.trim(F.regexp_extract(p, r"^([^\d]*)", 1)))))
    form = F.lower(F.trim(F.regexp_extract(F.element_at(parts, -1), r"(?i)\d+(?:\.\d+)?\s*(?:mcg|mg|g|%)\s+(.*)$", 1)))
    return concepts.select("rxcui", "name", ingredients.alias("ingredients"), strengths(name).alias("strengths"), form.alias("form"), F.when(brand != "", F.lower(brand)).alias("brand"))


def strengths(text: Column) -> Column:
    """All strengths of a text in milligrams; a percentage as it is."""
    numbers = F.regexp_extract_all(F.lower(text), F.lit(STRENGTH), F.lit(1))
    units = F.regexp_extract_all(F.lower(text), F.lit(STRENGTH), F.lit(2))
    return F.zip_with(numbers, units, lambda n, u: n.cast("double") * F.when(u == "g", 1000.0).when(u == "mcg", 0.001).otherwise(1.0))


def same_strength(x: Column, y: Column) -> Column:
    return F.abs(x - y) <= TOLERANCE * F.greatest(x, y) + 1e-9


def postings(products: DataFrame, column: str = "ingredients") -> DataFrame:
    """word and rxcui of each word of the products' names."""
    words = F.explode(F.flatten(F.transform(column, lambda x: F.split(x, " "))))
    return products.select(words.alias("word"), "rxcui").where("word <> ''").distinct()


def prepared(text: Column, abbreviations: Mapping[str, str]) -> Column:
    """A written name: thousands without commas, .5 as 0.5, a space before units, abbreviations in full."""
    t = F.regexp_replace(F.lower(text), r"(\d),(\d{3})", "$1$2")
    t = F.regexp_replace(t, r"(^|[^\d])\.(\d)", "$10.$2")
    t = F.regexp_replace(t, r"(\d)(mg|mcg|g|%)", "$1 $2")
    words = F.filter(F.split(F.trim(F.regexp_replace(t, r"[^a-z0-9.%/]+", " ")), " "), lambda w: w != "")
    return F.array_join(mapped(words, abbreviations), " ")


def names_only(words: Column, skip: Sequence[str]) -> Column:
    """The words that can name a product: no numbers, units, or words to skip."""
    return F.array_distinct(F.filter(words, lambda w: ~w.rlike(r"^[\d./%]") & ~w.isin("mg", "mcg", "g", *skip)))


def candidates(mentions: DataFrame, products: DataFrame) -> DataFrame:
    """mention, rxcui of the products all of whose words a mention has, and no others.

    mentions: mention, words. That is so where the sets of words are equal, so it is one
    equal join on the sorted words, instead of counts over all that share a word.
    """
    named = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda w: w != ""))).alias("_words")
    asked = mentions.select("mention", named(F.col("words")))
    has = products.select("rxcui", named(F.flatten(F.transform("ingredients", lambda x: F.split(x, " "))))).where(F.size("_words") > 0)
    return asked.join(has, "_words").select("mention", "rxcui")


def narrowed(found: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    """Each mention's candidates, by one condition after another; one that none meets is passed over."""
    for c in conditions:
        found = soft_filter(found, ["mention"], c)
    return found


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def spelled(mentions: DataFrame, names: DataFrame, alike: float = ALIKE, margin: float = MARGIN) -> DataFrame:
    """mention, name, score: the dictionary's name most like a written one.

    mentions: mention, written; names: name. Only names with the same sound, or the same
    first letters and nearly the same length, are compared. None if the best is not
    alike enough, or another name comes within margin of it.
    """
    keys = lambda c: F.array(F.concat(F.lit("s"), F.soundex(c)), *[F.concat(F.lit("p"), F.left(c, F.lit(2)), F.floor((F.length(c) + d) / 3).cast("string")) for d in (0,)])
    near = lambda c: F.array(F.concat(F.lit("s"), F.soundex(c)), *[F.concat(F.lit("p"), F.left(c, F.lit(2)), (F.floor(F.length(c) / 3) + d).cast("string")) for d in (-1, 0, 1)])
    a = mentions.select("mention", "written", F.explode(near(F.col("written"))).alias("key"))
    b = names.select("name").distinct().select("name", F.explode(keys(F.col("name"))).alias("key"))
    pairs = a.join(b, "key").select("mention", "written", "name").distinct().withColumn("score", similarity(F.col("written"), F.col("name"))).where(F.col("score") >= alike)
    w = Window.partitionBy("mention").orderBy(F.desc("score"), "name")
    ranked = pairs.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    return ranked.where((F.col("rn") == 1) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= margin))).select("mention", "name", "score")


def first_known(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """mention and attempt: the place of the first of its tries that is a known word; null if none is.

    mentions: mention, tries (array; null ones are passed over); known: word.
    """
    each = mentions.select("mention", F.posexplode("tries").alias("attempt", "word"))
    hits = each.join(known.withColumn("hit", F.lit(True)), "word", "left")
    return hits.groupBy("mention").agg(F.min(F.when(F.col("hit"), F.col("attempt"))).alias("attempt"))


# Words of dose forms, in the order in which they decide, with those that tell kinds of a form apart.
FORMS: tuple[tuple[str, str, tuple[tuple[str, str], ...]], ...] = (
    ("inj", "inj injection injectable syringe pen pens injector autoinjector cartridge vial intravenous subcutaneous intramuscular im iv sc subq kwikpen flexpen solostar flextouch piggyback infusion prefilled", (("pen", "pen pens injector autoinjector kwikpen flexpen solostar flextouch"), ("syringe", "syringe prefilled pfs"))),
    ("ophth", "ophth ophthalmic eye", (("susp", "susp suspension"), ("oint", "oint ointment"), ("gel", "gel"), ("emul", "emulsion"), ("soln", "soln solution drops"))),
    ("otic", "otic ear", ()),
    ("nasal", "nasal", ()),
    ("inhal", "inhal inhalation inhaler aero aerosol hfa nebu neb nebulization diskus respimat ellipta actuat metered mdi dpi inh", (("neb", "nebu neb nebulization nebulizer"), ("powder", "powder dpi diskus ellipta breath capsule cap"), ("aerosol", ""))),
    ("rectal", "rectal suppository supp enema", ()),
    ("vaginal", "vaginal vag ring insert", ()),
    ("patch", "patch patches ptch ptwk transdermal td", ()),
    ("topical", "cream crm ointment oint gel lotion foam shampoo external topical swab", (("cream", "cream crm"), ("ointment", "ointment oint"), ("gel", "gel"), ("lotion", "lotion"), ("foam", "foam"), ("shampoo", "shampoo"), ("other", ""))),
    ("film", "film", ()),
    ("tab", "tab tabs tablet tablets caplet", (("chew", "chew chewable"), ("odt", "odt disintegrating dispersible"), ("sl", "sl sublingual buccal"), ("efferv", "effervescent"))),
    ("cap", "cap caps capsule capsules", ()),
    ("oral_liq", "soln solution susp suspension syrup elixir liquid conc concentrate granules packet powder recon emulsion drops mouthwash rinse paste lozenge troche gum", ()),
)
RELEASES = (("er", "er xr xl sr cr la extended ext hr"), ("dr", "dr ec delayed enteric"))


def _has(text: Column, words: str) -> Column:
    return text.rlike(rf"\b({'|'.join(words.split())})\b") if words else F.lit(True)


def dose_form(text: Column) -> Column:
    """struct<form, kind> of what a text says of its dose form: the first form of FORMS of which it has a word, and its first kind."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "-", " ")
    kind = lambda kinds: F.coalesce(*[F.when(_has(t, w), F.lit(k)) for k, w in kinds], F.lit(""))
    found = [F.when(_has(t, words), F.struct(F.lit(form).alias("form"), kind(kinds).alias("kind"))) for form, words, kinds in FORMS]
    return F.coalesce(*found, F.struct(F.lit(None).cast("string").alias("form"), F.lit("").alias("kind")))


def release(text: Column) -> Column:
    """er, dr or ir: how a product is released; hours after a slash are an amount."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"/\s*(24|12)?\s*(hr|hrs|hour|hours|day)\b", " ")
    return F.coalesce(*[F.when(_has(t, w) | (t.rlike(r"\b(12|24) ?(hr|hour)\b") if k == "er" else F.lit(False)), F.lit(k)) for k, w in RELEASES], F.lit("ir"))


def gated(written: Column, guess: Column, confidence: Column, least: float = 0.7) -> Column:
    """struct<name, note>: the guess if it is sure enough, else the name as written with the guess as a note."""
    sure = F.coalesce(confidence >= least, F.lit(False))
    other = guess.isNotNull() & (F.lower(F.trim(guess)) != F.lower(F.trim(written)))
    return F.struct(F.when(sure, guess).otherwise(F.trim(written)).alias("name"), F.when(~sure & other, F.concat(F.lit("possibly "), F.trim(guess))).alias("note"))


def scored(told: DataFrame, labels: DataFrame) -> DataFrame:
    """group, cases, answered, right_drug, right_strength and right for each group of labelled cases.

    told: mention, ingredients, strength of what was resolved; labels: mention, group, n (how
    many lines say it), ingredients, strength; null ingredients must not be resolved.
    """
    both = labels.join(told.withColumnsRenamed({"ingredients": "_got", "strength": "_mg"}), "mention", "left")
    drug = F.col("_got").eqNullSafe(F.col("ingredients"))
    strength = drug & (F.col("strength").isNull() | same_strength(F.col("_mg"), F.col("strength")))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return both.groupBy("group").agg(F.sum("n").alias("cases"), total(F.col("_got").isNotNull())("answered"), total(drug)("right_drug"), total(strength)("right"))
