"""The terms by which a fill is paid: at a store, by mail, and in the phases of the deductible. Whole cents; shares in percent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A month of insulin costs this many cents at most; tiers from here on have the fee of brands.
INSULIN, BRANDS = 3500, 3


def said(kind: Column) -> Column:
    """Whether a cost type is used: 1 a copay, 2 a share; 0 and null mean that the plan has no such price."""
    return F.coalesce(kind.isin(1, 2), F.lit(False))


def retail(preferred: Column) -> Column:
    """kind and amount of the price for the kind of store, or of the other one if the plan does not use it; 0 and 0 without both."""
    pair = lambda k: F.when(said(F.col(f"{k}_type")), F.struct(F.col(f"{k}_type").cast("int").alias("kind"), F.coalesce(F.col(f"{k}_amount"), F.lit(0)).cast("long").alias("amount")))
    none = F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("amount"))
    return F.when(F.coalesce(preferred, F.lit(True)), F.coalesce(pair("pref"), pair("std"), none)).otherwise(F.coalesce(pair("std"), pair("pref"), none))


def ruled(ded_applies: Column) -> Column:
    return ~ded_applies.eqNullSafe("N")


def fill_terms(fills: DataFrame) -> DataFrame:
    """fills with terms: a struct of price, fee, cost_type, cost_amt, ded_applies and flat.

    fills: price, negotiated, brand_fee, generic_fee, tier, preferred, captured (prices come
    from a store, with its fee in them), insulin, month (of insulin), has_row (the plan has the
    tier), pref and std type and amount, ded_applies. Insulin is flat, at its month's cost if
    captured, else at the limit. A tier that the plan lacks is flat at nothing. A negotiated
    price replaces one that is not captured, with the fee of brands.
    """
    captured, insulin = F.coalesce("captured", F.lit(False)), F.coalesce("insulin", F.lit(False))
    lacking = ~insulin & ~F.coalesce("has_row", F.lit(False))
    negotiated = ~captured & F.col("negotiated").isNotNull()
    brand = F.when(F.col("brand_fee") > 0, F.col("brand_fee")).otherwise(F.coalesce("generic_fee", F.lit(0)))
    fee = F.when(captured, 0).when(negotiated | (F.col("tier") >= BRANDS), brand).otherwise(F.coalesce("generic_fee", F.lit(0)))
    priced = ~insulin & ~lacking
    price = F.when(insulin, F.when(captured, F.col("price"))).when(priced, F.when(negotiated, F.col("negotiated")).otherwise(F.col("price")))
    flat = F.when(insulin, F.when(captured, F.coalesce("month", F.lit(INSULIN))).otherwise(INSULIN)).when(lacking, 0)
    of = fills.withColumn("_share", retail(F.col("preferred")))
    terms = F.struct(
        price.cast("long").alias("price"), F.when(priced, fee).cast("long").alias("fee"), F.when(priced, F.col("_share.kind")).alias("cost_type"),
        F.when(priced, F.col("_share.amount")).alias("cost_amt"), F.when(priced, ruled(F.col("ded_applies"))).alias("ded_applies"), flat.cast("long").alias("flat"),
    )
    return of.withColumn("terms", terms).drop("_share")


def mail_terms(fills: DataFrame) -> DataFrame:
    """fills with offered and terms, as in fill_terms, of a month by mail.

    fills: price, negotiated, captured, mail_price (of three months, captured), insulin, month,
    mail_type, mail_amount (of three months) and ded_applies of the plan's three-month row, if it
    has one. A month is a third, rounded down; the price of nothing is unknown. A drug is
    offered by mail if its tier has a mail price, or if it is insulin.
    """
    captured, insulin = F.coalesce("captured", F.lit(False)), F.coalesce("insulin", F.lit(False))
    tier = said(F.col("mail_type"))
    third = F.when(F.col("mail_price") > 0, F.expr("mail_price div 3"))
    usual = F.when(captured, third).otherwise(F.coalesce("negotiated", "price"))
    priced = tier & ~insulin
    terms = F.struct(
        F.when(insulin, F.when(captured, third)).when(tier, usual).cast("long").alias("price"), F.when(priced, F.lit(0)).cast("long").alias("fee"), F.when(priced, F.col("mail_type").cast("int")).alias("cost_type"),
        F.when(priced, F.when(F.col("mail_type") == 2, F.coalesce("mail_amount", F.lit(0))).otherwise(F.expr("coalesce(mail_amount, 0) div 3"))).cast("long").alias("cost_amt"),
        F.when(priced, ruled(F.col("ded_applies"))).alias("ded_applies"), F.when(insulin, F.when(captured, F.coalesce("month", F.lit(INSULIN))).otherwise(INSULIN)).cast("long").alias("flat"),
    )
    return fills.withColumn("offered", tier | insulin).withColumn("terms", terms)


def phases(fills: DataFrame) -> DataFrame:
    """fills with deductible_phase and initial_phase: what a captured price should be in each, by the plan's terms.

    fills: price, preferred, insulin, its copay and coins (for the kind of store), has_row, pref
    and std type and amount, ded_applies. Insulin costs the least of its copay, share, limit and
    price in both. Without the tier's row both are null.
    """
    of = fills.withColumn("_share", retail(F.col("preferred")))
    share = F.when(F.col("_share.kind") == 0, 0).when(F.col("_share.kind") == 2, F.expr("price * _share.amount div 100")).otherwise(F.least(F.col("_share.amount"), F.col("price")))
    own = F.least(F.col("copay"), F.expr("coins * price div 100"), F.lit(INSULIN), F.when(F.col("price") > 0, F.col("price")))
    insulin, has = F.coalesce("insulin", F.lit(False)), F.coalesce("has_row", F.lit(False))
    first = F.when(insulin, own).when(has, F.when(ruled(F.col("ded_applies")), F.col("price")).otherwise(share))
    return of.withColumns({"deductible_phase": first.cast("long"), "initial_phase": F.when(insulin, own).when(has, share).cast("long")}).drop("_share")
