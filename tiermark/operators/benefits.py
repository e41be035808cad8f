"""Benefits and tier costs from the wide public benefit files, by rules that are data."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermark.functions import said

#: A step whose amount is missing leaves the decision to the next one.
NEXT = "next"


@dataclass(frozen=True)
class Step:
    """One line of a rule: if the gate column says yes, the source column's number (or a constant) is the result.

    empty: what holds if the number is missing, or NEXT. given: a column that must have a
    number for the step to be taken. named: the gate is any text instead of a yes.
    """

    gate: str
    source: str | None = None
    empty: float | str | None = None
    given: str | None = None
    constant: float | None = None
    named: bool = False


@dataclass(frozen=True)
class Rule:
    """An output: the first step that decides, else the default."""

    steps: Sequence[Step]
    default: float | None = None


def visit(area: str) -> dict[str, Rule]:
    """A covered visit: its copay, else its coinsurance, else nothing to pay."""
    copay, coins = f"pbp_{area}_copay_yn", f"pbp_{area}_coins_yn"
    return {
        "copay": Rule([Step(copay, f"pbp_{area}_copay_amt_mc_min", 0.0), Step(coins)], 0.0),
        "coins": Rule([Step(copay), Step(coins, f"pbp_{area}_coins_pct_mc_min")]),
    }


def gated(name: str, *more: str) -> Rule:
    """An amount that counts only if its flag says yes; the first of several that is given."""
    pairs = [(n + "_yn", n + "_amt") for n in (name, *more)]
    return Rule([Step(yn, amt, NEXT) for yn, amt in pairs])


# Columns of the public benefit files, by what they say.
RULES: dict[str, Rule] = {
    "oop_max_inn": Rule([Step("pbp_d_out_pocket_amt_yn", "pbp_d_out_pocket_amt")]),
    "oop_max_comb": Rule([Step("pbp_d_comb_max_enr_amt_yn", "pbp_d_comb_max_enr_amt")]),
    "medical_deductible": Rule(gated("pbp_d_ann_deduct", "pbp_d_inn_deduct", "pbp_d_comb_deduct").steps, 0.0),
    "part_b_giveback": gated("pbp_d_mco_pay_reduct"),
    **{f"pcp_{k}": r for k, r in visit("b7a").items()},
    **{f"spec_{k}": r for k, r in visit("b7d").items()},
    **{f"er_{k}": r for k, r in visit("b4a").items()},
    "hosp_copay": Rule([Step("pbp_b1a_copay_yn", "pbp_b1a_copay_mcs_amt_int1_t1", NEXT), Step("pbp_b1a_copay_yn", "pbp_b1a_copay_mcs_amt_t1", 0.0), Step("pbp_b1a_coins_yn")], 0.0),
    "hosp_coins": Rule([Step("pbp_b1a_copay_yn"), Step("pbp_b1a_coins_yn", "pbp_b1a_coins_mcs_pct_t1")]),
    "hosp_day_begin": Rule([Step("pbp_b1a_copay_yn", "pbp_b1a_copay_mcs_bgnd_int1_t1", given="pbp_b1a_copay_mcs_amt_int1_t1")]),
    "hosp_day_end": Rule([Step("pbp_b1a_copay_yn", "pbp_b1a_copay_mcs_endd_int1_t1", given="pbp_b1a_copay_mcs_amt_int1_t1")]),
    "dental_allowance": gated("pbp_b16c_maxplan_cmp", "pbp_b16b_maxplan_pv"),
    "vision_allowance": gated("pbp_b17b_comb_maxplan"),
    "hearing_allowance": gated("pbp_b18b_maxplan"),
    "otc_amount": gated("pbp_b13b_maxplan"),
    "fitness_included": Rule([Step("pbp_b14c_bendesc_amo_mhc", constant=1.0), Step("pbp_b14c_bendesc_typ_mhc", constant=1.0, named=True)]),
}


def columns_of(rules: Mapping[str, Rule]) -> list[str]:
    """The columns that rules read, each once."""
    return list(dict.fromkeys(c for r in rules.values() for s in r.steps for c in (s.gate, s.source, s.given) if c))


def number(name: str) -> Column:
    return F.trim(F.col(name)).try_cast("double")


def compiled(rule: Rule) -> Column:
    """A rule as one expression."""
    out = None
    for s in rule.steps:
        said = F.coalesce(F.trim(F.col(s.gate)), F.lit(""))
        taken = (said != "") if s.named else (said == "1")
        value = F.lit(s.constant) if s.constant is not None else number(s.source) if s.source else F.lit(None).cast("double")
        if s.given:
            taken = taken & number(s.given).isNotNull()
        if s.empty == NEXT:
            taken = taken & value.isNotNull()
        elif s.empty is not None:
            value = F.coalesce(value, F.lit(s.empty))
        out = F.when(taken, value) if out is None else out.when(taken, value)
    return out.otherwise(F.lit(rule.default)) if rule.default is not None else out


def benefits(wide: DataFrame, keys: Sequence[str], rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """keys and a column for each rule; a column that a rule reads and the file lacks is an error, as years rename them.

    A flag of 1 says yes, all else (null too) no; a blank or bad amount is missing.
    """
    missing = [c for c in columns_of(rules) if c not in wide.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return wide.select(*keys, *[compiled(r).alias(n) for n, r in rules.items()])


_TIER = re.compile(r"mrx_tier_([a-z]+)_(copay|coins)_(\d)m")
# What the prefixes of a tier's columns stand for, and the codes of the days of a supply.
SPLIT, UNSPLIT, MAIL = ("rspfd", "rsstd"), "rstd", ("mospfd", "mosstd", "mostd")
SUPPLIES = {"1": 1, "3": 2}


def tier_costs(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, days, and type and amount of the preferred, standard and mail cost of each supply: one row for each tier and supply that has one.

    wide: keys, mrx_tier_locat_rsplt and columns named mrx_tier_{prefix}_{copay|coins}_{n}m,
    all text. A copay (type 1) comes before a coinsurance (type 2, as a fraction). Plans that
    split their stores have prefixes for preferred and standard ones, others one for both;
    one that is missing is the other. Mail takes the first prefix that has a cost, else type
    0. Which columns there are is read from their names.
    """
    named = {m.groups(): c for c in wide.columns if (m := _TIER.fullmatch(c))}

    def cost(prefix: str, months: str) -> Column:
        copay, coins = (number(named[prefix, k, months]) if (prefix, k, months) in named else F.lit(None).cast("double") for k in ("copay", "coins"))
        of = lambda kind, amount: F.struct(F.lit(kind).alias("type"), amount.alias("amount"))
        return F.when(copay.isNotNull(), of(1, copay)).when(coins.isNotNull(), of(2, coins / 100))

    split = F.coalesce(F.trim(F.col("mrx_tier_locat_rsplt")), F.lit("")) != ""

    def supply(months: str) -> Column:
        first, second = (F.when(split, cost(p, months)).otherwise(cost(UNSPLIT, months)) for p in SPLIT)
        mail = F.coalesce(*[cost(p, months) for p in MAIL], F.struct(F.lit(0).alias("type"), F.lit(0.0).alias("amount")))
        return F.struct(F.lit(SUPPLIES[months]).alias("days"), F.coalesce(first, second).alias("pref"), F.coalesce(second, first).alias("std"), mail.alias("mail"))

    months = sorted({k[2] for k in named} & set(SUPPLIES))
    each = wide.select(*keys, F.explode(F.array(*[supply(m) for m in months])).alias("x")).where("x.pref is not null")
    return each.select(*keys, "x.days", *[F.col(f"x.{k}.{v}").alias(f"{k}_{v}") for k in ("pref", "std", "mail") for v in ("type", "amount")])


def cost_shares(costs: DataFrame, keys: Sequence[str], first: Sequence[str] = ("segment",)) -> DataFrame:
    """What a plan's tier asks, as text: one row for each of keys that has a one-month supply.

    costs: keys, the columns of first, days (1: a month, 2: three), type and amount of pref,
    std and mail as in tier_costs, ded_applies ("N": no; null and all else: yes) and insulin.
    Of several rows of a supply, the first by the columns of first counts. retail is the
    preferred price, else the standard one; retail_standard only where it differs; mail_90 is
    the mail price of three months. Insulin has its own limit instead. A share that cannot be
    said is left out of text.
    """
    parts = ("pref_type", "pref_amount", "std_type", "std_amount", "mail_type", "mail_amount", "ded_applies", "insulin")
    of = lambda days: F.min_by(F.when(F.col("days") == days, F.struct(*parts)), F.when(F.col("days") == days, F.struct(*first, *parts)))
    both = costs.groupBy(*keys).agg(of(1).alias("one"), of(2).alias("three")).where("one is not null")
    pref, std = (said.share(F.col(f"one.{k}_type"), F.col(f"one.{k}_amount")) for k in ("pref", "std"))
    rows = both.select(*keys, "one", F.coalesce(pref, std).alias("retail"), F.coalesce(std, pref).alias("_std"), said.share(F.col("three.mail_type"), F.col("three.mail_amount")).alias("mail_90"))
    rows = rows.withColumn("retail_standard", F.when(~F.col("_std").eqNullSafe(F.col("retail")), F.col("_std")))
    applies, insulin = ~F.col("one.ded_applies").eqNullSafe("N"), F.coalesce(F.col("one.insulin"), F.lit(False))
    two = F.col("retail_standard").isNotNull()
    line = F.concat_ws(
        said.BETWEEN,
        F.concat(F.col("retail"), F.when(two, " (preferred pharmacy)").otherwise("")),
        F.concat(F.col("retail_standard"), F.lit(" standard")),
        F.when(applies, "deductible applies").otherwise("no deductible"),
    )
    short = F.concat(F.regexp_replace(F.coalesce("retail", F.lit("")), " coinsurance", ""), F.when(two, " pref.").otherwise(""), F.when(applies, " · ded. applies").otherwise(" · no ded."))
    return rows.select(
        *keys, "retail", "retail_standard", "mail_90", applies.alias("deductible_applies"), insulin.alias("insulin_cap"),
        F.when(insulin, "$35/month max (insulin)").otherwise(line).alias("text"), F.when(insulin, "$35/mo max (insulin)").otherwise(short).alias("short"),
    )
