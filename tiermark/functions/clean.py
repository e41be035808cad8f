"""Column expressions that parse and normalise values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that mean yes; all others that are not null mean no.
YES = ("Y", "YES", "1", "TRUE")


def money(text: Column) -> Column:
    """A number written with $ and commas; null for anything else."""
    return F.regexp_replace(text, r"[$,\s]", "").try_cast("double")


def number_or_zero(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def cents(amount: Column) -> Column:
    """Whole cents of a double amount, halves up."""
    return F.floor(amount * 100 + 0.5).cast("long")


def padded(text: Column, width: int) -> Column:
    """An ID with leading zeros; longer ones stay."""
    t = F.trim(text)
    return F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0"))


def pharmacy_id(text: Column) -> Column:
    """A 12-digit pharmacy number without its leading 10."""
    t = F.trim(text)
    return F.when((F.length(t) == 12) & t.startswith("10"), F.substring(t, 3, 10)).otherwise(t)


def total_premium(total: Column, part_c: Column, part_d: Column) -> Column:
    return F.coalesce(total, part_c + part_d)


def first_rule(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The replacement of the first rule whose pattern the text has; the text if none does."""
    out = None
    for pattern, value in rules:
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return text if out is None else out.otherwise(text)


def yes(text: Column) -> Column:
    """True or false; null stays null, as unknown is not no."""
    return F.when(text.isNotNull(), F.upper(F.trim(text)).isin(*YES))


def chosen_cost(kind: Column, amount: Column, other_kind: Column, other_amount: Column) -> Column:
    """The first cost share that applies (type 1 or 2), as type and amount; else type 0 and nothing."""
    return F.coalesce(F.when(kind.isin(1, 2), F.struct(kind.alias("kind"), amount.cast("double").alias("amount"))), F.when(other_kind.isin(1, 2), F.struct(other_kind.alias("kind"), other_amount.cast("double").alias("amount"))), F.struct(F.lit(0).alias("kind"), F.lit(0.0).alias("amount")))


def zip5(text: Column) -> Column:
    """A five-digit ZIP, of one with or without its extension; null for others."""
    found = F.regexp_extract(F.trim(text), r"^(\d{5})(-\d{4})?$", 1)
    return F.when(found != "", found)


def mapped(words: Column, table: Mapping[str, str]) -> Column:
    """An array's words, replaced where the table has them."""
    pairs = F.create_map(*[F.lit(x) for k in sorted(table) for x in (k, table[k])])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(pairs, w), w))


def months_left(year: Column, month: Column, this_year: Column) -> Column:
    """Months of a plan year that costs are counted for: all of a later year, the rest of this one."""
    return F.sequence(F.when(year > this_year, F.lit(1)).otherwise(month), F.lit(12))


def listed(text: Column) -> Column:
    """The parts of a comma list; a comma before three digits of a number is none that parts."""
    return F.transform(F.split(text, r",(?!(?<=\d,)\d{3}(?!\d))"), lambda x: F.trim(x))


def paired_lists(names: Column, values: Column) -> Column:
    """array<struct<name, value>> of two comma lists; values of another number than names are dropped."""
    n, v = listed(names), listed(values)
    return F.zip_with(n, F.when(F.size(n) == F.size(v), v).otherwise(F.transform(n, lambda _: F.lit(None).cast("string"))), lambda a, b: F.struct(a.alias("name"), b.alias("value")))


def split_valid(df: DataFrame, value: Column, out: str) -> tuple[DataFrame, DataFrame]:
    """df with out where value is not null, and the rows set aside."""
    both = df.withColumn(out, value)
    return both.where(F.col(out).isNotNull()), both.where(F.col(out).isNull()).drop(out)
