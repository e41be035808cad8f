"""Names of plans and carriers as clients read them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# How official plan names begin, the longest of a carrier first, what stands for it, and words of carriers' families.
PREFIXES = (
    ("AARP Medicare Advantage from ", ""), ("AARP Medicare Advantage ", ""), ("Allina Health Aetna Medicare ", ""), ("Blue Cross Medicare Advantage ", ""),
    ("HealthPartners ", ""), ("HumanaChoice ", "Choice "), ("Humana ", ""), ("Medica ", ""), ("Gundersen MN Quartz Med Advantage ", ""), ("Align ", ""),
    ("Wellcare ", ""), ("HealthSpring ", ""), ("MedicareBlue Rx ", ""),
)
FAMILIES = (
    ("HealthPartners", ("healthpartners", "health partners")), ("Blue Cross", ("blue cross", "freedom blue", "medicareblue")), ("Medica", ("medica",)), ("Humana", ("humana",)),
    ("UHC", ("uhc", "aarp", "united")), ("Aetna", ("aetna", "allina")), ("UCare", ("ucare",)), ("Align", ("align",)),
)


def family(name: Column, families: Sequence[tuple[str, Sequence[str]]] = FAMILIES) -> Column:
    """The first family of which a short plan name has a word; the name itself if none. In official names "Medicare" would count as a carrier."""
    low = F.lower(F.coalesce(name, F.lit("")))
    hits = [F.when(F.array_contains(F.array(*[low.contains(w) for w in words]), True), F.lit(label)) for label, words in families]
    return F.coalesce(*hits, name)


def plan_name(official: Column, fallback: Column, prefixes: Sequence[tuple[str, str]] = PREFIXES) -> Column:
    """An official name without the number of its plan and the carrier that it begins with; the fallback if it is null or empty.

    A name that is nothing but a carrier stays. What stands after "from UHC" is its kind.
    """
    bare = F.trim(F.regexp_replace(official, r"\s*\b[HRS]\d{4}-\d{3}\b", ""))
    cut = [F.when(bare.startswith(p), F.trim(F.concat(F.lit(new), F.substr(bare, F.lit(len(p) + 1))))) for p, new in prefixes]
    rest = F.coalesce(*cut, bare)
    return F.when(F.coalesce(official, F.lit("")) == "", fallback).otherwise(F.replace(F.when(rest == "", bare).otherwise(rest), F.lit(" from UHC ("), F.lit(" (")))


def contract_key(contract: Column) -> Column:
    return F.upper(F.trim(F.coalesce(contract, F.lit(""))))
