"""The noise predicate of draft entities. Its lists are configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NoiseRules:
    """Lists of one corpus: slugs and promotions (whole slugs), patterns (on name or slug), prefixes and patterns of slugs, a pattern of descriptions, and the types that it does not apply to."""

    slugs: list[str]
    patterns: list[str]
    prefixes: list[str]
    slug_patterns: list[str]
    promotions: list[str]
    described: str
    real: list[str]


def is_noise(slug: Column, name: Column, type_: Column, description: Column, rules: NoiseRules) -> Column:
    name, type_ = F.coalesce(name, F.lit("")), F.coalesce(type_, F.lit(""))
    either = "(?i)(?:" + "|".join(p.replace("$", r"\z") for p in rules.patterns) + ")"
    word = r"(?:^|[^A-Za-z0-9_])" + rules.described + r"(?:[^A-Za-z0-9_]|\z)"
    return (
        slug.isin(rules.slugs + rules.promotions)
        | name.rlike(either)
        | slug.rlike(either)
        | slug.rlike("^(?:" + "|".join(rules.prefixes) + ")")
        | slug.rlike("|".join(p.replace("$", r"\z") for p in rules.slug_patterns))
        | (F.lower(F.coalesce(description, F.lit(""))).rlike(word) & ~type_.isin(rules.real))
    )
