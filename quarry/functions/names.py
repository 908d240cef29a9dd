"""Names, slugs and ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import written

SUFFIX = r"(?i),?\s*(inc\.?|llc\.?|corp\.?|co\.?|ltd\.?|l\.?l\.?c\.?|incorporated|corporation|company)\z"
DOMAIN_END = r"\.(com|org|net|io|co|ai)\z"


def dashed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def slug(name: Column) -> Column:
    """At most 50 characters; the cut may leave a dash at the end."""
    return F.left(dashed(name), F.lit(50))


def normalized_name(name: Column) -> Column:
    """Lower case, without one company suffix (which needs no separator before it), white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), SUFFIX, ""), r"\s+", " "))


def without_suffix(slug_: Column) -> Column:
    for end in ("-inc", "-llc", "-corp", "-group"):
        slug_ = F.regexp_replace(slug_, rf"{end}\z", "")
    return slug_


def domain_slug(domain: Column) -> Column:
    return dashed(F.regexp_replace(F.regexp_replace(domain, r"^www\.", ""), DOMAIN_END, ""))


def short_id(prefix: str, key: Column) -> Column:
    """A deterministic id: prefix and 8 base-36 digits of the key's hash."""
    return F.concat(F.lit(prefix), F.lpad(F.right(F.lower(F.conv(F.hex(F.xxhash64(key)), 16, 36)), F.lit(8)), 8, "0"))


def assigned_ids(keys: DataFrame, prefix: str, key: str, taken: DataFrame | None = None, make: Callable[[str, Column], Column] = short_id) -> DataFrame:
    """key, id of the distinct keys: the id that `make` gives, or another one where two keys would share it.

    Of keys with one id the smallest keeps it, and the others are tried again with their attempt's number appended. taken (id, key) are ids that are given already: a key that is among them
    keeps its id, and nobody else gets it. So the ids are the same in every run over the same keys. A null key has no id. There are as many rounds as the most keys that share an id, nearly always one.
    """
    asked = keys.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct()
    own, held = asked, None
    if taken is not None:
        held = taken.select("id", "key")
        own = own.join(held.select("key"), "key", "left_anti")
    # written once: each round reads it twice
    own, done, attempt = written(own, "keys"), held, 0
    while True:
        tried = own.withColumn("id", make(prefix, F.concat_ws("#", "key", F.lit(str(attempt))) if attempt else F.col("key")))
        first = tried.groupBy("id").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
        if done is not None:
            first = first.join(done.select("id", F.lit(True).alias("_given")), "id", "left").select("id", F.when(F.col("_given").isNull(), F.col("key")).alias("key"), F.when(F.col("_given").isNull(), F.col("n")).alias("n"))
        first = written(first, "ids")
        won = first.where("key IS NOT NULL").select("id", "key")
        done = won if done is None else done.unionByName(won)
        # only ids of several keys, or given ones, have losers; they are few, and later rounds read no more than that
        clashes = first.where("n > 1 OR n IS NULL").select("id", F.col("key").alias("_winner"))
        if clashes.isEmpty():
            return done.select("key", "id") if held is None else done.join(asked, "key", "left_semi").select("key", "id")
        own, attempt = written(tried.join(clashes, "id").where("_winner IS NULL OR key <> _winner").select("key"), "keys"), attempt + 1


def alias_map(entities: DataFrame) -> DataFrame:
    """alias, slug: a slug and a normalised name lead to the latest entity that has them; a slug without its suffix only where nothing else does.

    entities: slug, name, ord (load order).
    """
    sure = entities.select(F.col("slug").alias("alias"), "slug", "ord", F.lit(0).alias("kind")).union(entities.select(normalized_name(F.col("name")), "slug", "ord", F.lit(1)))
    sure = sure.groupBy("alias").agg(F.max_by("slug", F.struct("ord", "kind")).alias("slug"))
    cut = entities.withColumn("alias", without_suffix(F.col("slug"))).where("alias <> slug").groupBy("alias").agg(F.min_by("slug", "ord").alias("slug"))
    return sure.union(cut.join(sure, "alias", "left_anti").select("alias", "slug"))


def resolve_names(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """names with `resolved`: by raw slug, then normalised name, then slug without suffix; else that last slug itself.

    Distinct names are looked up, once each: their three forms are rows of one join, of which the first that is found counts.
    """
    raw = slug(F.col("_name"))
    cut = F.regexp_replace(without_suffix(raw), r"-s-[\s\S]*\z", "")
    one = names.select(F.col(name).alias("_name")).where("_name IS NOT NULL").distinct().select("_name", raw.alias("_raw"), normalized_name(F.col("_name")).alias("_norm"), cut.alias("_cut"))
    forms = one.select("_name", F.posexplode(F.array("_raw", "_norm", "_cut")).alias("_turn", "alias"), F.coalesce(F.nullif("_cut", F.lit("")), "_raw").alias("_else"))
    found = forms.join(aliases.select("alias", "slug"), "alias", "left").groupBy("_name").agg(F.min_by("slug", F.when(F.col("slug").isNotNull(), F.col("_turn"))).alias("_found"), F.first("_else").alias("_else"))
    told = found.select("_name", F.coalesce("_found", "_else").alias("resolved"))
    return names.join(told, F.col(name) == F.col("_name"), "left").select(*names.columns, "resolved")
