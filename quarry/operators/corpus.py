"""Joins and aggregates over claims, entities, topics and sources. Each operator takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import written


def references_per_key(keys: DataFrame, refs: DataFrame, key: str, item: str, name: str = "n_claims") -> DataFrame:
    """How many distinct items refer to each key; keys without any have 0."""
    counts = refs.groupBy(key).agg(F.countDistinct(item).alias(name))
    return keys.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def cited_sources(citations: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    """The sources that some citation names."""
    return sources.join(citations.select(source), source, "left_semi")


def named(refs: DataFrame, names: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """refs with the name of their key, or the key itself where it has none."""
    return refs.join(names.select(key, F.col(name).alias("_name")), key, "left").withColumn(out, F.coalesce("_name", F.col(key).cast("string"))).drop("_name")


def missing_references(refs: DataFrame, known: list[DataFrame], key: str) -> DataFrame:
    """The references to keys that none of the key sets has."""
    keys = known[0].select(key)
    for more in known[1:]:
        keys = keys.union(more.select(key))
    return refs.join(keys, key, "left_anti")


def corrections(claims: DataFrame, version: str = "version") -> DataFrame:
    """Change log entries after the first version, newest first within the caller's order."""
    return claims.where(F.col(version) > 1)


def status_rank(status: Column, order: list[str]) -> Column:
    out = F.when(F.lit(False), 0)
    for k, s in enumerate(order):
        out = out.when(status == s, k)
    return out.otherwise(len(order))


def newest_per_group(df: DataFrame, group: list[str], newest: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order, numbered from 1."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*newest))).where(F.col("rank") <= n)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with each row's place in an order, from 1, without a task that has all rows.

    Rows are sorted by range and written with their place within their range; the sizes of the ranges, a row each, give where each begins. Rows that the order doesn't tell apart are numbered in any order. df has no
    column _at or _before.
    """
    from pyspark.sql import Window

    bits = 33  # of a row's place within its range in what monotonically_increasing_id gives
    rows = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = rows.groupBy(F.shiftright("_at", bits).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    out = rows.withColumn("_range", F.shiftright("_at", bits)).join(F.broadcast(starts), "_range")  # a row a range
    return out.withColumn(name, F.col("_at") - F.shiftleft("_range", bits) + F.col("_before") + 1).select(*df.columns, name)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key new doesn't have."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))
