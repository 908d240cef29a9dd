"""Notes as records: a text of a few lines gives a source and a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import names, urls
from quarry.operators.mentions import parse_note

STATEMENT, QUOTE = 240, 300


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """file, text of every text file below path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def notes(texts: DataFrame, entity: Column, topic: Column, entities: DataFrame, topics: DataFrame, today: str) -> DataFrame:
    """texts (key, text) as rows key, source and claim (structs) for notes that have a title, a statement and a source, and whose entity, and topic if any, exist."""
    rows = texts.select("key", parse_note(F.col("text")).alias("n"), entity.alias("entity"), F.nullif(topic, F.lit("")).alias("topic"))
    rows = rows.where("n.title <> '' AND n.statement <> '' AND n.source <> ''").join(entities.select(F.col("slug").alias("entity")), "entity", "left_semi")
    known = topics.select(F.col("slug").alias("topic"), F.lit(True).alias("_known"))
    rows = rows.join(known, "topic", "left").where("topic IS NULL OR _known")
    host = urls.host(F.col("n.source"))
    publisher = F.when(host == "", F.lit("Unknown")).otherwise(F.regexp_replace(host, r"www\.", ""))  # the first one only, as a host has it once
    id_, day = names.short_id("src_", F.col("key")), F.lit(today)
    source = F.struct(id_.alias("id"), F.concat(F.lit("Source from "), publisher).alias("title"), publisher.alias("publisher"), F.col("n.source").alias("url"), day.alias("accessDate"), F.lit("webpage").alias("type"))
    claim = F.struct(
        names.short_id("clm_", F.col("key")).alias("id"), F.col("n.title").alias("title"), F.left("n.statement", F.lit(STATEMENT)).alias("statement"), F.lit("asserted").alias("status"),
        F.array(F.struct(F.col("entity").alias("slug"), F.lit("subject").alias("role"))).alias("entities"), F.array_compact(F.array("topic")).alias("topics"),
        F.array(F.struct(id_.alias("sourceId"), F.left(F.nullif("n.quote", F.lit("")), F.lit(QUOTE)).alias("quote"))).alias("citations"),
        F.struct(F.lit("ingest").alias("author"), day.alias("createdAt"), day.alias("updatedAt")).alias("provenance"), F.lit(1).alias("version"),
        F.array(F.struct(F.lit(1).alias("version"), day.alias("date"), F.lit("Initial claim created via ingest script").alias("summary"))).alias("changelog"),
    )
    return rows.select("key", source.alias("source"), claim.alias("claim"))


def append(made: DataFrame, folder: str) -> None:
    """Appends the sources and claims of `notes` to their tables."""
    made.select("source.*").write.mode("append").parquet(f"{folder}/sources")
    made.select("claim.*").write.mode("append").parquet(f"{folder}/claims")
