"""Record tables kept as one JSON file per record: schemas, scans by failure mode, and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import exists

#: The declared schemas.
SCHEMAS = {
    "claims": "id STRING, title STRING, statement STRING, status STRING, entities ARRAY<STRUCT<slug:STRING,role:STRING>>, topics ARRAY<STRING>, citations ARRAY<STRUCT<sourceId:STRING,locator:STRING,quote:STRING,note:STRING>>, provenance STRUCT<author:STRING,createdAt:STRING,updatedAt:STRING>, version INT, changelog ARRAY<STRUCT<version:INT,date:STRING,summary:STRING>>",
    "sources": "id STRING, title STRING, publisher STRING, url STRING, accessDate STRING, type STRING, author STRING, publishedDate STRING, excerpt STRING, notes STRING, snapshots ARRAY<STRUCT<timestamp:STRING,artifactPath:STRING,method:STRING,jobId:STRING,notes:STRING>>",
    "entities": "slug STRING, name STRING, type STRING, description STRING, links STRUCT<officialSite:STRING,wikipedia:STRING,linkedin:STRING,twitter:STRING,crunchbase:STRING>, parentEntity STRING, subsidiaries ARRAY<STRING>",
    "topics": "slug STRING, name STRING, description STRING",
}
KEYS = {"claims": "id", "sources": "id", "entities": "slug", "topics": "slug"}
DRAFT = "_draft STRUCT<confidence:STRING,sourcePages:ARRAY<STRING>,notes:STRING,model:STRING,extractedAt:STRING>"


#: Enumerations of the schemas.
STATUSES = ["asserted", "disputed", "corrected", "tombstoned"]
ENTITY_TYPES = ["organization", "person", "product", "project", "event", "place", "concept", "other"]
SOURCE_TYPES = ["webpage", "pdf", "academic-paper", "press-release", "news-article", "government-document", "social-media", "video", "podcast", "book", "report", "other"]
SNAPSHOT_METHODS = ["manual", "oxylabs", "wayback", "other"]


def scan(spark: SparkSession, folder: str, table: str, mode: str = "FAILFAST", draft: bool = False) -> DataFrame:
    """All records of a table below folder; no rows where there is no such folder. Unknown keys are dropped.

    mode FAILFAST raises on a file that doesn't parse, DROPMALFORMED leaves it out.
    """
    schema = SCHEMAS[table] + (f", {DRAFT}" if draft else "")
    path = f"{folder}/{table}"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("multiLine", True).option("mode", mode).option("pathGlobFilter", "*.json").json(path)
    return found.where(F.col(KEYS[table]).isNotNull()) if mode == "DROPMALFORMED" else found


def scan_with_errors(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All files of a table, with `file` and, for one that doesn't parse, its text in `_corrupt_record`."""
    schema = SCHEMAS[table] + ", _corrupt_record STRING"
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{folder}/{table}/*.json")
    return found.withColumn("file", F.col("_metadata.file_name"))


def scan_checked(spark: SparkSession, folder: str, table: str, rules: dict[str, Column]) -> DataFrame:
    """file, errors of every file: `unparsable` alone for one that doesn't parse, else the names of the rules that its record breaks."""
    found = scan_with_errors(spark, folder, table)
    named = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]
    broken = F.when(F.col("_corrupt_record").isNotNull(), F.array(F.lit("unparsable"))).otherwise(F.array_compact(F.array(*named)))
    return found.select("file", broken.alias("errors"))


def load_json(text: Column, schema: str) -> Column:
    """The record of a JSON text; null for a text that is null or doesn't parse as an object."""
    kept = F.from_json(text, f"{schema}, _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.when(kept["_corrupt_record"].isNull() & F.trim(text).startswith("{"), kept.dropFields("_corrupt_record"))


def write_records(df: DataFrame, folder: str, table: str) -> None:
    """One JSON file per record, in a folder named by its key: <folder>/<table>/<key column>=<key>/part-*.json."""
    key = KEYS[table]
    df.select(key, F.to_json(F.struct(*df.columns)).alias("value")).repartition(key).write.partitionBy(key).mode("overwrite").text(f"{folder}/{table}")


def read_records(spark: SparkSession, folder: str, table: str, draft: bool = False) -> DataFrame:
    """What write_records wrote."""
    schema = SCHEMAS[table] + (f", {DRAFT}" if draft else "")
    whole = spark.read.text(f"{folder}/{table}", wholetext=True, recursiveFileLookup=True)
    return whole.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def keys_only(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Keys from file names; no file is parsed."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{folder}/{table}").select("path")
    return names.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json\z", "").alias(KEYS[table]))


def point(df: DataFrame, table: str, key: str) -> DataFrame:
    return df.where(F.col(KEYS[table]) == key).limit(1)


def draft_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Draft entities of all batches (folder/<batch>/entities/*.json): batch, slug (the file's name), the record, and a warning instead of a record for a file that doesn't parse."""
    schema = f"{SCHEMAS['entities']}, {DRAFT}, _corrupt_record STRING"
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{folder}/[!.]*/entities/*.json")
    path, torn = F.split(F.col("_metadata.file_path"), "/"), F.col("_corrupt_record").isNotNull()
    entity = F.struct(*[c for c in found.columns if c != "_corrupt_record"])
    slug = F.regexp_replace(F.element_at(path, -1), r"\.json\z", "")
    return found.select(F.element_at(path, -3).alias("batch"), slug.alias("file_slug"), F.when(~torn, entity).alias("entity"), F.when(torn, F.concat(F.lit("Could not parse "), slug)).alias("warning"))


def draft_batches(spark: SparkSession, folder: str) -> DataFrame:
    """batch: the folders of draft batches, without hidden ones, from the file listing alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if s.isDirectory()] if exists(spark, folder) else []
    return spark.createDataFrame([(n,) for n in sorted(found) if not n.startswith(".")], "batch string")


def save_drafts(df: DataFrame, folder: str) -> None:
    """Draft records (crawl_id, kind, id, record: JSON) as Parquet by batch and kind; a batch that is saved again is replaced."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy("crawl_id", "kind").mode("overwrite").parquet(folder)


def save_batch(tables: dict[str, DataFrame], folder: str, batch: str, manifest: DataFrame) -> None:
    """A draft batch: <folder>/<batch>/<table> for each table, with the number of its records in the manifest (one row).

    All is written beside the batch and moved there by one rename, so a batch is whole or isn't there; a batch that is saved again is replaced.
    """
    spark = manifest.sparkSession
    beside = f"{folder}/.{batch}-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{beside}/{table}")
        manifest = manifest.withColumn(f"n_{table}", F.lit(spark.read.parquet(f"{beside}/{table}").count()))
    manifest.write.parquet(f"{beside}/manifest")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(path(f"{folder}/{batch}"), True)
    if not system.rename(path(beside), path(f"{folder}/{batch}")):
        raise OSError(f"{beside} can't be moved to {folder}/{batch}")


def read_batch(spark: SparkSession, folder: str, batch: str, table: str) -> DataFrame:
    """A table of a draft batch, or its manifest; no rows for a table that the batch doesn't have."""
    if not exists(spark, f"{folder}/{batch}/{table}"):
        return spark.createDataFrame([], f"{SCHEMAS[table]}, {DRAFT}")
    return spark.read.parquet(f"{folder}/{batch}/{table}")


def archive_batch(spark: SparkSession, folder: str, batch: str, at: str) -> str:
    """Moves a batch below .archive, where scans don't look; the new place."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    to = f"{folder}/.archive/{batch}_{at}"
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(f"{folder}/.archive"))
    if not system.rename(path(f"{folder}/{batch}"), path(to)):
        raise OSError(f"{folder}/{batch} can't be moved to {to}")
    return to


def add_snapshot(sources: DataFrame, taken: DataFrame) -> DataFrame:
    """sources with a snapshot appended where taken (id, timestamp, artifactPath, method) has one of them."""
    made = F.struct("timestamp", "artifactPath", "method", F.lit(None).cast("string").alias("jobId"), F.lit(None).cast("string").alias("notes"))
    new = taken.select("id", made.alias("_new"))
    none = F.from_json(F.lit("[]"), "array<struct<timestamp:string,artifactPath:string,method:string,jobId:string,notes:string>>")
    both = F.when(F.col("_new").isNull(), F.col("snapshots")).otherwise(F.array_append(F.coalesce("snapshots", none), F.col("_new")))
    return sources.join(new, "id", "left").withColumn("snapshots", both).drop("_new")


def page_texts(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """pages (urlHash, text, ...) with the text of `texts` (urlHash, body) where their own is blank."""
    joined = pages.join(texts.select("urlHash", "body"), "urlHash", "left")
    return joined.withColumn("text", F.when(F.trim("text") != "", F.col("text")).otherwise(F.coalesce("body", "text"))).drop("body")


def load_crawl(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a saved crawl that its manifest lists, with the separate text where their own is blank."""
    listed = spark.read.parquet(f"{folder}/manifest").select(F.explode("pages").alias("p")).select(F.col("p.urlHash").alias("urlHash")).distinct()
    pages = spark.read.parquet(f"{folder}/pages")
    texts = pages.select("urlHash", F.col("cleanText").alias("body"))
    return page_texts(pages.drop("cleanText").join(listed, "urlHash", "left_semi"), texts)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    out = df.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def approve(old: DataFrame, drafts: DataFrame, key: str) -> DataFrame:
    """Drafts without their draft fields over the records they replace."""
    new = drafts.drop("_draft")
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)
