"""WARC archives, written and read by Spark's text files.

Writing: a record is one string, header and block; records are the lines of a text file whose line separator is the blank line that ends a record. Equal payloads are found by their
digests, so only rows whose digest occurs twice are shuffled; one of them is a response, the others are revisits without a payload.

Reading (boundary-chain verification): a file is cut at every end of a record that is followed by a version line, also at those that stand inside a payload, so Spark may split files anywhere. Each piece is a
candidate record, and its header gives the offset of its successor. Within a split, chains are followed by their offsets: every candidate gets the first offset beyond its split
that its chain leads to. Pointer jumping over these from the start of each file finds the true entry of every split; what the chains from the true entries reach are
records, and all other candidates belong to the payload of the record before them, which is put together from its pieces. A chain that
doesn't end with its file is an error, not a loss.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import KeyFilter, Scratch, quoted

VERSION, END, LINE = "WARC/1.1\r\n", "\r\n\r\n", "\r\n"
#: What is between two records' own bytes.
CUT = END + VERSION
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header_safe(value: Column) -> Column:
    """A header's value: control characters and spaces by percent, so that no line ends in it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")


def _first_of_each(scratch: Scratch, rows: DataFrame, least_bytes: int) -> DataFrame:
    """rows (id, url, payload) with `first`: for a revisit the id of the response, else null; and `revisit`."""
    key = F.when(F.octet_length("payload") >= least_bytes, F.unhex(F.sha2(F.col("payload").cast("binary"), 256)))
    keyed = rows.withColumn("key", key)
    groups = keyed.where("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("key", "first")
    groups = scratch.write(groups, "groups")
    maybe, rest = KeyFilter(groups, "key", groups.count()).split(keyed, "key")
    maybe = maybe.join(groups.withColumn("grouped", F.lit(True)), "key", "left").withColumn("top", F.col("grouped") & F.col("id").eqNullSafe(F.col("first")))
    # where the largest id is repeated with its payload, such rows are written with a number, and the first of them is the response
    tops = maybe.where("top").groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("tied"))
    tops = scratch.write(tops, "tops")
    revisit = F.coalesce(F.col("grouped") & ~F.col("top"), F.lit(False))
    out = lambda df, test: df.select("id", "url", "payload", F.when(test, F.col("first")).alias("first"), test.alias("revisit"))
    plain = rest.withColumn("first", F.lit(None).cast("long"))
    if tops.isEmpty():
        return out(plain, F.lit(False)).unionByName(out(maybe, revisit))
    both = maybe.join(tops, "key", "left")
    tied = scratch.write(both.where("top AND tied").withColumn("row", F.monotonically_increasing_id()), "tied")
    least = tied.groupBy("key").agg(F.min("row").alias("least"))
    decided = out(tied.join(least, "key"), F.col("row") != F.col("least"))
    return out(plain, F.lit(False)).unionByName(out(both.where("NOT coalesce(top AND tied, false)"), revisit)).unionByName(decided)


def warc_records(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """record: one WARC record for each row, without the blank line that ends it.

    Of equal payloads of at least `least_bytes` bytes, the one with the largest id is the response (of equal ids one, a null id is the smallest) and the others are revisits of it.
    A null payload is empty, a null url is left out; repeated rows give a record each; an empty table gives no records; other columns are not looked at.
    """
    rows = pages.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(url_col)).cast("string").alias("url"), F.coalesce(F.col(quoted(payload_col)), F.lit("")).alias("payload"))
    rows = _first_of_each(Scratch(pages.sparkSession, "warc-write"), rows, least_bytes)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    rows = rows.withColumn("http", http).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    length = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.octet_length("payload"))
    head = [
        F.lit(VERSION + "WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(LINE + "WARC-Record-ID: "), urn("id"), F.lit(f"{LINE}WARC-Date: {date}"),
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit(LINE + "WARC-Target-URI: "), _header_safe(F.col("url")))),
        F.lit(LINE + "WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(F.col("revisit"), F.concat(F.lit(f"{LINE}WARC-Profile: {PROFILE}{LINE}WARC-Refers-To: "), urn("first"))).otherwise(""),
        F.lit(LINE + "Content-Type: application/http;msgtype=response" + LINE + "Content-Length: "), length.cast("string"), F.lit(END),
    ]
    return rows.select(F.concat(*head, "http", F.when(F.col("revisit"), "").otherwise(F.col("payload"))).alias("record"))


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Writes records (one string each) as archives below path, a file for each partition."""
    records.write.option("lineSep", END).option("compression", compression).text(path)


def _field(head: Column, name: str) -> Column:
    """The first field of a name in a header; null if there is none."""
    found = F.regexp_extract(head, rf"(?i)(?:^|\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found == "", None).otherwise(found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two cuts, in order of `at`: value, file, split. The numbers are the same in every read, as the splits and their rows are."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", CUT).text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"))


def _declared(value: Column) -> Column:
    """Bytes of a piece up to the end of the block that its header declares; null if it has no such header."""
    head = F.substring_index(value, END, 1)
    length = F.regexp_extract(head, r"(?i)\nContent-Length:[ \t]*(\d{1,18})[ \t]*(?:\r|\z)", 1)
    return F.when((F.instr(value, END) > 0) & (length != ""), F.octet_length(head).cast("long") + len(END) + length.cast("long"))


def _leads_to(group: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one split: start, and the first start beyond the split that the chain from there leads to (-1: it leads nowhere)."""
    group = group.sort_values("at")
    size = group["size"].to_numpy() + len(CUT)
    start = group["base"].to_numpy() + np.cumsum(size) - size
    after = np.where(group["declared"].isna(), -1, start + group["declared"].fillna(0).to_numpy().astype(np.int64) + len(CUT))
    known = dict(zip(start.tolist(), range(len(start)), strict=True))
    leads = after.tolist()
    for k in range(len(leads) - 1, -1, -1):
        if 0 <= leads[k] <= start[-1]:
            leads[k] = leads[known[leads[k]]] if known.get(leads[k], -1) > k else -1
    return pd.DataFrame({"file": group["file"].iloc[0], "split": group["split"].iloc[0], "at": group["at"].to_numpy(), "start": start, "after": after, "leads": leads})


def _owned(group: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one split with the piece that their record begins with; null before the split's first record."""
    group = group.sort_values("start")
    start, after, entry = group["start"].tolist(), group["after"].tolist(), group["entry"].iloc[0]
    at, owner, own, want = group["at"].tolist(), [], None, -1 if pd.isna(entry) else int(entry)
    for k, s in enumerate(start):
        if s == want:
            own, want = at[k], after[k]
        owner.append(own)
    return pd.DataFrame({"file": group["file"].iloc[0], "split": group["split"].iloc[0], "at": at, "start": start, "owner": pd.array(owner, "Int64")})


def _entries(scratch: Scratch, leads: DataFrame, ends: DataFrame) -> DataFrame:
    """file, start: the first true record of each split that has one. Each round of pointer jumping doubles the number of splits that are reached."""
    targets = leads.where("leads >= 0").select("file", F.col("leads").alias("start")).distinct()
    zero = leads.where("start = 0").select("file", "start")
    nodes = leads.join(targets.unionByName(zero).distinct(), ["file", "start"], "left_semi")
    jumps = scratch.write(nodes.select("file", "start", F.col("leads").alias("to")), "jumps0")
    reached, step = scratch.write(zero, "reached0"), 0
    while True:
        step += 1
        found = reached.join(jumps, ["file", "start"]).where("`to` >= 0").select("file", F.col("to").alias("start")).join(reached, ["file", "start"], "left_anti")
        found = scratch.write(found.distinct(), f"found{step}")
        if found.isEmpty():
            break
        reached = scratch.write(reached.unionByName(found), f"reached{step}")
        on = jumps.select("file", F.col("start").alias("to"), F.col("to").alias("further"))
        jumps = scratch.write(jumps.join(on, ["file", "to"], "left").select("file", "start", F.coalesce("further", "to").alias("to")), f"jumps{step}")
    whole = ends.join(reached, (ends["file"] == reached["file"]) & (ends["end"] == reached["start"]), "left_anti").select("file")
    if broken := whole.first():
        raise ValueError(f"{broken['file']}: the chain of records doesn't end with the file")
    return reached


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, type, uri, date, refers_to, digest, http, payload: the records of all archives below path.

    payload is what follows the HTTP header of an application/http block, else the block. Fields that a record doesn't have are null. Empty files have no records. A file
    that isn't a chain of records from its first byte to its last raises. Gzipped files are read too, each as one split.
    """
    scratch, pieces = Scratch(spark, "warc-read"), _pieces(spark, path)
    cut = pieces.select("file", "split", "at", F.octet_length("value").cast("long").alias("size"), _declared(F.col("value")).alias("declared"))
    index = scratch.write(cut, "index")
    sums = index.groupBy("file", "split").agg(F.sum(F.col("size") + len(CUT)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split")  # a row for each split of a file
    bases = scratch.write(sums.withColumn("base", F.sum("bytes").over(before) - F.col("bytes")), "bases")
    keys = ["file", "split"]
    leads = index.join(bases.select(*keys, "base"), keys).groupBy(*keys).applyInPandas(_leads_to, "file string, split long, at long, start long, after long, leads long")
    leads = scratch.write(leads, "leads")
    # the last piece has the blank line that every other one lost with its cut
    ends = bases.groupBy("file").agg((F.sum("bytes") - len(END)).alias("end"))
    reached = _entries(scratch, leads, ends)
    entries = leads.join(reached, ["file", "start"]).select(*keys, F.col("start").alias("entry"))
    owned = leads.select(*keys, "at", "start", "after").join(entries, keys, "left").groupBy(*keys).applyInPandas(_owned, "file string, split long, at long, start long, owner long")
    owned = scratch.write(owned, "owned")
    lasts = owned.groupBy(*keys).agg(F.max("owner").alias("last"))
    lasts = lasts.withColumn("carried", F.last("last", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    full = owned.where("owner IS NULL").join(lasts.select(*keys, "carried"), keys).select("at", "start", F.col("carried").alias("owner"))
    inner = owned.where("owner <> at").select("at", "start", "owner").unionByName(full)
    inner = scratch.write(inner, "inner")
    heads = owned.select("at", "start", "owner").join(inner.select(F.col("owner").alias("at")).distinct(), "at", "left_semi")
    parts = scratch.write(inner.unionByName(heads), "parts")
    values = pieces.select("at", "value")
    maybe, rest = KeyFilter(parts, "at", parts.count()).split(values, "at")
    maybe = maybe.join(parts, "at", "left")
    joined = maybe.where("owner IS NOT NULL").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))  # one record's
    joined = joined.select(F.array_join(F.transform("parts", lambda x: x["value"]), CUT).alias("value"))
    return _parsed(rest.select("value").unionByName(maybe.where("owner IS NULL").select("value")).unionByName(joined))


def _parsed(records: DataFrame) -> DataFrame:
    head = F.substring_index("value", END, 1)
    rows = records.select("value", head.alias("head"), _declared(F.col("value")).alias("declared"))
    start = F.octet_length("head") + len(END)
    rows = rows.select("head", F.substring(F.col("value").cast("binary"), start + 1, (F.col("declared") - start).cast("int")).alias("block"))
    http = F.when(_field(F.col("head"), "Content-Type").rlike("(?i)^application/http"), F.substring_index(F.col("block").cast("string"), END, 1))
    rows = rows.withColumn("http", http)
    rest = F.octet_length("http") + len(END)
    payload = F.when(F.col("http").isNull(), F.col("block")).otherwise(F.substring("block", rest + 1, F.octet_length("block") - F.least(rest, F.octet_length("block"))))
    named = {"record_id": "WARC-Record-ID", "type": "WARC-Type", "uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "digest": "WARC-Payload-Digest"}
    return rows.select(*[_field(F.col("head"), name).alias(c) for c, name in named.items()], "http", payload.alias("payload"))


def op13_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'warc').path}/archives"
    write_warc(warc_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    ident = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(ident(c) != "", ident(c).cast("long"))
    revisit = F.col("type") == "revisit"
    return read_warc(spark, path).select(
        number("record_id").alias("page_id"),
        F.when(revisit, _field(F.col("http"), "Content-Length").cast("long")).otherwise(F.octet_length("payload")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("digest", ":", -1)).otherwise(F.sha1("payload")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM m
"""
