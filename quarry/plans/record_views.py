"""A corpus of records made of the driver's tables, so that the views and record rules run over whole tables.

Orders are claims (their customer and the next one are the entities; lineitems are citations, topics and versions), customers are entities with every fifth as
the parent of the next four, suppliers are sources, parts are topics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import render
from quarry.plans.views import Corpus

C = F.col
STATUS = {"F": "asserted", "O": "disputed", "P": "corrected"}
DAY = "yyyy-MM-dd"


def padded(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 8, "0"))


def named(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def claims(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    line = F.struct(C("l_linenumber").alias("n"), "l_suppkey", "l_partkey", F.date_format("l_shipdate", DAY).alias("date"))
    lines = lineitem.groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    none = F.from_json(F.lit("[]"), "array<struct<n:int,l_suppkey:bigint,l_partkey:bigint,date:string>>")
    rows = orders.join(lines, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", none))
    day, null = F.date_format("o_orderdate", DAY), F.lit(None).cast("string")
    ref = lambda key, role: F.struct(named("c", key).alias("slug"), F.lit(role).alias("role"))
    cited = F.transform("lines", lambda x: F.struct(padded("src_", x["l_suppkey"]).alias("sourceId"), null.alias("locator"), x["date"].alias("quote"), null.alias("note")))
    log = F.transform("lines", lambda x: F.struct(x["n"].alias("version"), x["date"].alias("date"), named("line ", x["n"]).alias("summary")))
    return rows.select(
        padded("clm_", C("o_orderkey")).alias("id"), named("Order ", C("o_orderkey")).alias("title"), C("o_orderpriority").alias("statement"),
        render.choose(C("o_orderstatus"), STATUS, "tombstoned").alias("status"), F.array(ref(C("o_custkey"), "subject"), ref(C("o_custkey") + 1, "related")).alias("entities"),
        F.array_sort(F.array_distinct(F.transform("lines", lambda x: named("p", x["l_partkey"])))).alias("topics"), cited.alias("citations"),
        F.struct(F.lit("orders").alias("author"), day.alias("createdAt"), day.alias("updatedAt")).alias("provenance"),
        F.greatest(F.coalesce(F.array_max(F.transform("lines", lambda x: x["n"])), F.lit(1)), F.lit(1)).alias("version"), log.alias("changelog"),
    )


def entities(customer: DataFrame) -> DataFrame:
    k, null = C("c_custkey"), F.lit(None).cast("string")
    kind = F.when(k % 3 == 0, "organization").when(k % 3 == 1, "person").otherwise("place")
    links = F.struct(F.when(k % 2 == 0, named("https://example.org/c/", k)).alias("officialSite"), *[null.alias(x) for x in ("wikipedia", "linkedin", "twitter", "crunchbase")])
    parent = F.when(k % 5 != 0, named("c", k - k % 5))
    return customer.select(named("c", k).alias("slug"), C("c_name").alias("name"), kind.alias("type"), C("c_mktsegment").alias("description"), links.alias("links"), parent.alias("parentEntity"), F.lit(None).cast("array<string>").alias("subsidiaries"))


def sources(supplier: DataFrame) -> DataFrame:
    k, null = C("s_suppkey"), F.lit(None).cast("string")
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (k % 28).cast("int")), DAY)
    snapshot = F.struct(F.lit("2026-01-01T00:00:00.000Z").alias("timestamp"), named("artifacts/", k).alias("artifactPath"), F.lit("manual").alias("method"), null.alias("jobId"), null.alias("notes"))
    return supplier.select(
        padded("src_", k).alias("id"), C("s_name").alias("title"), named("n", C("s_nationkey")).alias("publisher"), named("https://example.org/s/", k).alias("url"), day.alias("accessDate"),
        F.lit("webpage").alias("type"), null.alias("author"), null.alias("publishedDate"), F.when(k % 2 == 0, named("About ", k)).alias("excerpt"), null.alias("notes"),
        F.when(k % 3 == 0, F.array(snapshot, snapshot)).alias("snapshots"),
    )


def topics(part: DataFrame) -> DataFrame:
    return part.select(named("p", C("p_partkey")).alias("slug"), C("p_name").alias("name"), C("p_brand").alias("description"))


def corpus(t) -> Corpus:
    return Corpus(claims(t.orders, t.lineitem), entities(t.customer), sources(t.supplier), topics(t.part))


#: The same records in DuckDB's SQL, as table expressions.
SQL = """corpus_lines AS (SELECT l_orderkey, l_linenumber AS n, l_suppkey, l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem),
 claim AS (SELECT o_orderkey AS k, 'clm_' || lpad(o_orderkey::VARCHAR, 8, '0') AS id, 'Order ' || o_orderkey AS title, o_orderpriority AS statement, o_custkey AS cust, strftime(o_orderdate, '%Y-%m-%d') AS day,
 CASE o_orderstatus WHEN 'F' THEN 'asserted' WHEN 'O' THEN 'disputed' WHEN 'P' THEN 'corrected' ELSE 'tombstoned' END AS status FROM orders),
 entity AS (SELECT c_custkey AS k, 'c' || c_custkey AS slug, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'organization' WHEN 1 THEN 'person' ELSE 'place' END AS type, c_mktsegment AS description, CASE WHEN c_custkey % 5 <> 0 THEN 'c' || (c_custkey - c_custkey % 5) END AS parent FROM customer),
 source AS (SELECT s_suppkey AS k, 'src_' || lpad(s_suppkey::VARCHAR, 8, '0') AS id, s_name AS title, 'n' || s_nationkey AS publisher, strftime(DATE '2026-01-01' + (s_suppkey % 28)::INT, '%Y-%m-%d') AS accessed, CASE WHEN s_suppkey % 2 = 0 THEN 'About ' || s_suppkey END AS excerpt FROM supplier),
 topic AS (SELECT p_partkey AS k, 'p' || p_partkey AS slug, p_name AS name FROM part),
 ref AS (SELECT id, k, status, day, 'c' || cust AS slug, 0 AS ord FROM claim UNION ALL SELECT id, k, status, day, 'c' || (cust + 1), 1 FROM claim)"""
RANK = "CASE status WHEN 'asserted' THEN 0 WHEN 'disputed' THEN 1 WHEN 'corrected' THEN 2 ELSE 3 END"
