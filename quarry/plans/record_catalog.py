"""Queries over records made of the driver's tables: scans, sinks, views, drafts, crawls, monitoring and publishing, each with DuckDB SQL where it can say the same.

Importing this adds them to the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import quarry
from quarry.functions import names, noise, render, text, urls
from quarry.operators import corpus, crawl, drafts, extraction, ingest, mentions, monitor
from quarry.plans import example_config, views
from quarry.plans import record_views as made
from quarry.plans.catalog import _CHECKS, _DAILY, _DRAFT, _HOST, _MOVES, _PATH, _RANK, _VISITS, S, Tables, _checks, _daily, _drafts, _quoted, _visits, norm_sql, query
from quarry.sources import connectors, documents, records
from quarry.sources.shared import new_folder, written
from quarry.sources.store import RecordStore
from quarry.streaming import visits

C = F.col
KEY = 7  # the record that a detail view shows


def record_query(sql: str):
    """A query whose SQL may use the records of record_views.SQL."""
    head = "WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "
    return query(f"{head}{made.SQL}{',' + sql[len('WITH'):] if sql.startswith('WITH') else ' ' + sql}")


# --- views -----------------------------------------------------------------------------------------------------------


@record_query("SELECT 'claims' AS kind, count(*) AS n FROM claim UNION ALL SELECT 'entities', count(*) FROM entity UNION ALL SELECT 'sources', count(*) FROM source UNION ALL SELECT 'topics', count(*) FROM topic")
def view_counts(t: Tables) -> DataFrame:
    return views.counts(made.corpus(t))


@record_query("SELECT c.id, c.title, c.status, c.day AS updatedAt, string_agg(coalesce(e.name, r.slug), ',' ORDER BY r.ord) AS entities FROM claim c JOIN ref r USING (id) LEFT JOIN entity e ON e.slug = r.slug GROUP BY ALL")
def view_claims_index(t: Tables) -> DataFrame:
    return views.claims_index(made.corpus(t)).withColumn("entities", F.array_join("entities", ","))


_WORKS = """coalesce((SELECT string_agg('{"@type":"CreativeWork","@id":"BASE/sources/' || s.id || '","name":"' || s.title || '","url":"https://example.org/s/' || s.k || '","publisher":{"@type":"Organization","name":"' || s.publisher || '"}}', ',' ORDER BY s.id)
 FROM source s WHERE s.k IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey = c.k)), '')""".replace("BASE", render.BASE)


@record_query(f"""SELECT c.id, c.title, coalesce((SELECT string_agg(s.title, ',' ORDER BY l.n, l.l_suppkey, l.l_partkey, l.date) FROM corpus_lines l JOIN source s ON s.k = l.l_suppkey WHERE l.l_orderkey = c.k), '') AS sources,
 coalesce((SELECT string_agg(name, ',' ORDER BY slug) FROM topic WHERE k IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = c.k)), '') AS topic_names,
 '{{"@context":"https://schema.org","@type":"Claim","@id":"{render.BASE}/claims/' || c.id || '","name":"' || c.title || '","description":"' || c.statement || '","dateCreated":"' || c.day || '","dateModified":"' || c.day || '","author":{{"@type":"Organization","name":"orders"}},"claimReviewed":"' || c.statement || '","appearance":[' || {_WORKS} || '],"reviewRating":{{"@type":"Rating","ratingValue":' || CASE c.status WHEN 'asserted' THEN 5 WHEN 'disputed' THEN 3 WHEN 'corrected' THEN 2 ELSE 1 END || ',"bestRating":5,"worstRating":1,"ratingExplanation":"Claim status: ' || c.status || '"}}}}' AS json_ld
 FROM claim c WHERE c.k = {KEY}""")
def view_claim_page(t: Tables) -> DataFrame:
    page = views.claim_page(made.corpus(t), f"clm_{KEY:08d}")
    shown = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return page.select("id", "title", shown("sources").alias("sources"), shown("topic_names").alias("topic_names"), "json_ld")


@record_query("SELECT slug, name, count(DISTINCT id) AS n_claims FROM entity LEFT JOIN ref USING (slug) GROUP BY ALL")
def view_entities_index(t: Tables) -> DataFrame:
    return views.entities_index(made.corpus(t))


@record_query(f"SELECT id, status, row_number() OVER (ORDER BY {made.RANK}, day DESC, id)::INT AS place FROM claim WHERE cust IN ({KEY}, {KEY - 1})")
def view_entity_claims(t: Tables) -> DataFrame:
    """P2 in its array form: the claims that refer to an entity in any role."""
    rows = views.entity_detail(made.corpus(t), f"c{KEY}")
    order = Window.partitionBy(F.lit(0)).orderBy(corpus.status_rank(C("status"), views.STATUS), F.desc("provenance.updatedAt"), "id")  # one entity's page
    return rows.select("id", "status", F.row_number().over(order).alias("place"))


_TYPE = "CASE type WHEN 'organization' THEN 'Organization' WHEN 'person' THEN 'Person' ELSE 'Place' END"


@record_query(f"""SELECT e.slug, e.name, (SELECT count(DISTINCT id) FROM ref WHERE slug = e.slug) AS n_claims, p.name AS parent_name, coalesce((SELECT string_agg(name, ',' ORDER BY slug) FROM entity WHERE parent = e.slug), '') AS subsidiaries,
 '{{"@context":"https://schema.org","@type":"' || {_TYPE.replace('type', 'e.type')} || '","@id":"{render.BASE}/entities/' || e.slug || '","name":"' || e.name || '","description":"' || e.description || '"' || CASE WHEN e.k % 2 = 0 THEN ',"url":"https://example.org/c/' || e.k || '"' ELSE '' END || ',"sameAs":[]' ||
 coalesce((SELECT ',"subOrganization":[' || string_agg('{{"@type":"' || {_TYPE} || '","@id":"{render.BASE}/entities/' || slug || '","name":"' || name || '"}}', ',' ORDER BY slug) || ']' FROM entity WHERE parent = e.slug), '') || '}}' AS json_ld
 FROM entity e LEFT JOIN entity p ON e.parent = p.slug WHERE e.k = 10""")
def view_entity_page(t: Tables) -> DataFrame:
    return views.entity_page(made.corpus(t), "c10").withColumn("subsidiaries", F.array_join("subsidiaries", ","))


@record_query("SELECT e.slug, p.name AS parent_name, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM entity WHERE parent = e.slug), '') AS subsidiaries FROM entity e LEFT JOIN entity p ON e.parent = p.slug")
def view_entity_family(t: Tables) -> DataFrame:
    return views.entity_family(made.corpus(t)).withColumn("subsidiaries", F.array_join("subsidiaries", ","))


_OWN = f"(SELECT * FROM claim WHERE cust IN ({KEY}, {KEY - 1}))"


@record_query(f"""SELECT (SELECT count(*) FROM {_OWN}) AS claims, (SELECT count(*) FROM {_OWN} WHERE status = 'asserted') AS asserted, (SELECT count(*) FROM {_OWN} c JOIN corpus_lines l ON l.l_orderkey = c.k WHERE l.n > 1) AS corrections,
 (SELECT count(DISTINCT l_partkey) FROM {_OWN} c JOIN corpus_lines l ON l.l_orderkey = c.k JOIN topic ON topic.k = l_partkey) AS topics, (SELECT count(DISTINCT l_suppkey) FROM {_OWN} c JOIN corpus_lines l ON l.l_orderkey = c.k JOIN source ON source.k = l_suppkey) AS sources""")
def view_client_dashboard(t: Tables) -> DataFrame:
    return views.client_dashboard(made.corpus(t), f"c{KEY}")


@record_query(f"""SELECT c.id, c.title, c.status, CASE WHEN count(l.n) > 1 THEN string_agg('v' || l.n || ' ' || l.date, ',' ORDER BY l.n, l.l_suppkey, l.l_partkey, l.date) END AS history FROM {_OWN} c LEFT JOIN corpus_lines l ON l.l_orderkey = c.k
 GROUP BY ALL HAVING c.status <> 'asserted' OR count(l.n) > 1""")
def view_client_claims(t: Tables) -> DataFrame:
    return views.client_claims(made.corpus(t), f"c{KEY}").withColumn("history", F.array_join("history", ","))


@record_query("SELECT slug, name, count(DISTINCT l_orderkey) AS n_claims FROM topic LEFT JOIN (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT k FROM claim)) ON l_partkey = k GROUP BY ALL")
def view_topics_index(t: Tables) -> DataFrame:
    return views.topics_index(made.corpus(t))


@record_query(f"SELECT slug, name, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_partkey = {KEY} AND l_orderkey IN (SELECT k FROM claim)) AS n_claims, '{{\"@context\":\"https://schema.org\",\"@type\":\"DefinedTerm\",\"@id\":\"{render.BASE}/topics/' || slug || '\",\"name\":\"' || name || '\",\"description\":\"' || p_brand || '\"}}' AS json_ld FROM topic JOIN part ON p_partkey = k WHERE k = {KEY}")
def view_topic_page(t: Tables) -> DataFrame:
    return views.topic_page(made.corpus(t), f"p{KEY}")


@record_query(f"SELECT id, status FROM claim WHERE k IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = {KEY})")
def view_topic_claims(t: Tables) -> DataFrame:
    return views.topic_detail(made.corpus(t), f"p{KEY}").select("id", "status")


@record_query("SELECT id, accessed AS accessDate, row_number() OVER (ORDER BY accessed DESC, id)::INT AS place FROM source")
def view_sources_index(t: Tables) -> DataFrame:
    rows = views.sources_index(made.corpus(t)).select("id", "accessDate")
    return corpus.numbered(rows, [F.desc("accessDate"), "id"], "place").withColumn("place", C("place").cast("int"))


@record_query(f"""SELECT id, title, coalesce(excerpt, 'Source from ' || publisher) AS description, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM claim WHERE claim.k IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = {KEY})), '') AS claims,
 '{{"@context":"https://schema.org","@type":"WebPage","@id":"{render.BASE}/sources/' || id || '","name":"' || title || '","url":"https://example.org/s/' || k || '","dateAccessed":"' || accessed || '","publisher":{{"@type":"Organization","name":"' || publisher || '"}}' || coalesce(',"description":"' || excerpt || '"', '') || '}}' AS json_ld FROM source WHERE k = {KEY}""")
def view_source_page(t: Tables) -> DataFrame:
    """P4 in its array form: the claims that cite a source in any place."""
    return views.source_page(made.corpus(t), f"src_{KEY:08d}").select("id", "title", "description", F.array_join("claims", ",").alias("claims"), "json_ld")


@record_query("SELECT id, place::INT AS place, 'artifacts/' || k AS artifactPath, 'manual' AS method FROM source CROSS JOIN (VALUES (0), (1)) v(place) WHERE k % 3 = 0")
def view_source_snapshots(t: Tables) -> DataFrame:
    return views.source_snapshots(made.corpus(t)).drop("timestamp")


@record_query("SELECT c.id, l.n AS version, l.date FROM claim c JOIN corpus_lines l ON l.l_orderkey = c.k WHERE l.n > 1")
def view_corrections_log(t: Tables) -> DataFrame:
    return views.corrections_log(made.corpus(t)).select("id", "version", "date")


_NAMES = "CASE platform " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in monitor.NAMES.items()) + " ELSE platform END"
_AS_OF = "2024-02-01 00:00:00"
_SAID = f"CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN (m // 60) || 'h ago' WHEN m // 1440 < 7 THEN (m // 1440) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END"
_LAST_DAY = f"(SELECT * FROM ({_CHECKS}) WHERE day = (SELECT max(day) FROM ({_CHECKS})))"


@query(f"""WITH v AS (SELECT * FROM ({_VISITS}) WHERE crawler IS NOT NULL), d AS ({_DAILY}), r AS {_LAST_DAY}, w AS (SELECT * FROM d ORDER BY day DESC LIMIT 30)
 SELECT 'crawler' AS section, crawler AS item, count(*)::VARCHAR AS shown FROM v GROUP BY crawler UNION ALL SELECT 'visits', 'total', count(*)::VARCHAR FROM v
 UNION ALL SELECT 'recent', crawler || '#' || event_id, {_SAID} FROM (SELECT *, (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(ts)) // 60000000 AS m FROM v ORDER BY ts DESC, event_id DESC LIMIT 50)
 UNION ALL SELECT 'first citation', day, replace(cited_entities, ',', ', ') FROM (SELECT * FROM d WHERE citations > 0 ORDER BY day LIMIT 1)
 UNION ALL SELECT 'day', day, citations || '/' || total_checks FROM w UNION ALL SELECT 'days', 'total', sum(citations)::BIGINT || '/' || sum(total_checks)::BIGINT FROM w
 UNION ALL SELECT 'platform', {_NAMES}, count(*) FILTER (cited) || '/' || count(*) FROM r GROUP BY platform
 UNION ALL SELECT 'result', entity || '@' || {_NAMES}, CASE WHEN cited THEN 'Yes' ELSE 'No' END || ' answer ' || event_id FROM r""")
def view_stats(t: Tables) -> DataFrame:
    crawlers = t.spark.createDataFrame([(r[1], k) for k, r in enumerate(mentions.CRAWLERS)], "name string, ordinal int")
    rows = _checks(t).withColumn("answerExcerpt", F.concat(F.lit("answer "), C("event_id").cast("string")))
    last = rows.join(F.broadcast(rows.agg(F.max("day").alias("day"))), "day")  # one day
    return views.stats(_visits(t), crawlers, last, _daily(t), F.lit(_AS_OF).cast("timestamp"))


@record_query("SELECT id, 'bad' AS kind, string_agg(DISTINCT 'Unknown entity: ' || slug, ';' ORDER BY 'Unknown entity: ' || slug) AS errors FROM ref WHERE slug NOT IN (SELECT slug FROM entity) GROUP BY id")
def view_cross_references(t: Tables) -> DataFrame:
    return views.cross_reference_errors(made.corpus(t)).select("id", F.lit("bad").alias("kind"), F.array_join("errors", ";").alias("errors"))


# --- scans and sinks of record files ---------------------------------------------------------------------------------

_NATION = "SELECT 'nation-' || n_nationkey AS slug, n_name AS name, 'region ' || n_regionkey AS description, n_nationkey % 4 = 3 AS torn FROM nation"


def _nation_files(t: Tables, torn: bool = True, place: str = "topics", batches: int = 0) -> str:
    """Nations as topic files, every fourth of them torn; with batches, dealt out to folders batch-k."""
    folder, key = new_folder(t.spark, "records"), C("n_nationkey")
    whole = F.to_json(F.struct(made.named("nation-", key).alias("slug"), C("n_name").alias("name"), F.lit("x").alias("unheard"), made.named("region ", C("n_regionkey")).alias("description")))
    cut = F.when((key % 4 == 3) & F.lit(torn), F.left(whole, F.lit(20))).otherwise(whole)
    rows = t.nation.select(made.named("nation-", key).alias("slug"), cut.alias("value"), (key % max(batches, 1)).alias("batch"))
    path = t.spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(t.spark._jsc.hadoopConfiguration())
    for r in rows.collect():  # 25 files
        out = system.create(path(f"{folder}/{f'batch-{r['batch']}/' if batches else ''}{place}/{r['slug']}.json"))
        out.write(bytearray(r["value"].encode()))
        out.close()
    return folder


@query(f"SELECT slug, name, description FROM ({_NATION})")
def scan_failing_fast(t: Tables) -> DataFrame:
    """All files of a folder without torn ones; a folder that isn't there has no rows."""
    folder = _nation_files(t, torn=False)
    return records.scan(t.spark, folder, "topics").unionByName(records.scan(t.spark, new_folder(t.spark, "none"), "topics"))


@query(f"SELECT 'batch-' || (n_nationkey % 3) AS batch, slug AS file_slug, CASE WHEN NOT torn THEN name END AS name, CASE WHEN torn THEN 'Could not parse ' || slug END AS warning FROM ({_NATION}) JOIN nation ON slug = 'nation-' || n_nationkey")
def draft_inventory(t: Tables) -> DataFrame:
    found = records.draft_inventory(t.spark, _nation_files(t, place="entities", batches=3))
    return found.select("batch", "file_slug", C("entity.name").alias("name"), "warning")


@query(f"SELECT slug, name, description FROM ({_NATION}) WHERE NOT torn")
def scan_dropping(t: Tables) -> DataFrame:
    return records.scan(t.spark, _nation_files(t), "topics", "DROPMALFORMED")


@query(f"SELECT slug || '.json' AS file, CASE WHEN NOT torn THEN name END AS name, torn AS corrupt FROM ({_NATION})")
def scan_with_errors(t: Tables) -> DataFrame:
    return records.scan_with_errors(t.spark, _nation_files(t), "topics").select("file", "name", C("_corrupt_record").isNotNull().alias("corrupt"))


@query(f"SELECT slug || '.json' AS file, CASE WHEN torn THEN 'unparsable' WHEN length(name) > 6 THEN 'short' ELSE '' END AS errors FROM ({_NATION})")
def scan_checked(t: Tables) -> DataFrame:
    rules = drafts.topic_rules() | {"short": F.length("name") <= 6}
    return records.scan_checked(t.spark, _nation_files(t), "topics", rules).select("file", F.array_join("errors", ",").alias("errors"))


@query(f"SELECT slug FROM ({_NATION})")
def scan_keys(t: Tables) -> DataFrame:
    return records.keys_only(t.spark, _nation_files(t), "topics")


@query(f"SELECT slug, name FROM ({_NATION}) WHERE slug = 'nation-8'")
def scan_point(t: Tables) -> DataFrame:
    return records.point(records.scan(t.spark, _nation_files(t), "topics", "DROPMALFORMED"), "topics", "nation-8").select("slug", "name")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS name FROM orders")
def load_json_or_null(t: Tables) -> DataFrame:
    whole = F.to_json(F.struct(C("o_orderpriority").alias("name"), F.lit("s").alias("slug")))
    return t.orders.select("o_orderkey", records.load_json(F.when(C("o_orderkey") % 3 == 0, F.left(whole, F.lit(9))).otherwise(whole), records.SCHEMAS["topics"])["name"].alias("name"))


@record_query("SELECT slug, name, type, parent AS parentEntity FROM entity")
def records_round_trip(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "records")
    records.write_parquet(made.entities(t.customer), f"{folder}/entities")
    return t.spark.read.parquet(f"{folder}/entities").select("slug", "name", "type", "parentEntity")


@query("SELECT 'nation-' || n_nationkey AS slug, n_name AS name FROM nation")
def record_files_round_trip(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "records")
    rows = t.nation.select(made.named("nation-", C("n_nationkey")).alias("slug"), C("n_name").alias("name"), F.lit("d").alias("description"))
    records.write_records(rows, folder, "topics")
    return records.read_records(t.spark, folder, "topics").select("slug", "name")


def _draft_folder(t: Tables) -> str:
    folder = new_folder(t.spark, "drafts")
    rows = _drafts(t).select(F.concat(C("batch"), F.lit(".com")).alias("crawl_id"), F.when(C("doc_id") % 2 == 0, "entities").otherwise("claims").alias("kind"), C("slug").alias("id"), F.to_json(F.struct("slug", "name")).alias("record"))
    records.save_drafts(rows, folder)
    return folder


@query(f"SELECT DISTINCT batch || '.com' AS batch, 'crawl_id' AS column_name FROM ({_DRAFT})")
def draft_batches(t: Tables) -> DataFrame:
    """A batch that is archived or hidden isn't found."""
    folder = _draft_folder(t)
    records.save_drafts(t.spark.createDataFrame([("gone.com", "claims", "x", "{}")], "crawl_id string, kind string, id string, record string"), folder)
    records.archive_batch(t.spark, folder, "crawl_id=gone.com", "1")
    found = F.split("batch", "=")
    return records.draft_batches(t.spark, folder).select(found[1].alias("batch"), found[0].alias("column_name"))


@query(f"SELECT batch || '.com' AS crawl_id, CASE WHEN doc_id % 2 = 0 THEN 'entities' ELSE 'claims' END AS kind, count(*) AS n, count(DISTINCT slug) AS slugs FROM ({_DRAFT}) GROUP BY ALL")
def draft_sink(t: Tables) -> DataFrame:
    return t.spark.read.parquet(_draft_folder(t)).groupBy("crawl_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("slugs"))


@record_query("SELECT id, CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS n_snapshots, CASE WHEN k % 2 = 0 THEN 'artifacts/new/' || k END AS newest FROM source")
def snapshot_sink(t: Tables) -> DataFrame:
    rows = made.sources(t.supplier)
    taken = t.supplier.where("s_suppkey % 2 = 0").select(made.padded("src_", C("s_suppkey")).alias("id"), F.lit("2026-02-01T00:00:00.000Z").alias("timestamp"), made.named("artifacts/new/", C("s_suppkey")).alias("artifactPath"), F.lit("manual").alias("method"))
    after = records.add_snapshot(rows, taken)
    newest = F.try_element_at("snapshots", F.lit(-1))["artifactPath"]
    return after.select("id", F.coalesce(F.size("snapshots"), F.lit(0)).cast("int").alias("n"), F.when(newest.startswith("artifacts/new"), newest).alias("newest")).select("id", F.greatest("n", F.lit(0)).alias("n_snapshots"), "newest")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'old' ELSE 'new' END AS version FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def approve_drafts(t: Tables) -> DataFrame:
    """Approved drafts lose their draft fields and replace the records of their keys."""
    some = t.labels.where("quality IS NOT NULL").select("doc_id").distinct().join(t.documents.select("doc_id"), "doc_id", "left_semi")
    new = some.withColumn("version", F.lit("new")).withColumn("_draft", F.struct(F.lit("low").alias("confidence")))
    return records.approve(t.documents.select("doc_id").withColumn("version", F.lit("old")), drafts.strip_draft(new), "doc_id")


# --- notes -----------------------------------------------------------------------------------------------------------

_NOTE = "SELECT doc_id, 'c' || (doc_id % 7) AS entity, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'p1' ELSE 'nowhere' END AS topic, doc_id % 5 = 4 AS without FROM documents"


def _made_notes(t: Tables) -> DataFrame:
    d = C("doc_id").cast("string")
    source = F.when(C("doc_id") % 5 == 4, F.lit("")).otherwise(F.concat(F.lit("Source: https://www.example.org/"), d, F.lit("\n")))
    note = F.concat(F.lit("# Note "), d, F.lit("\n"), source, F.lit("quote: '"), F.repeat(F.lit("q"), 400), F.lit("'\nSaid "), d, F.repeat(F.lit("s"), 300))
    rows = t.documents.select(d.alias("key"), note.alias("text"))
    k = C("key").cast("long")
    topic = F.when(k % 3 == 0, "").when(k % 3 == 1, "p1").otherwise("nowhere")
    return ingest.notes(rows, made.named("c", k % 7), topic, made.entities(t.customer.where("c_custkey <> 3")), made.topics(t.part), "2026-01-01")


@query(f"""SELECT doc_id::VARCHAR AS key, 'Source from example.org' AS source_title, 'https://www.example.org/' || doc_id AS url, left('Said ' || doc_id || repeat('s', 300), 240) AS statement, entity, coalesce(nullif(topic, ''), '') AS topics, repeat('q', 300) AS quote
 FROM ({_NOTE}) WHERE NOT without AND topic <> 'nowhere' AND entity <> 'c3'""")
def ingest_notes(t: Tables) -> DataFrame:
    n = _made_notes(t)
    return n.select("key", C("source.title").alias("source_title"), "source.url", "claim.statement", C("claim.entities")[0]["slug"].alias("entity"), F.array_join("claim.topics", ",").alias("topics"), C("claim.citations")[0]["quote"].alias("quote"))


@query(f"SELECT count(*) * 2 AS sources, count(*) * 2 AS claims, count(*) AS ids FROM ({_NOTE}) WHERE NOT without AND topic <> 'nowhere' AND entity <> 'c3'")
def ingest_sink(t: Tables) -> DataFrame:
    """Appending twice keeps both; every claim names a source that is there."""
    folder, n = new_folder(t.spark, "ingest"), _made_notes(t)
    for _ in range(2):
        ingest.append(n, folder)
    sources, claims = t.spark.read.parquet(f"{folder}/sources"), t.spark.read.parquet(f"{folder}/claims")
    known = claims.select(C("citations")[0]["sourceId"].alias("id")).distinct().join(sources.select("id").distinct(), "id", "left_semi")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(sources, "sources").join(count(claims, "claims")).join(count(known, "ids"))  # one row each


@query("SELECT 'note ' || n_name AS title, 'about ' || n_regionkey AS statement FROM nation")
def ingest_files(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "notes")
    t.nation.select(C("n_nationkey").alias("k"), F.concat(F.lit("# note "), "n_name", F.lit("\n\nabout "), "n_regionkey").alias("value")).repartition(C("k")).write.partitionBy("k").text(folder)
    found = ingest.read_notes(t.spark, folder)
    return found.select(mentions.parse_note(C("text")).alias("n")).select("n.title", "n.statement")


# --- crawling --------------------------------------------------------------------------------------------------------

_REC = "CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 19 = 0 THEN 500 ELSE 200 END"


def _recording(t: Tables) -> DataFrame:
    """Pages as recorded responses: the status is made from the id."""
    status = F.when(C("page_id") % 17 == 0, 404).when(C("page_id") % 19 == 0, 500).otherwise(200)
    return t.pages.where("page_id % 23 <> 0").select("page_id", "url", status.alias("status"), C("html").alias("body"))


@query(f"SELECT page_id, CASE WHEN page_id % 23 = 0 THEN 0 ELSE {_REC} END AS status, CASE WHEN page_id % 23 <> 0 AND {_REC} = 200 THEN md5(html) END AS body_md5, CASE WHEN page_id % 23 = 0 THEN 'not recorded' WHEN {_REC} >= 400 THEN 'HTTP ' || {_REC} END AS error FROM pages")
def page_fetch(t: Tables) -> DataFrame:
    ask = t.pages.select("page_id", F.concat("url", F.lit("#"), "page_id").alias("url"))
    rec = _recording(t).select(F.concat("url", F.lit("#"), "page_id").alias("url"), "status", "body")
    return connectors.fetch(ask, rec).select("page_id", "status", F.md5("body").alias("body_md5"), "error")


@query(f"SELECT page_id, CASE WHEN page_id % 23 <> 0 AND {_REC} = 200 THEN md5(html) END AS body_md5, CASE WHEN page_id % 23 = 0 THEN 'not recorded' WHEN {_REC} >= 400 THEN 'HTTP ' || {_REC} END AS error FROM pages")
def rendered_fetch(t: Tables) -> DataFrame:
    own = F.concat("url", F.lit("#"), "page_id")
    response = F.to_json(F.struct(F.array(F.struct(C("body").alias("content"))).alias("results")))
    rec = _recording(t).select(connectors.rendered_request(own).alias("payload"), "status", response.alias("response"))
    return connectors.rendered_fetch(t.pages.select("page_id", own.alias("url")), rec).select("page_id", F.md5("body").alias("body_md5"), "error")


@query("SELECT id, CASE id % 5 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN 408 ELSE 0 END AS status FROM (SELECT event_id AS id FROM events)")
def error_status(t: Tables) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ["HTTP 404", "Forbidden (403)", "got 500", "timeout of 30 s", "socket hang up"])), (C("event_id") % 5 + 1).cast("int"))
    return t.events.select(C("event_id").alias("id"), crawl.error_status(said).alias("status"))


_ROBOTS = {0: "User-agent: *\nDisallow: /en/\nAllow: /en/6", 1: "User-agent: a\nDisallow:\nUser-agent: quarry\nDisallow: /*.html$\n\nUser-agent: *\nDisallow: /"}
_HOST_KIND = f"length({_HOST}) % 3"


@query(f"""SELECT page_id, CASE {_HOST_KIND} WHEN 0 THEN CASE WHEN starts_with(subject, '/en/6') THEN true ELSE NOT starts_with(subject, '/en/') END WHEN 1 THEN NOT regexp_matches(subject, '^/.*\\.html\\z') ELSE true END AS allowed
 FROM (SELECT page_id, url, ({_PATH}) || regexp_extract(url, '{S}', 4) AS subject FROM pages)""")
def robots_by_host(t: Tables) -> DataFrame:
    """Each host's robots.txt is fetched, and its rules are rows that join the host's pages; a third of the hosts have none."""
    quarry.ship(t.spark)
    site = F.concat(urls.part(C("url"), 1), F.lit("://"), urls.part(C("url"), 2), F.lit("/robots.txt"))
    kind = F.length(urls.host(C("url"))) % 3
    rec = t.pages.select(site.alias("url"), kind.alias("k")).distinct().select("url", F.when(C("k") == 2, 404).otherwise(200).alias("status"), F.when(C("k") == 0, _ROBOTS[0]).otherwise(_ROBOTS[1]).alias("body"))
    pages = t.pages.withColumn("host", urls.host(C("url")))
    return urls.robots_verdicts(pages, connectors.robots_fetch(t.pages.select("url"), rec), "quarry/1.0").select("page_id", "allowed")


@query(f"""SELECT DISTINCT host, CASE length(host) % 4 WHEN 0 THEN 2000 WHEN 1 THEN 1500 ELSE 1000 END AS delay_ms, CASE length(host) % 4 WHEN 0 THEN 'https://' || host || '/s.xml,second' ELSE '' END AS sitemaps FROM (SELECT {_HOST} AS host FROM pages)""")
def crawl_delays(t: Tables) -> DataFrame:
    """A host's delay counts where it is longer than the configured second: `2s` is 2 seconds, 1.5 counts, a negative one and none don't. Sitemaps are listed in order."""
    quarry.ship(t.spark)
    hosts = t.pages.select(urls.host(C("url")).alias("host")).distinct()
    kind = F.length("host") % 4
    listed = F.concat(F.lit("Sitemap: https://"), "host", F.lit("/s.xml\nUser-agent: quarry\nCrawl-delay: 2s\n  sitemap :second # last\nsitemap:\n"))
    text_ = F.when(kind == 0, listed).when(kind == 1, "User-agent: *\nCrawl-delay: 1.5 # seconds").when(kind == 2, "User-agent: *\nCrawl-delay: -3\nDisallow: /x")
    return urls.robots_sites(hosts.withColumn("text", text_), "quarry/1.0")[1].select("host", "delay_ms", F.array_join("sitemaps", ",").alias("sitemaps"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, '/d/' || l_orderkey || '/' || l_linenumber AS subject FROM lineitem), r AS (SELECT '/d/' || o_orderkey AS p, o_custkey % 2 = 0 AS allow FROM orders WHERE o_orderkey % 3 <> 0)
 SELECT l_orderkey, l_linenumber, allowed FROM lineitem JOIN (SELECT l_orderkey, l_linenumber, coalesce(arg_max(r.allow, length(r.p)), true) AS allowed FROM (SELECT DISTINCT l_orderkey, l_linenumber, substr(subject, 1, unnest(range(1, length(subject) + 1))) AS p FROM s) b LEFT JOIN r USING (p) GROUP BY ALL) USING (l_orderkey, l_linenumber)""")
def robots_many_rules(t: Tables) -> DataFrame:
    """One host with a rule for two of three orders, and a URL for every line: /d/12 also fits what begins with /d/123."""
    rules = t.orders.where("o_orderkey % 3 <> 0").select(F.lit("e.org").alias("host"), (C("o_custkey") % 2 == 0).alias("allow"), made.named("/d/", C("o_orderkey")).alias("pattern"))
    pages = t.lineitem.select("l_orderkey", "l_linenumber", F.lit("e.org").alias("host"), F.concat(F.lit("https://e.org/d/"), C("l_orderkey").cast("string"), F.lit("/"), C("l_linenumber").cast("string")).alias("url"))
    return urls.rule_verdicts(pages, rules).select("l_orderkey", "l_linenumber", "allowed")


@query("SELECT page_id, page_id % 6 NOT IN (0, 2, 5) AS allowed FROM pages")
def robots_plain_text(t: Tables) -> DataFrame:
    """Characters of expressions stand for themselves in a rule; * and a last $ don't."""
    subject = F.element_at(F.array(*map(F.lit, ["/a\\E(/x", "/a\\Exx", "/q?x=[1]", "/q?x=1", "/end$", "/end"])), (C("page_id") % 6 + 1).cast("int"))
    rules = t.spark.createDataFrame([("e.org", False, p) for p in ("/a\\E(", "/q?x=[1]", "/end$", "/*\\E$")], "host string, allow boolean, pattern string")
    pages = t.pages.select("page_id", F.lit("e.org").alias("host"), F.concat(F.lit("https://e.org"), subject, F.lit("")).alias("url"))
    return urls.rule_verdicts(pages, rules).select("page_id", "allowed")


_CHAINS = "SELECT page_id, page_id // 7 AS block, page_id % 7 AS k, page_id - page_id % 7 AS first FROM pages"


@query(f"SELECT page_id, CASE WHEN block % 5 = 4 AND k > 0 THEN 'too many redirects' WHEN block % 3 = 1 THEN 'HTTP 404' END AS error, CASE WHEN NOT (block % 5 = 4 AND k > 0) AND block % 3 <> 1 THEN md5((SELECT html FROM pages p WHERE p.page_id = c.first)) END AS body_md5 FROM ({_CHAINS}) c")
def redirected_fetch(t: Tables) -> DataFrame:
    """Chains of up to six redirects to the first of seven pages; in every fifth block they run in a circle."""
    k, block = C("page_id") % 7, F.floor(C("page_id") / 7)
    own = lambda d: F.concat(F.lit("https://e.org/c/"), d.cast("string"))
    before = F.when((block % 5 == 4) & (k == 1), C("page_id") + 5).otherwise(C("page_id") - 1)
    status = F.when(k > 0, 302).when(block % 3 == 1, 404).otherwise(200)
    rec = t.pages.select(own(C("page_id")).alias("url"), status.alias("status"), F.when(k > 0, F.concat(F.lit("../c/./"), before.cast("string"))).alias("location"), F.when(k == 0, C("html")).alias("body"))
    ask = t.pages.select("page_id", own(C("page_id")).alias("url"))
    got = connectors.replay(rec.unionByName(rec.where("status = 200")))(ask)  # some are recorded twice
    return ask.join(got, "url").select("page_id", "error", F.md5("body").alias("body_md5"))


_TREE_NAV = "'<a href=\"/p/' || (2 * k + 1) || '\">1</a><a href=\"/lost/' || k || '\">2</a><a href=''./' || (2 * k + 2) || '#x''>3</a><a href=\"/private/' || k || '\">4</a>'"
_TREE = f"""page AS (SELECT page_id AS k, {_TREE_NAV} || replace(html, 'href', 'hfer') AS html, CASE WHEN page_id % 17 = 5 THEN 404 WHEN page_id % 25 = 7 THEN 0 ELSE 200 END AS status FROM (SELECT *, page_id AS k FROM pages)),
 link AS (SELECT k AS src, 2 * k + 1 AS dst, 0 AS at FROM page UNION ALL SELECT k, -1 - k, 1 FROM page UNION ALL SELECT k, 2 * k + 2, 2 FROM page),
 reach(k, depth, place) AS (SELECT 0::BIGINT, 0, [0] UNION ALL SELECT l.dst, r.depth + 1, list_append(r.place, l.at) FROM reach r JOIN page p ON p.k = r.k AND p.status = 200 JOIN link l ON l.src = r.k WHERE r.depth < 4),
 tried AS (SELECT r.k, r.depth, r.place, coalesce(p.status, 0) AS status, p.html FROM reach r LEFT JOIN page p USING (k)),
 counted AS (SELECT *, coalesce(sum(CASE WHEN status = 200 THEN 1 ELSE 0 END) OVER (ORDER BY depth, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tried),
 run AS (SELECT * FROM counted WHERE before < 20)"""


def _tree_recording(t: Tables) -> DataFrame:
    """Pages as a site: page k links to 2k+1, a lost page, 2k+2 and a private one. Every tenth is reached over two redirects, some redirect to themselves, some fail."""
    k = C("page_id")
    nav = F.format_string("<a href=\"/p/%d\">1</a><a href=\"/lost/%d\">2</a><a href='./%d#x'>3</a><a href=\"/private/%d\">4</a>", 2 * k + 1, k, 2 * k + 2, k)
    at = lambda kind: F.concat(F.lit(f"https://site.org/{kind}/"), k.cast("string"))
    ok, none = (k % 17 != 5) & (k % 25 != 7), F.lit(None).cast("string")
    row = lambda url, status, location, body: F.struct(url.alias("url"), status.alias("status"), location.alias("location"), body.alias("body"))
    own = F.concat(nav, F.replace("html", F.lit("href"), F.lit("hfer")))
    moved = k % 10 == 4
    first = row(at("p"), F.when(k % 17 == 5, 404).when(~ok | moved, 301).otherwise(200), F.when(ok, at("hop")).otherwise(at("p")), F.when(ok & ~moved, own))
    hops = [row(at("hop"), F.lit(302), F.concat(F.lit("../moved/"), k.cast("string")), none), row(at("moved"), F.lit(200), none, own)]
    rows = t.pages.select(F.explode(F.when(moved & ok, F.array(first, *hops)).otherwise(F.array(first))).alias("r")).select("r.*")
    robots = t.spark.createDataFrame([("https://site.org/robots.txt", 200, None, "User-agent: *\nDisallow: /private/\nCrawl-delay: 2\nSitemap: https://site.org/s.xml")], "url string, status int, location string, body string")
    return rows.unionByName(robots)


@query(f"WITH RECURSIVE {_TREE} SELECT CASE WHEN k < 0 THEN 'https://site.org/lost/' || (-1 - k) ELSE 'https://site.org/p/' || k END AS url, depth, status, CASE WHEN status = 200 THEN strlen(html) ELSE 0 END AS bytes, CASE WHEN status = 200 THEN md5(html) ELSE md5('') END AS html_md5 FROM run")
def crawl_site(t: Tables) -> DataFrame:
    """A crawl from raw html, stopped after two levels and taken up again: robots, redirects, lost pages, a page limit in the middle of a level."""
    quarry.ship(t.spark)
    config, folder = crawl.CrawlConfig.of("https://site.org/p/0", max_pages=20, max_depth=4), new_folder(t.spark, "crawl-run")
    fetch = connectors.replay(_tree_recording(t))
    for levels in (2, None):
        found = crawl.crawl_run(t.spark, config, fetch, folder, levels=levels)
    pages = t.spark.read.parquet(*[f"{folder}/pages{d}" for d in range(found.agg(F.max("depth")).first()[0] + 1)])
    return pages.select("url", "depth", "status", "bytes", F.md5("html").alias("html_md5"))


@query(f"WITH RECURSIVE {_TREE} SELECT 'site.org' AS domain, 'site.org_20260101_000000' AS crawl_id, 'completed' AS status, count(*) FILTER (status = 200) AS pages_ok, count(*) FILTER (status <> 200) AS pages_failed, sum(strlen(html)) FILTER (status = 200)::BIGINT AS total_bytes, (count(*) FILTER (status = 200))::INT AS listed, (count(*) FILTER (status <> 200))::INT AS errors, 2000 AS delay_ms FROM run")
def crawl_site_manifest(t: Tables) -> DataFrame:
    quarry.ship(t.spark)
    config, folder = crawl.CrawlConfig.of("https://site.org/p/0", max_pages=20, max_depth=4, started="20260101_000000"), new_folder(t.spark, "crawl-run")
    crawl.crawl_run(t.spark, config, connectors.replay(_tree_recording(t)), folder, "2026-01-02T00:00:00.000Z")
    hosts = t.spark.read.parquet(f"{folder}/hosts0").select(C("host").alias("domain"), "delay_ms")
    m = t.spark.read.parquet(f"{folder}/manifest").join(hosts, "domain")
    return m.select("domain", C("crawlId").alias("crawl_id"), "status", "stats.pages_ok", "stats.pages_failed", "stats.total_bytes", F.size("pages").alias("listed"), F.size("errors").alias("errors"), "delay_ms")


@query(f"SELECT page_id, {norm_sql('url')} AS full_form FROM pages")
def url_full_forms(t: Tables) -> DataFrame:
    """Other ways to write the pages' URLs, by turns: an upper-case scheme and host, a port, dot segments, a fragment, an escaped letter. The full form undoes them all."""
    quarry.ship(t.spark)
    url, site = C("url"), F.concat(urls.part(C("url"), 1), F.lit("://"), urls.part(C("url"), 2))
    rest = F.substr("url", F.length(site) + 1)
    port = F.when(url.startswith("https"), ":443").otherwise(":80")
    ways = [url, F.concat(F.upper(site), rest), F.concat(site, port, rest), F.concat(site, F.lit("/./x/.."), rest), F.concat(site, F.lit("/a/b/../.."), rest), F.concat(F.lit(" "), F.substring_index(url, "#", 1), F.lit("#other "))]
    return t.pages.select("page_id", urls.normalized_full(F.get(F.array(*ways), (C("page_id") % len(ways)).cast("int"))).alias("full_form"))


def _linked(t: Tables) -> DataFrame:
    """Pages by normal form, the first of each, with their links as a ring: every page leads to the next two and to one that isn't there."""
    first = t.pages.select("page_id", urls.normalized(C("url")).alias("url")).groupBy("url").agg(F.min("page_id").alias("page_id"))
    placed = written(corpus.numbered(first, ["page_id"], "k"), "ring")
    to = lambda n, name: placed.select((C("k") - n).alias("k"), C("url").alias(name))
    both = placed.join(to(1, "a"), "k", "left").join(to(2, "b"), "k", "left")
    error = F.when(C("page_id") % 17 == 5, F.lit("HTTP 404")).when(C("page_id") % 17 == 6, F.lit("timeout"))
    return both.select("url", error.alias("error"), F.array_compact(F.array("b", F.concat(F.lit("https://lost.example.org/"), C("k").cast("string")), "a")).alias("links"), "k")


_RING = f"""ring AS (SELECT *, row_number() OVER (ORDER BY page_id) AS k FROM (SELECT {norm_sql('url')} AS url, min(page_id) AS page_id FROM pages GROUP BY 1)),
 page AS (SELECT url, k, CASE WHEN page_id % 17 = 5 THEN 404 WHEN page_id % 17 = 6 THEN 408 ELSE 200 END AS status FROM ring),
 link AS (SELECT a.url AS src, b.url AS dst, CASE WHEN b.k = a.k + 2 THEN 0 ELSE 2 END AS at FROM page a JOIN page b ON b.k IN (a.k + 1, a.k + 2) WHERE a.status = 200 UNION ALL SELECT url, 'https://lost.example.org/' || k, 1 FROM page WHERE status = 200),
 reach(url, depth, place) AS (SELECT url, 0, [0] FROM page WHERE k = 1 AND NOT regexp_matches(url, '(?i)\\.html\\z') UNION ALL SELECT l.dst, r.depth + 1, list_append(r.place, l.at) FROM reach r JOIN link l ON l.src = r.url WHERE r.depth < 6 AND NOT regexp_matches(l.dst, '(?i)\\.html\\z')),
 best AS (SELECT url, min(depth) AS depth FROM reach GROUP BY url), one AS (SELECT b.url, b.depth, min(r.place) AS place FROM best b JOIN reach r ON r.url = b.url AND r.depth = b.depth GROUP BY ALL),
 tried AS (SELECT o.url, o.depth, o.place, coalesce(p.status, 0) AS status FROM one o LEFT JOIN page p USING (url)),
 counted AS (SELECT *, coalesce(sum(CASE WHEN status = 200 THEN 1 ELSE 0 END) OVER (ORDER BY depth, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tried)"""


def _crawl_config(t: Tables, pages: DataFrame) -> crawl.CrawlConfig:
    seed = pages.where("k = 1").first()["url"]
    return crawl.CrawlConfig.of(seed, max_pages=12, max_depth=6, exclude=("**.html",), delay_ms=None)


@query(f"WITH RECURSIVE {_RING} SELECT url, depth::INT AS depth, status FROM counted WHERE before < 12")
def crawl_driver(t: Tables) -> DataFrame:
    """A crawl of at most 12 pages and 6 links deep, past errors, a lost link a page and excluded paths."""
    pages = _linked(t)
    return crawl.crawl(t.spark, pages, _crawl_config(t, pages)).select("url", "depth", "status")


@query(f"WITH RECURSIVE {_RING} SELECT url, depth::INT AS depth, status FROM counted WHERE before < 12")
def crawl_resumed(t: Tables) -> DataFrame:
    """The same crawl, ended after each two levels and taken up from its folder."""
    pages, folder = _linked(t), new_folder(t.spark, "crawl")
    config = _crawl_config(t, pages)
    for _ in range(4):
        found = crawl.crawl(t.spark, pages, config, folder=folder, levels=2)
    return found.select("url", "depth", "status")


def _crawled_pages(t: Tables) -> DataFrame:
    d = C("page_id")
    typed = text.page_type(urls.path(C("url")), text.page_title(C("html")), text.meta_content(C("html"), "og:type"))
    return t.pages.select(F.left(F.md5(d.cast("string")), F.lit(12)).alias("urlHash"), "url", F.when(d % 17 == 0, 404).otherwise(200).alias("status"), typed.alias("type"), made.named("Page ", d).alias("title"), (d % 3).cast("int").alias("depth"), F.octet_length("html").cast("long").alias("bytes"), (d % 97).alias("ms"), "html", F.when(d % 2 == 0, F.lit(" ")).otherwise(made.named("own ", d)).alias("text"))


def _saved_crawl(t: Tables) -> str:
    folder, pages = new_folder(t.spark, "crawl"), _crawled_pages(t)
    texts = t.pages.where("page_id % 4 <> 2").select(F.left(F.md5(C("page_id").cast("string")), F.lit(12)).alias("urlHash"), made.named("clean ", C("page_id")).alias("cleanText"))
    crawl.save_crawl(pages, texts, folder, "example.com", "20260101_000000", "2026-01-01T00:00:00.000Z")
    return folder


@query("SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 'own ' || page_id WHEN page_id % 4 = 0 THEN 'clean ' || page_id ELSE ' ' END AS text FROM pages WHERE page_id % 17 <> 0")
def load_crawl(t: Tables) -> DataFrame:
    """Pages that the manifest lists, with the separate text where their own is blank and there is one."""
    return records.load_crawl(t.spark, _saved_crawl(t)).select(F.regexp_replace("title", "Page ", "").cast("long").alias("page_id"), "text")


@query("SELECT 'example.com' AS domain, 'completed' AS status, count(*) FILTER (page_id % 17 <> 0) AS pages_ok, count(*) FILTER (page_id % 17 = 0) AS pages_failed, sum(strlen(html)) FILTER (page_id % 17 <> 0)::BIGINT AS total_bytes, (count(*) FILTER (page_id % 17 <> 0))::INT AS listed FROM pages")
def crawl_manifest(t: Tables) -> DataFrame:
    m = t.spark.read.parquet(f"{_saved_crawl(t)}/manifest")
    return m.select("domain", "status", "stats.pages_ok", "stats.pages_failed", "stats.total_bytes", F.size("pages").alias("listed"))


@query("SELECT page_id, 'Page ' || page_id AS title, page_id % 3 = 0 AS at_seed FROM pages")
def page_projection(t: Tables) -> DataFrame:
    pages = _crawled_pages(t).withColumn("metadata", F.struct("title")).withColumn("jsonLd", F.lit(None).cast("string"))
    return extraction.page_data(pages).select(F.regexp_replace("title", "Page ", "").cast("long").alias("page_id"), "title", (C("depth") == 0).alias("at_seed"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '{\"a\": ' || page_id || '}' ELSE '[{\"a\": 1},{\"b\": ' || page_id || '}]' END AS json_ld FROM pages")
def page_json_ld(t: Tables) -> DataFrame:
    block = lambda body: F.concat(F.lit('<script type="application/ld+json">\n'), body, F.lit("</script>"))
    d = C("page_id").cast("string")
    own = F.when(C("page_id") % 3 == 0, block(F.lit("{bad"))).when(C("page_id") % 3 == 1, F.concat(block(F.concat(F.lit('{"a": '), d, F.lit("}"))), block(F.lit("{bad")))).otherwise(F.concat(block(F.lit('{"a": 1}')), block(F.concat(F.lit('{"b": '), d, F.lit("}")))))
    return t.pages.select("page_id", text.json_ld(F.concat(own, "html")).alias("json_ld"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'http://e.org/a/x' WHEN 1 THEN 'http://e.org/a/b/y' WHEN 2 THEN 'http://e.org/z' WHEN 3 THEN 'http://e.org/up' WHEN 4 THEN 'http://e.org/a/b/?q=../1' ELSE 'http://e.org/a/b/d.e/..f' END AS link FROM pages""")
def link_resolution(t: Tables) -> DataFrame:
    """References with dot segments from http://e.org/a/b/c, by hand."""
    href = F.element_at(F.array(*map(F.lit, ["../x", "./y", "../../../z", "/q/./../up", "?q=../1", "d.e/..f"])), (C("page_id") % 6 + 1).cast("int"))
    base = F.when(C("page_id") % 6 == 4, F.lit("http://e.org/a/b/")).otherwise(F.lit("http://e.org/a/b/c"))
    return t.pages.select("page_id", urls.resolved(href, base).alias("link"))


@query("SELECT conv_id, turn, 'Name ' || conv_id || '=https://a.org/' || turn || ';https://b.net/=https://b.net/' AS links FROM conversations")
def answer_links(t: Tables) -> DataFrame:
    """Links of an answer's HTML: titled by their text, or by their URL; unwanted hosts and other schemes are left out."""
    html = F.concat(F.lit('<p><a class="x" href="https://a.org/'), C("turn").cast("string"), F.lit('">Name '), C("conv_id").cast("string"), F.lit("</a> <a href='https://b.net/'> </a> <a href='https://www.perplexity.ai/x'>no</a> <a href='mailto:x'>no</a>"))
    return t.conversations.select("conv_id", "turn", F.array_join(F.transform(mentions.html_links(html), lambda s: F.concat(s["title"], F.lit("="), s["url"])), ";").alias("links"))


@query("SELECT page_id, 'https://example.com/a/c' || page_id || '?a=2&b=1' AS full_form FROM pages")
def url_full_form(t: Tables) -> DataFrame:
    quarry.ship(t.spark)
    return t.pages.select("page_id", urls.normalized_full(F.concat(F.lit("HTTPS://Example.com:443/a/./b/../c"), "page_id", F.lit("/?b=1&a=2#top"))).alias("full_form"))


# --- extraction ------------------------------------------------------------------------------------------------------

_REPLIED = "SELECT doc_id, doc_id % 6 AS kind, doc_id % 40 AS e, length(trim(coalesce(text, ''))) >= 100 AS enough, text FROM documents"


def _page_rows(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", made.named("https://www.site.org/", C("doc_id")).alias("url"), made.named("Title ", C("doc_id")).alias("title"), "text")


def _replies(t: Tables) -> DataFrame:
    """Replies by document: kinds 1 to 3 break the schema by a confidence, a long statement or no source info; the others are good."""
    d, kind, e = C("doc_id"), C("doc_id") % 6, C("doc_id") % 40
    null = F.lit(None).cast("string")
    entity = lambda name, type_, parent, level: F.struct(name.alias("name"), F.lit(type_).alias("type"), F.lit("d").alias("description"), level.alias("confidence"), null.alias("officialSite"), parent.alias("parentEntity"))
    own = F.concat(F.lit("Ent "), e.cast("string"), F.lit(" Inc"))
    entities = F.array(entity(own, "organization", F.lit("Big Corp"), F.when(kind == 1, "certain").otherwise("high")), entity(made.named("Thing ", d), "product", F.lit("Big Corp"), F.lit("low")))
    long = F.when(kind == 2, F.repeat(F.lit("s"), 241)).otherwise(made.named("Statement ", d))
    related = F.array(own, F.lit("Big Corp"), F.lit("Big Corp"))
    claims = F.array(F.struct(made.named("Claim ", d).alias("title"), long.alias("statement"), null.alias("quote"), F.lit("").alias("entityRole"), related.alias("relatedEntities"), F.lit("medium").alias("confidence")))
    info = F.when(kind != 3, F.struct(F.lit("").alias("title"), F.lit("").alias("publisher"), F.lit("webpage").alias("type"), F.lit("high").alias("confidence")))
    answer = F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(entities.alias("entities"), claims.alias("claims"), info.alias("sourceInfo"))), F.lit("\n```"))
    rec = t.documents.select(made.named("https://www.site.org/", d).alias("url"), answer.alias("answer"), F.lit(100).alias("input_tokens"), e.alias("output_tokens"))
    return connectors.extraction_replies(_page_rows(t), rec)


def _aliases(t: Tables) -> DataFrame:
    return names.alias_map(t.spark.createDataFrame([("the-ent-3", "Ent 3", 1), ("bigco", "Big", 2)], "slug string, name string, ord int"))


_GOOD = f"SELECT * FROM ({_REPLIED}) WHERE enough AND kind NOT IN (1, 2, 3)"
_ENT = "CASE WHEN e = 3 THEN 'the-ent-3' ELSE 'ent-' || e END"


@query(f"SELECT doc_id, enough AND kind NOT IN (1, 2, 3) AS valid FROM ({_REPLIED})")
def extraction_replies(t: Tables) -> DataFrame:
    return _replies(t).select("doc_id", C("x").isNotNull().alias("valid"))


@query(f"SELECT count(*) AS total, count(*) FILTER (enough AND kind NOT IN (1, 2, 3)) AS processed, count(*) FILTER (NOT (enough AND kind NOT IN (1, 2, 3))) AS skipped, count(*) FILTER (enough) AS calls FROM ({_REPLIED})")
def processing_stats(t: Tables) -> DataFrame:
    return extraction.processing_stats(_replies(t))


@query(f"SELECT 'https://www.site.org/' || doc_id AS url, 0 AS pos, {_ENT} AS slug, 'bigco' AS parent FROM ({_GOOD}) UNION ALL SELECT 'https://www.site.org/' || doc_id, 1, 'thing-' || doc_id, NULL FROM ({_GOOD})")
def extracted_entities(t: Tables) -> DataFrame:
    return extraction.entity_drafts(_replies(t), _aliases(t)).select("url", "pos", "slug", C("parentEntity").alias("parent"))


@query(f"SELECT 'Title ' || doc_id AS title, 'www.site.org' AS publisher, 'https://www.site.org/' || doc_id AS url, 'webpage' AS type FROM ({_GOOD})")
def extracted_sources(t: Tables) -> DataFrame:
    return extraction.source_drafts(_replies(t).where("x IS NOT NULL"), "2026-01-01").select("title", "publisher", "url", "type")


@query(f"SELECT 'https://www.site.org/' || doc_id AS url, 'Claim ' || doc_id AS title, {_ENT} || ':subject,bigco:related,bigco:related' AS refs, 'Auto-extracted from www.site.org crawl' AS said, 'medium' AS confidence FROM ({_GOOD})")
def extracted_claims(t: Tables) -> DataFrame:
    found = extraction.claim_drafts(_replies(t), _aliases(t), "2026-01-01")
    shown = F.array_join(F.transform("entities", lambda r: F.concat(r["slug"], F.lit(":"), r["role"])), ",")
    return found.select("url", "title", shown.alias("refs"), C("changelog")[0]["summary"].alias("said"), "confidence")


@query(f"SELECT 'batch ' || (doc_id % 3) AS batch, count(*) AS n FROM ({_GOOD}) GROUP BY 1")
def claims_of_batches(t: Tables) -> DataFrame:
    """Claims of several batches are put together as they are."""
    rows = extraction.claim_drafts(_replies(t), _aliases(t), "2026-01-01").select("id", F.substring_index("url", "/", -1).cast("long").alias("doc_id"))
    parts = [rows.where(C("doc_id") % 3 == k).withColumn("batch", F.lit(f"batch {k}")) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id % 9 AS page, count(*) AS calls, sum(100 + doc_id % 40)::BIGINT AS tokens FROM documents WHERE length(trim(coalesce(text, ''))) >= 100 GROUP BY 1")
def tokens_used(t: Tables) -> DataFrame:
    return extraction.tokens_used(_replies(t).where("input_tokens IS NOT NULL").withColumn("page", C("doc_id") % 9), "page")


@query("SELECT doc_id, length(text) > 8000 AS cut, left(coalesce(text, ''), 8000) AS body, 'Look for claims about it.' AS focus, 'Not provided' AS described FROM documents")
def extraction_prompts(t: Tables) -> DataFrame:
    """What a prompt holds between its head and its request."""
    made_prompt = extraction.prompt(C("url"), C("title"), F.lit("other"), F.lit(""), F.coalesce("text", F.lit("")), "Ent 3")
    rows = _page_rows(t).withColumn("prompt", made_prompt)
    body = F.substring_index(F.substr("prompt", F.locate("- Description: Not provided\n\n", "prompt") + F.lit(len("- Description: Not provided\n\n"))), "\n\nReply with one JSON object", 1)
    return rows.select("doc_id", (F.length("text") > 8000).alias("cut"), body.alias("body"), F.regexp_extract("prompt", "Look for claims about it\\.", 0).alias("focus"), F.regexp_extract("prompt", "Description: ([^\\n]*)", 1).alias("described"))


@query("SELECT 'example.com' || '_' || 'example.com_' || strftime(ts, '%Y%m%d_%H%M%S') AS crawl_id FROM events")
def draft_crawl_ids(t: Tables) -> DataFrame:
    run = F.concat(F.lit("example.com_"), F.date_format("ts", "yyyyMMdd_HHmmss"))
    return t.events.select(drafts.crawl_id(F.lit("example.com"), run).alias("crawl_id"))


@query("SELECT doc_id, 'src_' AS prefix, 12 AS n_chars, true AS plain FROM documents")
def short_ids(t: Tables) -> DataFrame:
    """Ids are hashes, so their form is what can be compared."""
    made_id = names.short_id("src_", C("doc_id").cast("string"))
    return t.documents.select("doc_id", F.left(made_id, F.lit(4)).alias("prefix"), F.length(made_id).alias("n_chars"), made_id.rlike(r"^src_[a-z0-9]{8}\z").alias("plain"))


# --- drafts ----------------------------------------------------------------------------------------------------------

_MOVED = ", ".join(_quoted(a) for a, _ in _MOVES)
_HOMES = [("entity-3", "batch-2"), ("entity-10", "batch-0"), ("entity-50", "batch-9")]
_IS_HOME = "CASE slug " + " ".join(f"WHEN '{k}' THEN starts_with(batch, '{v}')" for k, v in _HOMES) + " ELSE false END"
_NOISY = "doc_id % 11 = 0"
_ACTIONS = f"""SELECT *, CASE WHEN slug IN ({_MOVED}) THEN 'merge' WHEN row_number() OVER (PARTITION BY slug ORDER BY {_IS_HOME} DESC, CASE WHEN {_IS_HOME} THEN 0 ELSE {_RANK} END DESC, CASE WHEN {_IS_HOME} THEN 0 ELSE n_pages END DESC, doc_id) > 1 THEN 'duplicate'
 WHEN first_value({_NOISY}) OVER (PARTITION BY slug ORDER BY doc_id) THEN 'noise' ELSE 'keep' END AS action, CASE WHEN doc_id % 4 = 0 THEN 'entity-1' WHEN doc_id % 4 = 1 THEN 'entity-8' END AS parent FROM ({_DRAFT})"""


def _inventory(t: Tables) -> DataFrame:
    parent = F.when(C("doc_id") % 4 == 0, "entity-1").when(C("doc_id") % 4 == 1, "entity-8")
    return _drafts(t).withColumn("batch_ord", C("doc_id")).withColumn("parentEntity", parent)


def _config(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The merge and home maps as tables."""
    return t.spark.createDataFrame(_MOVES, "variant string, canonical string"), t.spark.createDataFrame(_HOMES, "slug string, home string")


@query(f"SELECT doc_id, slug, action FROM ({_ACTIONS})")
def dedup_actions(t: Tables) -> DataFrame:
    return drafts.dedup_actions(_inventory(t), *_config(t), F.expr(_NOISY)).select("doc_id", "slug", "action")


@query(f"SELECT DISTINCT slug FROM ({_ACTIONS}) WHERE action = 'noise' ORDER BY slug LIMIT 30")
def noise_report(t: Tables) -> DataFrame:
    return drafts.noise_report(drafts.dedup_actions(_inventory(t), *_config(t), F.expr(_NOISY)))


def _claim_refs(t: Tables) -> DataFrame:
    ref = lambda k: F.struct(made.named("entity-", k).alias("slug"), F.lit("subject").alias("role"))
    return t.orders.select(C("o_orderkey").alias("id"), F.array(ref(C("o_orderkey") % 97), ref(C("o_orderkey") % 5)).alias("entities"))


_MOVE = "CASE slug " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _MOVES) + " ELSE slug END"
_CLAIM_REFS = f"SELECT id, string_agg(slug, ',' ORDER BY pos) AS refs FROM (SELECT id, pos, slug FROM (SELECT id, pos, {_MOVE} AS slug FROM (SELECT o_orderkey AS id, 0 AS pos, 'entity-' || (o_orderkey % 97) AS slug FROM orders UNION ALL SELECT o_orderkey, 1, 'entity-' || (o_orderkey % 5) FROM orders)) QUALIFY row_number() OVER (PARTITION BY id, slug ORDER BY pos) = 1) GROUP BY id"
_BEFORE = "SELECT o_orderkey AS id, 'entity-' || (o_orderkey % 97) || ',' || 'entity-' || (o_orderkey % 5) AS before FROM orders"


@query(f"SELECT id, refs, refs <> before AS updated FROM ({_CLAIM_REFS}) JOIN ({_BEFORE}) USING (id)")
def dedup_claims(t: Tables) -> DataFrame:
    _, claims, _ = drafts.dedup_run(_inventory(t), _claim_refs(t), *_config(t), F.expr(_NOISY))
    return claims.select("id", F.array_join("entities.slug", ",").alias("refs"), "updated")


@query(f"SELECT doc_id, slug, CASE parent WHEN 'entity-1' THEN 'entity-2' ELSE parent END AS parent FROM ({_ACTIONS}) WHERE action = 'keep'")
def dedup_parents(t: Tables) -> DataFrame:
    stay, _, _ = drafts.dedup_run(_inventory(t), _claim_refs(t), *_config(t), F.expr(_NOISY))
    return stay.select("doc_id", "slug", C("parentEntity").alias("parent"))


@query(f"SELECT action, count(*) AS n FROM ({_ACTIONS}) GROUP BY action UNION ALL SELECT 'claims updated', count(*) FROM ({_CLAIM_REFS}) JOIN ({_BEFORE}) USING (id) WHERE refs <> before UNION ALL SELECT 'entities written', count(*) FROM ({_ACTIONS}) WHERE action = 'keep'")
def dedup_sink(t: Tables) -> DataFrame:
    """A dry run writes nothing; a run writes the entities that stay and all claims."""
    folder, written = new_folder(t.spark, "dedup"), []

    def write(name: str, frame: DataFrame) -> None:
        written.append(name)
        records.write_parquet(frame, f"{folder}/{name}")

    drafts.dedup_run(_inventory(t), _claim_refs(t), *_config(t), F.expr(_NOISY), True, write)
    if written:
        raise AssertionError("a dry run wrote")
    _, _, counts = drafts.dedup_run(_inventory(t), _claim_refs(t), *_config(t), F.expr(_NOISY), False, write)
    kept = t.spark.read.parquet(f"{folder}/entities").agg(F.lit("entities written").alias("action"), F.count(F.lit(1)).alias("n"))
    return counts.union(kept)


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'the-one-group-hospitality' WHEN 1 THEN 'stk-steakhouse' WHEN 2 THEN 'dom-perignon' WHEN 3 THEN 'benihana' ELSE 'plain' END AS slug,
 CASE p_partkey % 5 WHEN 0 THEN 'togrp.com' WHEN 1 THEN 'stksteakhouse.com' WHEN 3 THEN 'benihana.com' END AS home FROM part""")
def config_maps(t: Tables) -> DataFrame:
    """The example's merge map moves a slug one hop, and its home map names the batch that is preferred."""
    slug = F.element_at(F.array(*map(F.lit, ["tog", "stk", "dom-p-rignon", "benihana", "plain"])), (C("p_partkey") % 5 + 1).cast("int"))
    moves = t.spark.createDataFrame(example_config.MERGES, "variant string, canonical string")
    homes = t.spark.createDataFrame(example_config.HOMES, "slug string, home string")
    return drafts.remap(t.part.select("p_partkey", slug.alias("slug")), F.broadcast(moves), "slug").join(F.broadcast(homes), "slug", "left").select("p_partkey", "slug", "home")


_NOISE_DISHES = ["Tuna Roll", "Plain name", "Gift Cards", "Kona Grill Tampa"]


@query("SELECT p_partkey, p_partkey % 4 IN (0, 2, 3) AS noisy FROM part")
def noise_by_hand(t: Tables) -> DataFrame:
    """Names whose verdict was read off the rules, not computed with them."""
    name = F.element_at(F.array(*map(F.lit, _NOISE_DISHES)), (C("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", noise.is_noise(names.slug(name), name, F.lit("organization"), F.lit("about it"), example_config.EXAMPLE).alias("noisy"))


@record_query("SELECT id, CASE WHEN NOT EXISTS (SELECT 1 FROM corpus_lines WHERE l_orderkey = k) THEN 'citations' ELSE '' END AS errors FROM claim")
def claim_rules(t: Tables) -> DataFrame:
    return drafts.check_rules(made.claims(t.orders, t.lineitem), drafts.claim_rules()).select("id", F.array_join("errors", ",").alias("errors"))


@record_query("SELECT id, concat_ws(',', CASE WHEN k % 9 = 0 THEN 'publisher' END, CASE WHEN k % 10 = 0 THEN 'type' END, CASE WHEN k % 15 = 3 THEN 'snapshots' END) AS errors FROM source")
def source_rules(t: Tables) -> DataFrame:
    k = F.regexp_extract("id", "0*(\\d+)\\z", 1).cast("long")
    rows = made.sources(t.supplier)
    rows = rows.withColumn("publisher", F.when(k % 9 == 0, "").otherwise(C("publisher"))).withColumn("type", F.when(k % 10 == 0, "web").otherwise(C("type")))
    rows = rows.withColumn("snapshots", F.when(k % 15 == 3, F.transform("snapshots", lambda s: s.withField("method", F.lit("guess")))).otherwise(C("snapshots")))
    return drafts.check_rules(rows, drafts.source_rules()).select("id", F.array_join("errors", ",").alias("errors"))


@record_query("SELECT slug, concat_ws(',', CASE WHEN k % 8 = 0 THEN 'links' END, CASE WHEN k % 7 = 1 AND parent IS NOT NULL THEN 'parentEntity' END) AS errors FROM entity")
def entity_rules(t: Tables) -> DataFrame:
    k = F.substring("slug", 2, 20).cast("long")
    rows = made.entities(t.customer).withColumn("links", F.when(k % 8 == 0, C("links").withField("twitter", F.lit("no url"))).otherwise(C("links")))
    rows = rows.withColumn("parentEntity", F.when(k % 7 == 1, F.upper("parentEntity")).otherwise(C("parentEntity")))
    return drafts.check_rules(rows, drafts.entity_rules()).select("slug", F.array_join("errors", ",").alias("errors"))


@record_query("SELECT slug, CASE WHEN k % 6 = 0 THEN 'description' ELSE '' END AS errors FROM topic")
def topic_rules(t: Tables) -> DataFrame:
    rows = made.topics(t.part).withColumn("description", F.when(F.substring("slug", 2, 20).cast("long") % 6 == 0, "").otherwise(C("description")))
    return drafts.check_rules(rows, drafts.topic_rules()).select("slug", F.array_join("errors", ",").alias("errors"))


@record_query("""SELECT c.id, concat_ws(',', CASE WHEN NOT EXISTS (SELECT 1 FROM corpus_lines WHERE l_orderkey = c.k) THEN 'citations' END, (SELECT string_agg(DISTINCT 'References unknown source: src_' || lpad(l_suppkey::VARCHAR, 8, '0'), ',' ORDER BY 'References unknown source: src_' || lpad(l_suppkey::VARCHAR, 8, '0')) FROM corpus_lines WHERE l_orderkey = c.k AND l_suppkey % 25 = 0)) AS errors,
 concat_ws(',', (SELECT string_agg('References unknown entity: ' || slug, ',' ORDER BY slug) FROM ref r WHERE r.id = c.id AND slug NOT IN (SELECT slug FROM entity)), CASE WHEN c.k % 3 = 0 THEN 'Low confidence extraction' END) AS warnings FROM claim c""")
def draft_claim_checks(t: Tables) -> DataFrame:
    c = made.corpus(t)
    rows = c.claims.withColumn("_draft", F.struct(F.when(F.substring("id", 5, 8).cast("long") % 3 == 0, "low").otherwise("high").alias("confidence")))
    known = made.sources(t.supplier.where("s_suppkey % 25 <> 0"))
    lost_s = corpus.missing_references(c.citations().select("claim", C("id").alias("ref")), [known.select(C("id").alias("ref"))], "ref").select(C("claim").alias("id"), "ref")
    lost_e = corpus.missing_references(c.entity_refs().select("claim", C("slug").alias("ref")), [c.entities.select(C("slug").alias("ref"))], "ref").select(C("claim").alias("id"), "ref")
    found = drafts.validate_drafts(rows, drafts.claim_rules(), lost_s, lost_e)
    return found.select("id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


# --- from reply to record ---------------------------------------------------------------------------------------------

_AT_DRAFT = "2026-01-01T00:00:00.000Z"


def _saved_batch(t: Tables, folder: str, batch: str, replies: DataFrame) -> None:
    tables = extraction.draft_tables(replies, _aliases(t), "2026-01-01", "model-1", _AT_DRAFT)
    manifest = t.spark.createDataFrame([("www.site.org", batch, _AT_DRAFT, "model-1")], "domain string, crawlId string, createdAt string, model string")
    records.save_batch(tables, folder, batch, manifest)


@query(f"SELECT 'Claim ' || doc_id AS title, 'Title ' || doc_id AS source, {_ENT} || ',bigco,bigco' AS refs FROM ({_GOOD})")
def reply_to_approved(t: Tables) -> DataFrame:
    """Replies become a batch of drafts, which is checked, approved and archived; the store's folder is read back."""
    folder, store = new_folder(t.spark, "drafts"), RecordStore(t.spark, new_folder(t.spark, "store"))
    _saved_batch(t, folder, "b1", _replies(t))
    if not drafts.approve_batch(store, folder, "b1", "1"):
        raise AssertionError("a draft breaks a rule")
    found = RecordStore(t.spark, store.folder)
    sources = found.read("sources").select(C("id").alias("source_id"), C("title").alias("source"))
    claims = found.read("claims").withColumn("source_id", C("citations")[0]["sourceId"])
    return claims.join(sources, "source_id").select("title", "source", F.array_join("entities.slug", ",").alias("refs"))


@query(f"SELECT 'b' || (doc_id % 2) AS batch, (count(DISTINCT {_ENT}) + count(*))::BIGINT AS n_entities, count(*) AS n_sources, count(*) AS n_claims, 'model-1' AS model FROM ({_GOOD}) GROUP BY 1, 5")
def draft_manifest(t: Tables) -> DataFrame:
    """What the manifests of two batches say; the second is saved twice, and replaces itself."""
    folder, replies = new_folder(t.spark, "drafts"), _replies(t)
    for k in (0, 1, 1):
        _saved_batch(t, folder, f"b{k}", replies.where(C("doc_id") % 2 == k))
    m = [records.read_batch(t.spark, folder, b["batch"], "manifest") for b in records.draft_batches(t.spark, folder).collect()]  # two
    return m[0].unionByName(m[1]).select(C("crawlId").alias("batch"), C("n_entities").cast("long").alias("n_entities"), C("n_sources").cast("long").alias("n_sources"), C("n_claims").cast("long").alias("n_claims"), "model")


@query(f"SELECT 'page ' || min(doc_id) AS first_page, count(*)::INT AS n_pages, {_ENT} AS slug, 'high' AS confidence FROM ({_GOOD}) GROUP BY 3")
def draft_provenance(t: Tables) -> DataFrame:
    """An entity of many pages keeps the best confidence and all its pages, in order of their URLs; the first is told by its smallest id here."""
    tables = extraction.draft_tables(_replies(t), _aliases(t), "2026-01-01", "model-1", _AT_DRAFT)
    ids = F.transform("_draft.sourcePages", lambda u: F.substring_index(u, "/", -1).cast("long"))
    return tables["entities"].where("slug LIKE '%ent-%'").select(F.concat(F.lit("page "), F.array_min(ids).cast("string")).alias("first_page"), F.size("_draft.sourcePages").alias("n_pages"), "slug", "_draft.confidence")


@record_query("SELECT slug, CASE WHEN k % 3 = 0 THEN 'new ' || name ELSE name END AS name FROM entity UNION ALL SELECT 'added-' || k, name FROM entity WHERE k % 7 = 0")
def approve_commit(t: Tables) -> DataFrame:
    """A batch with one bad record changes nothing; a good one replaces and adds entities of the very table it reads."""
    folder, store = new_folder(t.spark, "drafts"), RecordStore(t.spark, new_folder(t.spark, "store"))
    old, k = made.entities(t.customer), F.regexp_extract("slug", r"(\d+)\z", 1).cast("long")
    store.commit({"entities": old})
    draft = F.struct(F.lit("high").alias("confidence"))
    one = t.spark.createDataFrame([("x",)], "crawlId string")
    changed = old.where(k % 3 == 0).withColumn("name", F.concat(F.lit("new "), "name"))
    added = old.where(k % 7 == 0).withColumn("slug", F.concat(F.lit("added-"), k.cast("string")))
    good = changed.unionByName(added).withColumn("_draft", draft)
    records.save_batch({"entities": good.unionByName(old.orderBy("slug").limit(1).withColumn("slug", F.lit("BAD")).withColumn("_draft", draft))}, folder, "bad", one)
    records.save_batch({"entities": good}, folder, "good", one)
    if drafts.approve_batch(store, folder, "bad", "1") or store.read("entities").count() != old.count():
        raise AssertionError("a bad batch went in")
    drafts.approve_batch(store, folder, "good", "1")
    left = [r["batch"] for r in records.draft_batches(t.spark, folder).collect()]
    if left != ["bad"]:
        raise AssertionError(f"batches left: {left}")
    return RecordStore(t.spark, store.folder).read("entities").select("slug", "name")


@query(f"SELECT 'entity' AS kind, slug AS id, 'entity-2' AS refs FROM (SELECT DISTINCT slug FROM ({_ACTIONS}) WHERE action = 'keep') UNION ALL SELECT 'claim', id::VARCHAR, refs FROM ({_CLAIM_REFS})")
def dedup_commit(t: Tables) -> DataFrame:
    """A dedup run replaces the entities and claims that it reads; both are read back."""
    store = RecordStore(t.spark, new_folder(t.spark, "store"))
    entities = _inventory(t).select("slug").distinct().withColumn("parentEntity", F.lit("entity-1"))
    store.commit({"entities": entities, "claims": _claim_refs(t)})
    drafts.dedup_store(store, _inventory(t), *_config(t), F.expr(_NOISY))
    kept = store.read("entities").select(F.lit("entity").alias("kind"), C("slug").alias("id"), C("parentEntity").alias("refs"))
    return kept.unionByName(store.read("claims").select(F.lit("claim").alias("kind"), C("id").cast("string").alias("id"), F.array_join("entities.slug", ",").alias("refs")))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 5000 ORDER BY o_orderkey::VARCHAR) = 1 AS keeps, 1::BIGINT AS n FROM orders")
def clashing_ids(t: Tables) -> DataFrame:
    """Three keys and more to an id at first: the smallest keeps it, the others get new ones, and no id has two keys."""
    plain = lambda prefix, key: F.when(key.contains("#"), names.short_id(prefix, key)).otherwise(F.concat(F.lit(prefix), (F.substring_index(key, "#", 1).cast("long") % 5000).cast("string")))
    found = names.assigned_ids(t.orders.select(C("o_orderkey").cast("string").alias("k")), "src_", "k", make=plain)
    owners = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(owners, "id").select(C("key").cast("long").alias("o_orderkey"), (F.length("id") < 12).alias("keeps"), "n")


# --- monitoring ------------------------------------------------------------------------------------------------------


def _prompts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("prompt"))


@query("SELECT doc_id, platform, least(length(coalesce(text, '')), longest)::INT AS n_chars, platform = 'google' AS rendered FROM documents CROSS JOIN (VALUES ('perplexity', 10000), ('chatgpt', 4000), ('google', 400)) v(platform, longest)")
def platform_requests(t: Tables) -> DataFrame:
    asked = monitor.platform_requests(_prompts(t))
    got = F.coalesce(F.get_json_object("payload", "$.prompt"), F.get_json_object("payload", "$.query"), F.lit(""))
    return asked.select("doc_id", "platform", F.length(got).alias("n_chars"), (F.get_json_object("payload", "$.render") == "html").isNotNull().alias("rendered"))


def _answers(t: Tables) -> DataFrame:
    """Customers asked about on every platform; the recording fails for every seventh and lacks every eleventh."""
    key, k = C("c_custkey"), C("k")
    ask = t.customer.select(made.named("c", key).alias("entity"), C("c_name").alias("entityName"), monitor.question(C("c_name")).alias("prompt"), key.alias("k"))
    links = F.array(F.struct(F.lit("t").alias("title"), F.when(k % 4 == 0, made.named("https://example.org/entities/c", k)).otherwise("https://other.net/x").alias("url")), F.struct(F.lit("u").alias("title"), F.lit("https://last.net").alias("url")))
    answer = made.named("Answer ", k)
    content = F.when(C("platform") == "perplexity", F.to_json(F.struct(F.array(F.struct(answer.alias("answer"), links.alias("citations"))).alias("answer_results")))).when(C("platform") == "chatgpt", F.to_json(F.struct(answer.alias("response_text")))).otherwise(F.to_json(F.struct(answer.alias("answer"), links.alias("sources"))))
    asked = monitor.platform_requests(ask)
    rec = asked.where("k % 11 <> 0").select("platform", "prompt", F.when(C("k") % 7 == 0, 503).otherwise(200).alias("status"), content.alias("content"))
    return monitor.platform_answers(asked, rec)


_ASKED = """SELECT 'c' || c_custkey AS entity, c_name AS entityName, platform, c_custkey AS k, platform <> 'chatgpt' AND c_custkey % 4 = 0 AS cited, 'Answer ' || c_custkey AS answer FROM customer CROSS JOIN (VALUES ('perplexity'), ('chatgpt'), ('google')) v(platform)
 WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0"""
_AT = "2026-01-05T09:00:00.000Z"


def _results(t: Tables) -> DataFrame:
    return monitor.mention_results(_answers(t), "example.org", F.lit(_AT))


@query(f"SELECT entity, entityName, 'What is ' || entityName || '?' AS prompt, platform, cited, CASE WHEN cited THEN 'https://example.org/entities/' || entity END AS citedUrl, CASE WHEN platform = 'chatgpt' THEN 0 ELSE 2 END AS n_sources, answer FROM ({_ASKED})")
def mention_results(t: Tables) -> DataFrame:
    return _results(t).select("entity", "entityName", "prompt", "platform", "cited", "citedUrl", F.size("sources").alias("n_sources"), C("answerExcerpt").alias("answer"))


def _runs(t: Tables) -> str:
    """Daily runs of the checks, saved one after another, and then one of the monitor."""
    folder = new_folder(t.spark, "monitor")
    null = F.lit(None).cast("string")
    rows = _checks(t).select("entity", C("entity").alias("entityName"), F.lit("p").alias("prompt"), F.concat("day", F.lit("T09:00:00.000Z")).alias("timestamp"), "platform", "cited", null.alias("citedUrl"), F.from_json(F.lit("[]"), "array<struct<title:string,url:string>>").alias("sources"), made.named("answer ", C("event_id")).alias("answerExcerpt"), "day")
    days = [r["day"] for r in rows.select("day").distinct().orderBy(F.desc("day")).limit(12).collect()]
    for day in reversed(days):
        monitor.save_run(t.spark, folder, rows.where(C("day") == day).drop("day"), f"{day}T09:00:00.000Z")
    return folder


@query(f"SELECT replace(day, '-', ':') || 'T09:00:00:000Z' AS lastRun, 0::BIGINT AS totalChecks, 0::BIGINT AS citations, count(*) AS results FROM ({_CHECKS}) GROUP BY day ORDER BY day DESC LIMIT 10")
def mention_history(t: Tables) -> DataFrame:
    """The newest ten of the saved runs (twelve are saved, for two to be left out)."""
    return monitor.mention_history(t.spark, _runs(t))


@query(f"SELECT day || 'T09:00:00.000Z' AS lastRun, count(*) AS totalChecks, count(*) FILTER (cited) AS citations, (SELECT string_agg(platform || ':' || n || '/' || c, ',' ORDER BY platform) FROM (SELECT platform, count(*) AS n, count(*) FILTER (cited) AS c FROM {_LAST_DAY} GROUP BY platform)) AS platforms FROM {_LAST_DAY} GROUP BY day")
def mention_latest(t: Tables) -> DataFrame:
    found = monitor.latest_run(t.spark, _runs(t))
    if monitor.latest_run(t.spark, new_folder(t.spark, "none")) is not None:
        raise AssertionError("a run where there is none")
    shown = F.transform(F.array_sort(F.map_entries("platformBreakdown")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["checked"].cast("string"), F.lit("/"), e["value"]["cited"].cast("string")))
    return found.select("lastRun", "totalChecks", "citations", F.array_join(shown, ",").alias("platforms"))


_NAMED = "CASE platform WHEN 'perplexity' THEN 'Perplexity' ELSE 'Google AI Mode' END"


@query(f"""SELECT entity, platform, 'Citation Found! example.org was cited by ' || {_NAMED} || ' for ' || entityName AS said, '*Citation URL:*' || chr(10) || 'https://example.org/entities/' || entity AS url, '*Timestamp:*' || chr(10) || 'Mon, 05 Jan 2026 09:00:00 GMT' AS at, '*Answer Excerpt:*' || chr(10) || '>' || answer || '...' AS excerpt FROM ({_ASKED}) WHERE cited""")
def citation_alerts(t: Tables) -> DataFrame:
    found = monitor.citation_alerts(_results(t), "example.org")
    get = lambda path: F.get_json_object("payload", path)
    return found.select("entity", "platform", get("$.text").alias("said"), get("$.fields[2].text").alias("url"), get("$.fields[3].text").alias("at"), get("$.section.text").alias("excerpt"))


@query(f"""SELECT 'AI Monitoring Complete: ' || count(*) FILTER (cited) || '/' || count(*) || ' citations' AS text, CASE WHEN count(*) FILTER (cited) > 0 THEN 'Citations Found!' ELSE 'No Citations Yet' END AS status,
 (SELECT string_agg(CASE platform WHEN 'perplexity' THEN 'Perplexity' WHEN 'chatgpt' THEN 'ChatGPT' ELSE 'Google AI Mode' END || ': ' || c || '/' || n, ' | ' ORDER BY platform) FROM (SELECT platform, count(*) AS n, count(*) FILTER (cited) AS c FROM ({_ASKED}) GROUP BY platform)) AS platforms FROM ({_ASKED}) HAVING count(*) > 0""")
def summary_alert(t: Tables) -> DataFrame:
    return monitor.summary_alert(monitor.run_summary(_results(t), F.lit(_AT)))


@query(f"SELECT event_id, crawler FROM ({_VISITS}) WHERE crawler IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 5")
def visit_list_range(t: Tables) -> DataFrame:
    """A range of the visit list, whose values are JSON."""
    listed = _visits(t).select("ts", "event_id", F.to_json(F.struct("event_id", "crawler")).alias("value"))
    return visits.decoded(visits.list_range(listed, [F.desc("ts"), F.desc("event_id")], 5, 14), "event_id long, crawler string")


@query(f"""SELECT 'list' AS kind, event_id::VARCHAR AS item FROM (SELECT * FROM ({_VISITS}) WHERE crawler IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 3)
 UNION ALL SELECT 'hash', crawler || '=' || count(*) FROM ({_VISITS}) WHERE crawler IS NOT NULL GROUP BY crawler
 UNION ALL SELECT 'sorted set', day FROM (SELECT DISTINCT day FROM ({_CHECKS}) ORDER BY day DESC LIMIT 4 OFFSET 2) UNION ALL SELECT 'value', day || '=' || total_checks FROM ({_DAILY}) WHERE day = '2024-01-05'""")
def store_reads(t: Tables) -> DataFrame:
    """The reads of the visit store: a list's head, a hash, a range of a sorted set from its end, and a value by its key (and one that isn't there)."""
    row = lambda df, kind, item: df.select(F.lit(kind).alias("kind"), item.alias("item"))
    seen, days = _visits(t), _daily(t).select("day", "total_checks")
    out = row(visits.list_range(seen, [F.desc("ts"), F.desc("event_id")], 0, 2), "list", C("event_id").cast("string"))
    out = out.union(row(visits.counts(seen), "hash", F.concat(C("crawler"), F.lit("="), C("visits").cast("string"))))
    out = out.union(row(visits.score_range(days, F.to_timestamp("day"), 2, 5, reverse=True), "sorted set", C("day")))
    for day in ("2024-01-05", "1999-01-01"):
        out = out.union(row(visits.value_of(days, "day", day), "value", F.concat(C("day"), F.lit("="), C("total_checks").cast("string"))))
    return out


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::INT ELSE 50 END AS max_pages, 3 AS max_depth, CASE WHEN s_suppkey % 3 = 0 THEN 250 ELSE 1000 END AS delay_ms, 30000 AS timeout_ms, s_suppkey % 5 <> 0 AS respect_robots, CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS n_exclude FROM supplier")
def config_defaults(t: Tables) -> DataFrame:
    """A table of crawls: values that are null, and fields that it doesn't have, are the usual ones."""
    k = C("s_suppkey")
    given = t.supplier.select("s_suppkey", F.when(k % 2 == 0, k.cast("int")).alias("max_pages"), F.when(k % 3 == 0, 250).alias("delay_ms"), F.when(k % 5 == 0, False).alias("respect_robots"), F.when(k % 7 == 0, F.array(F.lit("/x/**"))).alias("exclude"))
    found = crawl.completed_configs(given)
    return found.select("s_suppkey", "max_pages", "max_depth", "delay_ms", "timeout_ms", "respect_robots", F.size("exclude").alias("n_exclude"))


@query("SELECT event_id, strftime(CASE WHEN ts <= m THEN m ELSE m + INTERVAL 7 DAY END, '%Y-%m-%d %H:%M') AS next_run FROM (SELECT event_id, ts, date_trunc('day', ts) + ((8 - dayofweek(ts)) % 7)::INT * INTERVAL 1 DAY + INTERVAL 9 HOUR AS m FROM events)")
def weekly_schedule(t: Tables) -> DataFrame:
    """Mondays at nine, UTC; a run starts a streaming query that takes what has arrived and ends."""
    return t.events.select("event_id", F.date_format(visits.next_run(C("ts").cast("timestamp")), "yyyy-MM-dd HH:mm").alias("next_run"))


# --- publishing ------------------------------------------------------------------------------------------------------


@query(f"SELECT p_partkey, '{{\"@context\":\"https://schema.org\",\"@type\":\"DefinedTerm\",\"@id\":\"{render.BASE}/topics/p' || p_partkey || '\",\"name\":\"' || p_name || '\",\"description\":\"' || p_brand || '\"}}' AS json FROM part")
def topic_jsonld(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", render.topic_json_ld(made.named("p", C("p_partkey")), C("p_name"), C("p_brand")).alias("json"))


@query(f"SELECT c_custkey, '<script type=\"application/ld+json\">{{\"@context\":\"https://schema.org\",\"@type\":\"WebSite\",\"@id\":\"{render.BASE}\",\"name\":\"' || c_name || '\",\"description\":\"' || c_mktsegment || '\",\"url\":\"{render.BASE}\",\"publisher\":{{\"@type\":\"Organization\",\"name\":\"' || c_name || '\"}}}}</script>' AS tag FROM customer")
def website_jsonld(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", render.script_tag(render.website_json_ld(C("c_name"), C("c_mktsegment"))).alias("tag"))


@query(f"""SELECT 0 AS place, '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>T</title><link>{render.BASE}</link><description>D</description><language>en-us</language><lastBuildDate>Thu, 01 Jan 2026 00:00:00 GMT</lastBuildDate><atom:link href="{render.BASE}/rss.xml" rel="self" type="application/rss+xml"/>' AS line
 UNION ALL SELECT 1, '<item><title>Order ' || o_orderkey || '</title><link>{render.BASE}/claims/' || o_orderkey || '</link><guid isPermaLink="true">{render.BASE}/claims/' || o_orderkey || '</guid><description>' || o_orderpriority || '</description><pubDate>' || strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><category>x</category></item>' FROM orders UNION ALL SELECT 2, '</channel></rss>'""")
def rss_document(t: Tables) -> DataFrame:
    item = render.rss_item(C("o_orderkey").cast("string"), made.named("Order ", C("o_orderkey")), C("o_orderpriority"), F.lit("x"), C("o_orderdate"))
    items = t.orders.select(F.struct(-F.unix_micros(C("o_orderdate").cast("timestamp")), "o_orderkey").alias("order"), item.alias("line"))
    return render.rss_document(t.spark, items, "T", "D", "Thu, 01 Jan 2026 00:00:00 GMT").orderBy("place", "order").select("place", "line")


@record_query(f"""SELECT 0 AS place, '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="{render.SITEMAP}"><url><loc>{render.BASE}/sources</loc><changefreq>daily</changefreq><priority>0.8</priority></url>' AS line
 UNION ALL SELECT 1, '<url><loc>{render.BASE}/sources/' || id || '</loc><lastmod>' || accessed || '</lastmod><changefreq>weekly</changefreq><priority>0.9</priority></url>' FROM source UNION ALL SELECT 2, '</urlset>'""")
def sitemap_document(t: Tables) -> DataFrame:
    entries = made.sources(t.supplier).select(C("id").alias("order"), C("id").alias("key"), C("accessDate").alias("modified"))
    return render.sitemap_document(t.spark, "sources", entries).orderBy("place", "order").select("place", "line")


_KINDS = "SELECT 'claims' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'entities', count(*) FROM customer UNION ALL SELECT 'sources', count(*) FROM supplier UNION ALL SELECT 'topics', count(*) FROM part"


@query(f"""SELECT 0 AS place, '<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="{render.SITEMAP}">' AS line
 UNION ALL SELECT 1, '<sitemap><loc>{render.BASE}/sitemaps/' || kind || CASE WHEN k = 0 THEN '' ELSE '-' || k END || '.xml</loc></sitemap>' FROM (SELECT kind, unnest(range((n + 99) // 100)) AS k FROM ({_KINDS})) UNION ALL SELECT 2, '</sitemapindex>'""")
def sitemap_index(t: Tables) -> DataFrame:
    """Sitemaps of at most a hundred entries each."""
    return render.sitemap_index_document(t.spark, views.counts(made.corpus(t)), 100).select("place", "line")


@query(f"""SELECT '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>T</title><link>{render.BASE}</link><description>D</description><language>en-us</language><lastBuildDate>Thu, 01 Jan 2026 00:00:00 GMT</lastBuildDate><atom:link href="{render.BASE}/rss.xml" rel="self" type="application/rss+xml"/>' || chr(10)
 || (SELECT string_agg('<item><title>Order ' || o_orderkey || '</title><link>{render.BASE}/claims/' || o_orderkey || '</link><guid isPermaLink="true">{render.BASE}/claims/' || o_orderkey || '</guid><description>' || o_orderpriority || '</description><pubDate>' || strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><category>x</category></item>' || chr(10), '' ORDER BY o_orderdate DESC, o_orderkey) FROM orders) || '</channel></rss>' || chr(10) AS body""")
def rss_file(t: Tables) -> DataFrame:
    """The feed as one file, written twice and read back."""
    item = render.rss_item(C("o_orderkey").cast("string"), made.named("Order ", C("o_orderkey")), C("o_orderpriority"), F.lit("x"), C("o_orderdate"))
    items = t.orders.select(F.struct(-F.unix_micros(C("o_orderdate").cast("timestamp")), "o_orderkey").alias("order"), item.alias("line"))
    path = f"{new_folder(t.spark, 'feeds')}/rss.xml"
    for rows in (items.limit(3), items):
        documents.write_document(render.rss_document(t.spark, rows, "T", "D", "Thu, 01 Jan 2026 00:00:00 GMT"), path)
    return documents.read_document(t.spark, path)


@query("SELECT chr(10) || '- ' || (SELECT count(*) FROM orders) || ' claims' || chr(10) || '- ' || (SELECT count(*) FROM customer) || ' entities' || chr(10) || '- ' || (SELECT count(*) FROM supplier) || ' sources' || chr(10) || '- ' || (SELECT count(*) FROM part) || ' topics' || chr(10) AS counted, '# corpus' AS head")
def llms_document(t: Tables) -> DataFrame:
    body = render.llms_text(views.counts(made.corpus(t)), "corpus", "sourced claims")
    return body.select(F.regexp_extract("body", r"## Content\n(\n(?:- \d+ \w+\n)+)", 1).alias("counted"), F.substring_index("body", "\n", 1).alias("head"))


@query("SELECT page_id, replace(url, 'http://', '') AS shown FROM (SELECT page_id, replace(url, 'https://', '') AS url FROM pages)")
def shown_urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", render.shown_url(C("url")).alias("shown"))
