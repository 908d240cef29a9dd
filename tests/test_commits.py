"""Drafts from reply to approved record, commits that fail on their way, and ids that clash."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import names
from quarry.operators import drafts, extraction
from quarry.sources import records
from quarry.sources.shared import exists, new_folder
from quarry.sources.store import RecordStore


def reply(**more):
    entity = {"name": "Acme Inc", "type": "organization", "description": "d", "confidence": "low", "officialSite": "https://acme.example", "parentEntity": "Big Corp"}
    claim = {"title": "t", "statement": "s", "quote": "q", "entityRole": "", "relatedEntities": ["Big Corp"], "confidence": "high"}
    return json.dumps({"entities": [entity | more.get("entity", {}), {"name": "Big Corp", "type": "organization", "description": "d", "confidence": "high"}], "claims": [claim | more.get("claim", {})], "sourceInfo": {"title": "T", "publisher": "P", "type": "webpage", "confidence": "medium"}})


def batch(spark, folder, name, answers):
    rows = spark.createDataFrame(answers, "url string, title string, answer string").withColumn("x", extraction.reply(F.col("answer")))
    aliases = names.alias_map(spark.createDataFrame([], "slug string, name string, ord int"))
    tables = extraction.draft_tables(rows, aliases, "2026-01-01", "m-1", "2026-01-01T00:00:00.000Z")
    manifest = spark.createDataFrame([("e.org", name, "m-1")], "domain string, crawlId string, model string")
    records.save_batch(tables, folder, name, manifest)
    return tables


def test_from_reply_to_approved_record(spark):
    folder, store = new_folder(spark, "drafts"), RecordStore(spark, new_folder(spark, "store"))
    batch(spark, folder, "b1", [("https://e.org/1", "one", reply()), ("https://e.org/2", "two", reply(entity={"confidence": "medium", "name": "ACME, Inc."})), ("https://e.org/3", "three", "no json")])
    made = {r["slug"]: r for r in records.read_batch(spark, folder, "b1", "entities").collect()}
    assert made["acme"]["_draft"].asDict() == {"confidence": "medium", "sourcePages": ["https://e.org/1", "https://e.org/2"], "notes": None, "model": "m-1", "extractedAt": "2026-01-01T00:00:00.000Z"}
    assert made["acme"]["name"] == "Acme Inc" and made["acme"]["links"]["officialSite"] == "https://acme.example" and made["big"]["links"] is None
    assert records.read_batch(spark, folder, "b1", "manifest").select("crawlId", "model", "n_entities", "n_sources", "n_claims").first() == ("b1", "m-1", 2, 2, 2)
    assert drafts.approve_batch(store, folder, "b1", "1")
    assert not exists(spark, f"{folder}/b1") and exists(spark, f"{folder}/.archive/b1_1")
    again = RecordStore(spark, store.folder)
    claims, sources = again.read("claims"), again.read("sources")
    assert "_draft" not in claims.columns and {r["id"] for r in sources.collect()} == {r["citations"][0]["sourceId"] for r in claims.collect()}
    assert {tuple(e["slug"] for e in r["entities"]) for r in claims.collect()} == {("acme", "big")}


def test_one_bad_record_keeps_a_batch_out_and_a_repeat_replaces(spark):
    folder, store = new_folder(spark, "drafts"), RecordStore(spark, new_folder(spark, "store"))
    batch(spark, folder, "b1", [("https://e.org/1", "one", reply())])
    assert drafts.approve_batch(store, folder, "b1", "1")
    before = store.folders()
    batch(spark, folder, "b2", [("https://e.org/1", "one", reply(claim={"statement": "new"})), ("https://e.org/2", "two", reply(entity={"officialSite": "nowhere"}))])
    errors = {r["slug"]: r["errors"] for r in drafts.check_batch(store, folder, "b2")["entities"].collect()}
    assert errors == {"acme": [], "big": []}  # the first page's entity stays
    batch(spark, folder, "b2", [("https://e.org/1", "one", reply(claim={"statement": "new"}, entity={"officialSite": "nowhere"}))])
    assert not drafts.approve_batch(store, folder, "b2", "1") and store.folders() == before and exists(spark, f"{folder}/b2")
    batch(spark, folder, "b2", [("https://e.org/1", "one", reply(claim={"statement": "new"}))])
    assert drafts.approve_batch(store, folder, "b2", "2")
    assert [r["statement"] for r in store.read("claims").collect()] == ["new"] and store.read("sources").count() == 1


def test_failures_on_the_way_leave_the_records_whole(spark, monkeypatch):
    folder, store = new_folder(spark, "drafts"), RecordStore(spark, new_folder(spark, "store"))
    batch(spark, folder, "b1", [("https://e.org/1", "one", reply())])
    drafts.approve_batch(store, folder, "b1", "1")
    batch(spark, folder, "b2", [("https://e.org/1", "one", reply(claim={"statement": "new"})), ("https://e.org/2", "two", reply())])
    before = store.folders()
    with monkeypatch.context() as m:
        m.setattr(RecordStore, "_point", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            drafts.approve_batch(store, folder, "b2", "1")
    assert store.folders() == before and [r["statement"] for r in RecordStore(spark, store.folder).read("claims").collect()] == ["s"]
    assert store.vacuum() == 3 and store.read("claims").count() == 1  # what the failed commit wrote
    with monkeypatch.context() as m:
        m.setattr(records, "archive_batch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            drafts.approve_batch(store, folder, "b2", "1")
    after = sorted(map(str, store.read("claims").collect()))
    assert drafts.approve_batch(store, folder, "b2", "1") and sorted(map(str, store.read("claims").collect())) == after and len(after) == 2


def test_dedup_replaces_the_tables_that_it_reads(spark):
    store = RecordStore(spark, new_folder(spark, "store"))
    entities = spark.createDataFrame([("a", "A", "v"), ("b", "B", None), ("v", "V", None), ("n", "N", None)], "slug string, name string, parentEntity string")
    claims = spark.createDataFrame([("c1", [("v", "subject"), ("a", "related"), ("w", "related")]), ("c2", [("b", "subject")])], "id string, entities array<struct<slug:string,role:string>>")
    store.commit({"entities": entities, "claims": claims})
    inventory = store.read("entities").select("slug", F.lit("x").alias("batch"), F.lit(1).alias("batch_ord"), F.lit("low").alias("confidence"), F.lit(1).alias("n_pages"), "parentEntity")
    moves, homes = spark.createDataFrame([("v", "w")], "variant string, canonical string"), spark.createDataFrame([], "slug string, home string")
    counts = drafts.dedup_store(store, inventory, moves, homes, F.col("slug") == "n")
    assert {r["action"]: r["n"] for r in counts.collect()} == {"merge": 1, "noise": 1, "keep": 2, "claims updated": 1}
    assert sorted((r["slug"], r["parentEntity"]) for r in store.read("entities").collect()) == [("a", "w"), ("b", None)]
    assert {r["id"]: [e["slug"] for e in r["entities"]] for r in store.read("claims").collect()} == {"c1": ["w", "a"], "c2": ["b"]}


def test_clashing_ids(spark):
    one_digit = lambda prefix, key: F.concat(F.lit(prefix), F.pmod(F.xxhash64(key), F.lit(12)).cast("string"))
    keys = spark.createDataFrame([(f"k{k % 9}",) for k in range(20)] + [(None,)], "key string").repartition(4)
    ids = {r["key"]: r["id"] for r in names.assigned_ids(keys, "x_", "key", make=one_digit).collect()}
    assert len(ids) == 9 == len(set(ids.values())) and ids == {r["key"]: r["id"] for r in names.assigned_ids(keys.repartition(1), "x_", "key", make=one_digit).collect()}
    plain = {r["key"]: r["id"] for r in keys.where("key IS NOT NULL").distinct().select("key", one_digit("x_", F.col("key")).alias("id")).collect()}
    assert len(set(plain.values())) < 9 and all(ids[min(j for j in plain if plain[j] == i)] == i for i in plain.values())
    taken = spark.createDataFrame([(plain["k3"], "other"), ("x_0.5", "k4")], "id string, key string")
    later = {r["key"]: r["id"] for r in names.assigned_ids(keys, "x_", "key", taken, one_digit).collect()}
    assert set(later) == set(ids) and later["k4"] == "x_0.5" and plain["k3"] not in later.values() and len(set(later.values())) == 9
    assert {r["key"]: r["id"] for r in names.assigned_ids(keys, "src_", "key").collect()} == {r["key"]: r["id"] for r in keys.where("key IS NOT NULL").distinct().select("key", names.short_id("src_", F.col("key")).alias("id")).collect()}


def test_replies_are_parsed_once(spark):
    replies = spark.createDataFrame([("https://e.org/1", reply()), ("https://e.org/2", "no json")], "url string, answer string").withColumn("x", extraction.reply(F.col("answer")))
    assert replies._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    aliases = names.alias_map(spark.createDataFrame([], "slug string, name string, ord int"))
    entities, claims = extraction.entity_drafts(replies, aliases), extraction.claim_drafts(replies, aliases, "2026-01-01")
    for found in (entities, claims):
        assert "from_json" not in found._jdf.queryExecution().optimizedPlan().toString()  # no use of x parses again
    assert entities.count() == 2 and claims.count() == 1


def test_keys_are_read_once_for_their_ids(spark):
    keys = spark.createDataFrame([(f"k{k}",) for k in range(20)], "key string")
    found = names.assigned_ids(keys, "x_", "key", make=lambda prefix, key: F.concat(F.lit(prefix), F.pmod(F.xxhash64(key), F.lit(1000)).cast("string")))
    assert "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()  # rounds read what is written, not the keys again
    assert found.select("id").distinct().count() == 20
