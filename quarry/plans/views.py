"""Composed views over a corpus of records (see sources.records for the schemas): what each page or feed reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import render, text
from quarry.operators import corpus, monitor
from quarry.sources import records

C = F.col
STATUS = ["asserted", "disputed", "corrected", "tombstoned"]


@dataclass
class Corpus:
    claims: DataFrame
    entities: DataFrame
    sources: DataFrame
    topics: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Corpus:
        return cls(*(records.scan(spark, folder, t) for t in ("claims", "entities", "sources", "topics")))

    def entity_refs(self) -> DataFrame:
        return self.claims.select(C("id").alias("claim"), F.posexplode("entities").alias("ord", "ref")).select("claim", "ord", C("ref.slug").alias("slug"), C("ref.role").alias("role"))

    def citations(self) -> DataFrame:
        return self.claims.select(C("id").alias("claim"), F.posexplode("citations").alias("ord", "c")).select("claim", "ord", C("c.sourceId").alias("id"), C("c.quote").alias("quote"))

    def by_status(self, claims: DataFrame) -> DataFrame:
        return claims.orderBy(corpus.status_rank(C("status"), STATUS), F.desc("provenance.updatedAt"), "id")


def counts(c: Corpus) -> DataFrame:
    one = lambda kind, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one("claims", c.claims).union(one("entities", c.entities)).union(one("sources", c.sources)).union(one("topics", c.topics))


def claims_index(c: Corpus) -> DataFrame:
    """id, title, status, names of the referred entities (a slug where there is no entity), newest first."""
    named = corpus.named(c.entity_refs(), c.entities, "slug", "name", "entity")
    per = named.groupBy("claim").agg(F.array_sort(F.collect_list(F.struct("ord", "entity")))["entity"].alias("entities"))
    rows = c.claims.select(C("id"), "title", "status", C("provenance.updatedAt").alias("updatedAt")).join(per, C("id") == C("claim"), "left").drop("claim")
    return rows.orderBy(F.desc("updatedAt"), "id")


def claim_detail(c: Corpus, key: str) -> DataFrame:
    """One claim with its citations' titles and topics' names."""
    claim = records.point(c.claims, "claims", key)
    cited = corpus.named(c.citations().where(C("claim") == key), c.sources, "id", "title", "source")
    topics = corpus.named(claim.select(C("id").alias("claim"), F.posexplode("topics").alias("ord", "slug")), c.topics, "slug", "name", "topic")
    titles = cited.groupBy("claim").agg(F.array_sort(F.collect_list(F.struct("ord", "source")))["source"].alias("sources"))
    names = topics.groupBy("claim").agg(F.array_sort(F.collect_list(F.struct("ord", "topic")))["topic"].alias("topic_names"))
    return claim.join(titles, C("id") == titles["claim"], "left").drop("claim").join(names, C("id") == names["claim"], "left").drop("claim")


def claim_page(c: Corpus, key: str) -> DataFrame:
    """claim_detail with the claim's JSON-LD; its sources are those that its citations name, once each, by id."""
    detail = claim_detail(c, key)
    cited = c.sources.join(c.citations().where(C("claim") == key).select("id"), "id", "left_semi").agg(F.array_sort(F.collect_list(F.struct("id", "title", "url", "publisher"))).alias("works"))
    made = render.claim_json_ld(C("id"), C("title"), C("statement"), C("status"), C("provenance.author"), C("provenance.createdAt"), C("provenance.updatedAt"), C("works"))
    return detail.join(cited).withColumn("json_ld", made).drop("works")  # one row each


def entities_index(c: Corpus) -> DataFrame:
    """slug, name, n_claims in the names' collation order; entities without claims have 0."""
    found = corpus.references_per_key(c.entities.select("slug", "name"), c.entity_refs(), "slug", "claim")
    return found.orderBy(F.collate("name", "UNICODE"), "slug")


def entity_detail(c: Corpus, slug: str) -> DataFrame:
    """The entity's claims by status, then newest."""
    return c.by_status(c.claims.where(F.exists("entities", lambda e: e["slug"] == slug)))


def entity_family(c: Corpus) -> DataFrame:
    """slug, parent_name (null for none or an unknown one), subsidiaries (names, an empty list for none)."""
    parents = c.entities.select(C("slug").alias("parentEntity"), C("name").alias("parent_name"))
    below = c.entities.where("parentEntity IS NOT NULL").groupBy(C("parentEntity").alias("slug")).agg(F.array_sort(F.collect_list("name")).alias("names"))
    rows = c.entities.join(parents, "parentEntity", "left").join(below, "slug", "left")
    return rows.select("slug", "parent_name", F.coalesce("names", F.array().cast("array<string>")).alias("subsidiaries"))


def entity_page(c: Corpus, slug: str) -> DataFrame:
    """One row: the entity with its number of claims, its family and its JSON-LD."""
    one = records.point(c.entities, "entities", slug)
    refs = lambda df: F.struct(df["slug"], df["name"], df["type"])
    above = c.entities.select(C("slug").alias("parentEntity"), refs(c.entities).alias("parent"))
    below = c.entities.where(C("parentEntity") == slug).agg(F.array_sort(F.collect_list(F.struct("slug", "name", "type"))).alias("children"))
    n = c.claims.where(F.exists("entities", lambda e: e["slug"] == slug)).agg(F.count(F.lit(1)).alias("n_claims"))
    links = F.array(*[C(f"links.{x}") for x in ("wikipedia", "linkedin", "twitter", "crunchbase")])
    rows = one.join(above, "parentEntity", "left").join(below).join(n)  # one row each
    made = render.entity_json_ld(C("slug"), C("name"), C("description"), C("type"), C("links.officialSite"), links, C("parent"), C("children"))
    return rows.select("slug", "name", "n_claims", C("parent.name").alias("parent_name"), C("children.name").alias("subsidiaries"), made.alias("json_ld"))


def client_claims(c: Corpus, slug: str) -> DataFrame:
    """The client's claims that are not asserted any more, or have a history: id, title, status, history (versions and dates where there is more than one)."""
    own = c.claims.where(F.exists("entities", lambda e: e["slug"] == slug))
    shown = F.when(F.size("changelog") > 1, F.transform("changelog", lambda x: F.concat(F.lit("v"), x["version"].cast("string"), F.lit(" "), x["date"])))
    return c.by_status(own.where((C("status") != "asserted") | (F.size("changelog") > 1))).select("id", "title", "status", shown.alias("history"))


def client_dashboard(c: Corpus, slug: str) -> DataFrame:
    """One row: claims, asserted, corrections, and distinct topics and sources that exist."""
    claims = c.claims.where(F.exists("entities", lambda e: e["slug"] == slug))
    topics = claims.select(F.explode("topics").alias("slug")).distinct().join(c.topics, "slug", "left_semi").agg(F.count(F.lit(1)).alias("topics"))
    sources = claims.select(F.explode("citations.sourceId").alias("id")).distinct().join(c.sources, "id", "left_semi").agg(F.count(F.lit(1)).alias("sources"))
    own = claims.agg(F.count(F.lit(1)).alias("claims"), F.count_if(C("status") == "asserted").alias("asserted"), F.coalesce(F.sum(F.size(F.filter("changelog", lambda x: x["version"] > 1))), F.lit(0)).alias("corrections"))
    return own.crossJoin(topics).crossJoin(sources)  # three rows of one


def topics_index(c: Corpus) -> DataFrame:
    refs = c.claims.select(C("id").alias("claim"), F.explode("topics").alias("slug"))
    return corpus.references_per_key(c.topics.select("slug", "name"), refs, "slug", "claim").orderBy(F.collate("name", "UNICODE"), "slug")


def topic_detail(c: Corpus, slug: str) -> DataFrame:
    return c.by_status(c.claims.where(F.array_contains("topics", slug)))


def topic_page(c: Corpus, slug: str) -> DataFrame:
    """One row: the topic with its number of claims and its JSON-LD."""
    n = c.claims.where(F.array_contains("topics", slug)).agg(F.count(F.lit(1)).alias("n_claims"))
    return records.point(c.topics, "topics", slug).join(n).select("slug", "name", "n_claims", render.topic_json_ld(C("slug"), C("name"), C("description")).alias("json_ld"))  # one row each


def source_snapshots(c: Corpus) -> DataFrame:
    """id, place, timestamp, artifactPath, method of every snapshot of every source."""
    return c.sources.select("id", F.posexplode("snapshots").alias("place", "s")).select("id", "place", "s.timestamp", "s.artifactPath", "s.method")


def source_page(c: Corpus, key: str) -> DataFrame:
    """source_detail with the source's JSON-LD."""
    made = render.source_json_ld(C("id"), C("title"), C("url"), C("accessDate"), C("publishedDate"), C("publisher"), C("type"), C("author"), C("excerpt"))
    return source_detail(c, key).withColumn("json_ld", made)


def stats(visits: DataFrame, crawlers: DataFrame, results: DataFrame | None, days: DataFrame, as_of, recent: int = 50, newest: int = 30) -> DataFrame:
    """section, item, shown: what the statistics page says.

    visits: crawler, ts, event_id; crawlers: name, ordinal (all that are known); results: the latest run's (None for none); days: the daily aggregates.
    """
    row = lambda df, section, item, shown: df.select(F.lit(section).alias("section"), item.alias("item"), shown.alias("shown"))
    totals = crawlers.join(visits.groupBy(C("crawler").alias("name")).agg(F.count(F.lit(1)).alias("n")), "name")
    out = row(totals, "crawler", C("name"), C("n").cast("string"))
    out = out.union(row(totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "visits", F.lit("total"), C("n").cast("string")))
    latest = visits.orderBy(F.desc("ts"), F.desc("event_id")).limit(recent)
    out = out.union(row(latest, "recent", F.concat(C("crawler"), F.lit("#"), C("event_id").cast("string")), render.relative_time(C("ts"), as_of)))
    first = days.where("citations > 0").orderBy("day").limit(1)
    out = out.union(row(first, "first citation", C("day"), F.array_join("cited_entities", ", ")))
    window = days.orderBy(F.desc("day")).limit(newest)
    out = out.union(row(window, "day", C("day"), F.concat(C("citations").cast("string"), F.lit("/"), C("total_checks").cast("string"))))
    out = out.union(row(window.agg(F.coalesce(F.sum("citations"), F.lit(0)).alias("c"), F.coalesce(F.sum("total_checks"), F.lit(0)).alias("n")), "days", F.lit("total"), F.concat(C("c").cast("string"), F.lit("/"), C("n").cast("string"))))
    if results is not None:
        name = render.choose(C("platform"), monitor.NAMES, C("platform"))
        per = monitor.platform_breakdown(results)
        out = out.union(row(per, "platform", name, F.concat(C("cited").cast("string"), F.lit("/"), C("checked").cast("string"))))
        out = out.union(row(results, "result", F.concat(C("entity"), F.lit("@"), name), F.concat(F.when(C("cited"), "Yes").otherwise("No"), F.lit(" "), text.truncated(C("answerExcerpt"), 100))))
    return out


def sources_index(c: Corpus) -> DataFrame:
    return c.sources.orderBy(F.desc("accessDate"), "id")


def source_detail(c: Corpus, key: str) -> DataFrame:
    """The source with its description (excerpt, or where it is from) and the claims that cite it."""
    source = records.point(c.sources, "sources", key)
    citing = c.claims.where(F.exists("citations", lambda x: x["sourceId"] == key)).agg(F.array_sort(F.collect_list("id")).alias("claims"))
    description = F.coalesce(F.nullif("excerpt", F.lit("")), F.concat(F.lit("Source from "), "publisher"))
    return source.withColumn("description", description).crossJoin(citing)  # one row each


def corrections_log(c: Corpus) -> DataFrame:
    log = c.claims.select(C("id"), "title", F.inline("changelog"))
    return corpus.corrections(log).orderBy(F.desc("date"), "id", "version")


def feed_items(c: Corpus, base: str = render.BASE) -> DataFrame:
    """RSS items, newest first."""
    updated = F.to_timestamp("provenance.updatedAt")
    item = render.rss_item(C("id"), C("title"), C("statement"), C("status"), updated, base)
    return c.claims.orderBy(F.desc("provenance.updatedAt"), "id").select("id", item.alias("item"))


def cross_reference_errors(c: Corpus) -> DataFrame:
    """id, errors: the claims that refer to entities, topics or sources that don't exist."""
    kinds = [
        ("entity", c.entity_refs().select("claim", C("slug").alias("k")), c.entities.select(C("slug").alias("k"))),
        ("topic", c.claims.select(C("id").alias("claim"), F.explode("topics").alias("k")), c.topics.select(C("slug").alias("k"))),
        ("source", c.citations().select("claim", C("id").alias("k")), c.sources.select(C("id").alias("k"))),
    ]
    found = None
    for name, refs, known in kinds:
        lost = corpus.missing_references(refs, [known], "k").select("claim", F.concat(F.lit(f"Unknown {name}: "), "k").alias("error"))
        found = lost if found is None else found.unionByName(lost)
    return found.groupBy(C("claim").alias("id")).agg(F.array_sort(F.collect_set("error")).alias("errors"))


def draft_reference_problems(drafts: Corpus, existing: Corpus) -> DataFrame:
    """id, errors, warnings of draft claims: unknown sources are errors, unknown entities warnings; topics are not looked at."""
    known_e = [existing.entities.select("slug"), drafts.entities.select("slug")]
    known_s = [existing.sources.select("id"), drafts.sources.select("id")]
    warnings = corpus.missing_references(drafts.entity_refs(), known_e, "slug").groupBy(C("claim").alias("id")).agg(F.array_sort(F.collect_set("slug")).alias("warnings"))
    errors = corpus.missing_references(drafts.citations(), known_s, "id").groupBy("claim").agg(F.array_sort(F.collect_set("id")).alias("errors")).withColumnRenamed("claim", "id")
    none = F.array().cast("array<string>")
    return drafts.claims.select("id").join(errors, "id", "left").join(warnings, "id", "left").select("id", F.coalesce("errors", none).alias("errors"), F.coalesce("warnings", none).alias("warnings"))
