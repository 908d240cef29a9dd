"""From a crawled page to draft records: the prompt, the checked reply, and the drafts that it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import names, urls
from quarry.functions.text import let
from quarry.operators import drafts
from quarry.sources.records import ENTITY_TYPES, SCHEMAS, SOURCE_TYPES
from quarry.sources.shared import written

LEVELS = ["high", "medium", "low"]
#: Characters that a page must have, and that a prompt takes of it.
LEAST_TEXT, MOST_TEXT = 100, 8000
REPLY = (
    "entities array<struct<name:string,type:string,description:string,confidence:string,officialSite:string,parentEntity:string>>, "
    "claims array<struct<title:string,statement:string,quote:string,entityRole:string,relatedEntities:array<string>,confidence:string>>, "
    "sourceInfo struct<title:string,publisher:string,type:string,author:string,publishedDate:string,excerpt:string,confidence:string>"
)


def enough_text(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) >= LEAST_TEXT, F.lit(False))


def page_data(pages: DataFrame) -> DataFrame:
    """What the extraction reads of a crawled page: url, type, title, text, metadata, jsonLd, depth."""
    return pages.select("url", "type", F.col("metadata.title").alias("title"), "text", "metadata", "jsonLd", "depth")


def prompt(url: Column, title: Column, type_: Column, description: Column, text: Column, primary: str | None = None, publisher: str = "a corpus of sourced claims") -> Column:
    """The request for a page: what is asked, the page's facts, the first MOST_TEXT characters, and the shape of the reply."""
    focus = f'The primary entity is "{primary}". Look for claims about it.' if primary else "Look for all entities of the page."
    asked = (
        "\n\nReply with one JSON object in a ```json block with `entities` (name, type, description, confidence, officialSite, parentEntity: only an organization that owns this one), "
        "`claims` (title of at most 120 characters, statement of at most 240, quote of at most 300, entityRole, relatedEntities, confidence) and "
        "`sourceInfo` (title, publisher, type, author, publishedDate, excerpt, confidence). Confidence is high, medium or low. Give verifiable facts only; empty lists if there are none."
    )
    return F.concat(
        F.lit(f"Extract verifiable claims from the page below for {publisher}.\n\n{focus}\n\n- URL: "), url, F.lit("\n- Title: "), title, F.lit("\n- Page Type: "), type_,
        F.lit("\n- Description: "), F.coalesce(F.nullif(description, F.lit("")), F.lit("Not provided")), F.lit("\n\n"), F.left(text, F.lit(MOST_TEXT)), F.lit(asked),
    )


def reply(answer: Column) -> Column:
    """The checked reply of a model's answer: the first ```json block, else the whole text; null if any part breaks the schema, so one bad claim rejects the page.

    The parsed reply is bound to a variable: the checks name it more than twenty times, and each of these would parse the answer anew.
    """
    block = F.regexp_extract(answer, r"```json\s*([\s\S]*?)\s*```", 1)
    return let(F.from_json(F.coalesce(F.nullif(block, F.lit("")), answer), REPLY), _checked_reply)


def _checked_reply(x: Column) -> Column:
    some = lambda c: c.isNotNull()
    short = lambda c, n: F.length(c) <= n
    entity = lambda e: some(e["name"]) & e["type"].isin(ENTITY_TYPES) & some(e["description"]) & e["confidence"].isin(LEVELS)
    claim = lambda c: short(c["title"], 120) & short(c["statement"], 240) & F.coalesce(short(c["quote"], 300), F.lit(True)) & some(c["entityRole"]) & c["confidence"].isin(LEVELS)
    s = x["sourceInfo"]
    good = F.forall(x["entities"], lambda e: F.coalesce(entity(e), F.lit(False))) & F.forall(x["claims"], lambda c: F.coalesce(claim(c), F.lit(False)))
    return F.when(good & some(s["title"]) & some(s["publisher"]) & s["type"].isin(SOURCE_TYPES) & s["confidence"].isin(LEVELS), x)


def checked(replies: DataFrame) -> DataFrame:
    """The replies with a checked x, written: they are parsed and checked once, where a filter on x would be pushed down and parse them again for each of its uses."""
    return written(replies, "replies").where("x IS NOT NULL")


def entity_drafts(replies: DataFrame, aliases: DataFrame) -> DataFrame:
    """replies (url, x: checked reply): url, pos, slug, name, type, description, officialSite, parentEntity (of organizations only), confidence."""
    return _entity_drafts(checked(replies.select("url", "x")), aliases)


def _entity_drafts(replies: DataFrame, aliases: DataFrame) -> DataFrame:
    rows = replies.select("url", F.posexplode("x.entities").alias("pos", "e")).select("url", "pos", "e.*")
    own = names.resolve_names(rows, aliases).withColumnRenamed("resolved", "slug")
    parents = own.where("type = 'organization' AND parentEntity <> ''").select("url", "pos", F.col("parentEntity").alias("name"))
    found = names.resolve_names(parents, aliases).select("url", "pos", F.col("resolved").alias("parent"))
    kept = own.drop("parentEntity").join(found, ["url", "pos"], "left")
    return kept.select("url", "pos", "slug", "name", "type", "description", F.nullif("officialSite", F.lit("")).alias("officialSite"), F.col("parent").alias("parentEntity"), "confidence")


def source_drafts(replies: DataFrame, today: str) -> DataFrame:
    """replies (url, title, x): one source per page."""
    s, either = F.col("x.sourceInfo"), lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    return replies.select(
        names.short_id("src_", F.col("url")).alias("id"), either(s["title"], F.col("title")).alias("title"), either(s["publisher"], urls.host(F.col("url"))).alias("publisher"), "url",
        F.lit(today).alias("accessDate"), s["type"].alias("type"), s["author"].alias("author"), s["publishedDate"].alias("publishedDate"), s["excerpt"].alias("excerpt"), s["confidence"].alias("confidence"),
    )


def claim_drafts(replies: DataFrame, aliases: DataFrame, today: str, primary: str | None = None) -> DataFrame:
    """replies (url, x): a claim per row, with the primary entity first and then the related ones other than it, repeats kept."""
    return _claim_drafts(checked(replies.select("url", "x")), aliases, today, primary)


def _claim_drafts(replies: DataFrame, aliases: DataFrame, today: str, primary: str | None) -> DataFrame:
    rows = replies.select("url", F.posexplode("x.claims").alias("pos", "c"), F.get("x.entities", F.lit(0))["name"].alias("first_name"))
    rows = rows.withColumn("name", F.coalesce(F.lit(primary).cast("string"), "first_name"))
    rows = names.resolve_names(rows, aliases).withColumn("main", F.coalesce("resolved", F.lit("unknown")))
    related = rows.select("url", "pos", "main", F.posexplode("c.relatedEntities").alias("at", "name")).where("name IS NOT NULL")
    related = names.resolve_names(related, aliases).where("resolved <> main")
    refs = related.groupBy("url", "pos").agg(F.array_sort(F.collect_list(F.struct("at", F.col("resolved").alias("slug"))))["slug"].alias("others"))
    both = rows.select("url", "pos", "c", "main").join(refs, ["url", "pos"], "left")
    ref = lambda slug, role: F.struct(slug.alias("slug"), role.alias("role"))
    own = F.array(ref(F.col("main"), F.coalesce(F.nullif("c.entityRole", F.lit("")), F.lit("subject"))))
    others = F.transform(F.coalesce("others", F.array().cast("array<string>")), lambda s: ref(s, F.lit("related")))
    source = names.short_id("src_", F.col("url"))
    day = F.lit(today)
    return both.select(
        names.short_id("clm_", F.concat_ws("#", "url", F.col("pos").cast("string"))).alias("id"), "url", "pos", F.col("c.title").alias("title"), F.col("c.statement").alias("statement"), F.lit("asserted").alias("status"),
        F.concat(own, others).alias("entities"), F.array().cast("array<string>").alias("topics"), F.array(F.struct(source.alias("sourceId"), F.col("c.quote").alias("quote"))).alias("citations"),
        F.struct(F.lit("crawl").alias("author"), day.alias("createdAt"), day.alias("updatedAt")).alias("provenance"), F.lit(1).alias("version"),
        F.array(F.struct(F.lit(1).alias("version"), day.alias("date"), F.concat(F.lit("Auto-extracted from "), urls.host(F.col("url")), F.lit(" crawl")).alias("summary"))).alias("changelog"),
        F.col("c.confidence").alias("confidence"),
    )


def _as_declared(df: DataFrame, table: str) -> DataFrame:
    """df in the declared columns of a table, null where it has none, with _draft."""
    want = df.sparkSession.createDataFrame([], SCHEMAS[table]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want], "_draft")


def draft_tables(replies: DataFrame, aliases: DataFrame, today: str, model: str, at: str, primary: str | None = None, taken: DataFrame | None = None) -> dict[str, DataFrame]:
    """The draft records of a batch of replies (url, title, x), by table, each with `_draft`: confidence, the pages it comes from, the model and the time.

    An entity of several pages is the first page's, with the best confidence and all pages. Two keys that would share an id get two; taken (id, key) are the sources' ids
    (by URL) that are given already. Replies without a checked x give nothing.
    """
    good = checked(replies.select("url", "title", "x"))

    def draft(pages: Column) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(F.col("confidence"), pages.alias("sourcePages"), null.alias("notes"), F.lit(model).alias("model"), F.lit(at).alias("extractedAt"))

    rows = written(_entity_drafts(good, aliases).withColumn("place", F.struct("url", "pos")), "entity-drafts")
    merged = drafts.merge_entities(rows.select("slug", "name", "confidence", F.col("url").alias("page"), "place"), "place")
    facts = rows.groupBy("slug").agg(F.min_by(F.struct("type", "description", "officialSite", "parentEntity"), "place").alias("first"))
    links = F.when(F.col("first.officialSite").isNotNull(), F.struct(F.col("first.officialSite").alias("officialSite"), *[F.lit(None).cast("string").alias(c) for c in ("wikipedia", "linkedin", "twitter", "crunchbase")]))
    entities = merged.join(facts, "slug").select("slug", "name", F.col("first.type").alias("type"), F.col("first.description").alias("description"), links.alias("links"), F.col("first.parentEntity").alias("parentEntity"), draft(F.col("pages")).alias("_draft"))
    page = F.array("url")
    source_ids = names.assigned_ids(good.select("url"), "src_", "url", taken).select(F.col("key").alias("url"), F.col("id").alias("_id"))
    sources = source_drafts(good, today).groupBy("url").agg(F.first(F.struct("title", "publisher", "accessDate", "type", "author", "publishedDate", "excerpt", "confidence")).alias("s")).select("url", "s.*")
    sources = sources.join(source_ids, "url").withColumn("_draft", draft(page)).withColumnRenamed("_id", "id")
    claims = _claim_drafts(good, aliases, today, primary).withColumn("_key", F.concat_ws("#", "url", F.col("pos").cast("string")))
    claims = written(claims, "claim-drafts")
    claim_ids = names.assigned_ids(claims.select("_key"), "clm_", "_key").select(F.col("key").alias("_key"), F.col("id").alias("_own"))
    cited = F.transform("citations", lambda c: F.struct(F.col("_id").alias("sourceId"), F.lit(None).cast("string").alias("locator"), c["quote"].alias("quote"), F.lit(None).cast("string").alias("note")))
    claims = claims.drop("id").join(claim_ids, "_key").join(source_ids, "url").withColumn("citations", cited).withColumnRenamed("_own", "id").withColumn("_draft", draft(page))
    return {"entities": _as_declared(entities, "entities"), "sources": _as_declared(sources, "sources"), "claims": _as_declared(claims, "claims")}


def processing_stats(pages: DataFrame) -> DataFrame:
    """pages (text, x): pages in all, those that gave a reply, those skipped, and calls made (pages with enough text)."""
    done = F.count_if(F.col("x").isNotNull())
    return pages.agg(F.count(F.lit(1)).alias("total"), done.alias("processed"), (F.count(F.lit(1)) - done).alias("skipped"), F.count_if(enough_text(F.col("text"))).alias("calls"))


def tokens_used(responses: DataFrame, *by: str) -> DataFrame:
    """Input and output tokens summed over responses (input_tokens, output_tokens)."""
    return responses.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"))
