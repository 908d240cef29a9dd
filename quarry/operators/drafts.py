"""Merging, deduplicating and validating drafts. First wins is by an explicit order column, never by arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources import records
from quarry.sources.shared import written
from quarry.sources.store import RecordStore

CONFIDENCE = ["low", "medium", "high"]


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)


def merge_entities(rows: DataFrame, order: str) -> DataFrame:
    """rows: slug, name, confidence, page and an order. Per slug: the first name, the best confidence, the distinct pages in order.

    A page's place comes first, combined on the map side, so what meets for a slug is its distinct pages.
    """
    pages = rows.groupBy("slug", "page").agg(F.min(order).alias("place"), F.min_by("name", order).alias("name"), F.max(confidence_rank(F.col("confidence"))).alias("rank"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "page")))
    merged = pages.groupBy("slug").agg(F.min_by("name", "place").alias("name"), F.max("rank").alias("rank"), ordered.alias("pages"))
    return merged.select("slug", "name", F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("rank")).alias("confidence"), F.col("pages.page").alias("pages"))


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, combined on the map side."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("first"))
    return first.select(*[F.col(c) if c == key else F.col(f"first.{c}").alias(c) for c in rows.columns])


def best_versions(rows: DataFrame, slug: str = "slug") -> DataFrame:
    """rows: slug, batch_ord, is_home, rank, n_pages. The first home version, else the best confidence, then pages, then the first batch."""
    away = lambda c: F.when(F.col("is_home"), 0).otherwise(F.col(c))
    best = F.struct(F.col("is_home"), away("rank"), away("n_pages"), -F.col("batch_ord"))
    found = rows.groupBy(slug).agg(F.max_by(F.struct(*[c for c in rows.columns if c != slug]), best).alias("best"))
    return found.select(*[F.col(c) if c == slug else F.col(f"best.{c}").alias(c) for c in rows.columns])


def first_role_per_slug(refs: Column) -> Column:
    """Entity references (array of structs with slug) without later ones of a slug."""
    return F.filter(refs, lambda r, i: F.array_position(F.transform(refs, lambda x: x["slug"]), r["slug"]) == i + 1)


def remap(slugs: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Each key replaced by what moves (variant, canonical) says, one hop."""
    return slugs.join(moves.select(F.col("variant").alias(key), "canonical"), key, "left").withColumn(key, F.coalesce("canonical", key)).drop("canonical")


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `errors`: the names of the rules that a row breaks (a null result breaks it), in order."""
    named = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("errors", F.array_compact(F.array(*named)))


def all_or_nothing(df: DataFrame) -> DataFrame:
    """df if no row has errors, else no rows: one left-anti join against at most one row."""
    bad = df.where(F.size("errors") > 0).select(F.lit(1).alias("_bad")).limit(1)
    return df.withColumn("_bad", F.lit(1)).join(F.broadcast(bad), "_bad", "left_anti").drop("_bad")


def validate_drafts(df: DataFrame, rules: dict[str, Column], missing_sources: DataFrame | None = None, missing_entities: DataFrame | None = None, key: str = "id") -> DataFrame:
    """df (with _draft) with valid, errors and warnings: broken rules and unknown sources are errors, unknown entities and low confidence warnings.

    missing_*: (key, ref) of references that lead nowhere.
    """
    out = check_rules(df, rules).withColumn("warnings", F.array().cast("array<string>"))
    for missing, kind, into in ((missing_sources, "source", "errors"), (missing_entities, "entity", "warnings")):
        if missing is not None:
            said = missing.groupBy(key).agg(F.array_sort(F.collect_set(F.concat(F.lit(f"References unknown {kind}: "), F.col("ref")))).alias("_said"))
            out = out.join(said, key, "left").withColumn(into, F.concat(into, F.coalesce("_said", F.array().cast("array<string>")))).drop("_said")
    low = F.when(F.col("_draft.confidence") == "low", F.array(F.lit("Low confidence extraction"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("warnings", F.concat("warnings", low)).withColumn("valid", F.size("errors") == 0)


def check_batch(store: RecordStore, folder: str, batch: str) -> dict[str, DataFrame]:
    """The draft records of a batch by table, with valid, errors and warnings. Claims may cite and name what the store or the batch has."""
    spark = store.spark
    read = lambda table: records.read_batch(spark, folder, batch, table)
    known = lambda table: store.read(table, records.SCHEMAS[table]).select(F.col(records.KEYS[table]).alias("ref")).union(read(table).select(records.KEYS[table])).distinct()
    claims = read("claims")
    cited = claims.select("id", F.explode("citations.sourceId").alias("ref")).distinct()
    named = claims.select("id", F.explode("entities.slug").alias("ref")).distinct()
    return {
        "entities": validate_drafts(read("entities"), entity_rules()),
        "sources": validate_drafts(read("sources"), source_rules()),
        "claims": validate_drafts(claims, claim_rules(), cited.join(known("sources"), "ref", "left_anti"), named.join(known("entities"), "ref", "left_anti")),
    }


def approve_batch(store: RecordStore, folder: str, batch: str, at: str) -> bool:
    """Moves the records of a draft batch into the store, all of them or, if one breaks a rule, none.

    The new tables are committed at once, without draft fields, over the records of the same keys; then the batch is archived below folder. What fails before the commit changes nothing; what fails
    after it leaves a batch whose approval can be repeated, with the same result.
    """
    checked = check_batch(store, folder, batch)
    if any(not df.where("NOT valid").isEmpty() for df in checked.values()):
        return False
    new = {table: df.drop("valid", "errors", "warnings") for table, df in checked.items()}
    store.commit({table: records.approve(store.read(table, records.SCHEMAS[table]), df, records.KEYS[table]) for table, df in new.items()})
    records.archive_batch(store.spark, folder, batch, at)
    return True


def dedup_store(store: RecordStore, inventory: DataFrame, moves: DataFrame, homes: DataFrame, noise: Column) -> DataFrame:
    """A dedup run over the store's own entities and claims, committed at once; the run's counts.

    inventory: slug and what dedup_actions reads of each entity, in place of which the store's records of the slugs that stay are kept, with their parents moved.
    """
    entities, claims = store.read("entities"), store.read("claims")
    stay, moved, counts = dedup_run(inventory, claims, moves, homes, noise)
    kept = remap(entities.join(stay.select("slug").distinct(), "slug", "left_semi"), moves, "parentEntity").select(*entities.columns)
    counts = written(counts, "dedup-counts")  # of the tables before they are replaced
    store.commit({"entities": kept, "claims": moved.select(*claims.columns)})
    return counts


def strip_draft(df: DataFrame) -> DataFrame:
    return df.drop("_draft")


def crawl_id(domain: Column, run: Column) -> Column:
    """A batch's name; run begins with the domain already, so that it stands there twice."""
    return F.concat_ws("_", domain, run)


def dedup_actions(inventory: DataFrame, moves: DataFrame, homes: DataFrame, noise: Column) -> DataFrame:
    """What a dedup run does with each draft entity: inventory with `action` merge, duplicate, noise or keep.

    inventory: slug, batch, batch_ord (order of batches), confidence, n_pages, and what `noise` reads; moves: variant, canonical; homes: slug, home (a
    batch's beginning). Of a slug in several batches the home version stays, else the best; a slug is noise if its first batch's version is. Every step joins what
    was combined on the map side.
    """
    moved = moves.select(F.col("variant").alias("slug")).distinct().withColumn("_moved", F.lit(True))
    rows = inventory.join(F.broadcast(moved), "slug", "left").join(F.broadcast(homes.select("slug", "home")), "slug", "left")
    rows = rows.withColumn("is_home", F.coalesce(F.startswith("batch", "home"), F.lit(False))).withColumn("rank", confidence_rank(F.col("confidence"))).withColumn("_noise", F.coalesce(noise, F.lit(False)))
    kept = best_versions(rows.select("slug", "batch_ord", "is_home", "rank", "n_pages")).select("slug", F.col("batch_ord").alias("_kept"))
    first = rows.groupBy("slug").agg(F.min_by("_noise", "batch_ord").alias("_noisy"))
    both = rows.join(kept, "slug").join(first, "slug")
    action = F.when(F.col("_moved"), "merge").when(F.col("batch_ord") != F.col("_kept"), "duplicate").when(F.col("_noisy"), "noise").otherwise("keep")
    return both.withColumn("action", action).select(*inventory.columns, "action")


def dedup_run(inventory: DataFrame, claims: DataFrame, moves: DataFrame, homes: DataFrame, noise: Column, dry_run: bool = True, write=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities that stay (with their parents moved), claims with moved references, and the run's counts.

    claims: id, entities (array of structs with slug). With dry_run nothing is written; else write(name, frame) is called for entities and claims.
    """
    actions = dedup_actions(inventory, moves, homes, noise)
    stay = remap(actions.where("action = 'keep'"), F.broadcast(moves), "parentEntity")
    table = F.broadcast(moves.agg(F.map_from_entries(F.collect_list(F.struct("variant", "canonical"))).alias("_moves")))  # a configuration of a few rows
    move = lambda r: r.withField("slug", F.coalesce(F.try_element_at("_moves", r["slug"]), r["slug"]))
    moved = claims.join(table).withColumn("_new", F.transform("entities", move))
    moved = moved.withColumn("_new", first_role_per_slug(F.col("_new")))
    changed = ~F.col("_new").eqNullSafe(F.col("entities"))
    rewritten = moved.withColumn("updated", changed).withColumn("entities", F.col("_new")).drop("_new", "_moves")
    counts = actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).union(rewritten.where("updated").agg(F.lit("claims updated").alias("action"), F.count(F.lit(1)).alias("n")))
    if not dry_run:
        write("entities", stay.drop("action"))
        write("claims", rewritten.drop("updated"))
    return stay, rewritten, counts


def noise_report(actions: DataFrame, n: int = 30) -> DataFrame:
    """The first n slugs that go as noise."""
    return actions.where("action = 'noise'").select("slug").distinct().orderBy("slug").limit(n)


#: Rules of records, by table, as in the declared schemas.
DATE, SLUG, URL = r"^\d{4}-\d{2}-\d{2}\z", r"^[a-z0-9-]+\z", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"


def _within(c: Column, least: int, most: int | None = None) -> Column:
    return (F.length(c) >= least) & (F.length(c) <= most if most else F.lit(True))


def _absent_or(c: Column, ok: Column) -> Column:
    return c.isNull() | ok


def claim_rules() -> dict[str, Column]:
    c = F.col
    return {
        "id": c("id").rlike(r"^clm_[a-z0-9]{8}\z"),
        "title": _within(c("title"), 1, 120),
        "statement": _within(c("statement"), 1, 240),
        "status": c("status").isin(records.STATUSES),
        "entities": (F.size("entities") >= 1) & F.forall("entities", lambda e: e["slug"].rlike(SLUG)),
        "topics": F.forall("topics", lambda t: t.rlike(SLUG)),
        "citations": (F.size("citations") >= 1) & F.forall("citations", lambda x: F.coalesce(F.length(x["quote"]) <= 300, F.lit(True)) & x["sourceId"].rlike(r"^src_[a-z0-9]{8}\z")),
        "provenance": _within(c("provenance.author"), 1) & c("provenance.createdAt").rlike(DATE) & c("provenance.updatedAt").rlike(DATE),
        "version": c("version") > 0,
        "changelog": c("changelog").isNotNull(),
    }


def source_rules() -> dict[str, Column]:
    """For tables with only some of the columns: `some_source_rules`."""
    c = F.col
    return some_source_rules() | {
        "publisher": _within(c("publisher"), 1),
        "type": c("type").isin(records.SOURCE_TYPES),
        "snapshots": _absent_or(c("snapshots"), F.forall("snapshots", lambda x: x["timestamp"].isNotNull() & x["artifactPath"].isNotNull() & x["method"].isin(records.SNAPSHOT_METHODS))),
    }


def some_source_rules() -> dict[str, Column]:
    c = F.col
    return {
        "id": c("id").rlike(r"^src_[a-z0-9]{8}\z"),
        "title": F.length("title") >= 1,
        "url": c("url").rlike(URL),
        "accessDate": c("accessDate").rlike(DATE),
        "excerpt": F.coalesce(F.length("excerpt") <= 500, F.lit(True)),
    }


def entity_rules() -> dict[str, Column]:
    c = F.col
    sites = ("officialSite", "wikipedia", "linkedin", "twitter", "crunchbase")
    links = F.lit(True)
    for site in sites:
        links = links & _absent_or(c(f"links.{site}"), c(f"links.{site}").rlike(URL))
    return {
        "slug": c("slug").rlike(SLUG),
        "name": _within(c("name"), 1),
        "type": c("type").isin(records.ENTITY_TYPES),
        "description": _within(c("description"), 1),
        "links": links,
        "parentEntity": _absent_or(c("parentEntity"), c("parentEntity").rlike(SLUG)),
        "subsidiaries": _absent_or(c("subsidiaries"), F.forall("subsidiaries", lambda x: x.rlike(SLUG))),
    }


def topic_rules() -> dict[str, Column]:
    c = F.col
    return {"slug": c("slug").rlike(SLUG), "name": _within(c("name"), 1), "description": _within(c("description"), 1)}
