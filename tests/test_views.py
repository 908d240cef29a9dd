"""Views over a small corpus with unknown references, ties, versions and a hierarchy."""

import pytest

from quarry.operators import drafts
from quarry.plans import views
from quarry.sources.records import SCHEMAS


def claim(k, status, entities, topics, sources, updated, versions=1):
    return (f"clm_0000000{k}", f"Title {k}", f"Statement {k}", status, [(e, "subject") for e in entities], topics, [(s, None, "q", None) for s in sources], ("me", updated, updated), versions, [(v, f"2026-01-0{v}", "s") for v in range(1, versions + 1)])


@pytest.fixture(scope="module")
def corpus(spark):
    make = lambda rows, table: spark.createDataFrame(rows, SCHEMAS[table])
    claims = [
        claim(1, "disputed", ["a", "b"], ["t"], ["src_00000001"], "2026-01-01", 3),
        claim(2, "asserted", ["a", "a"], [], ["src_00000001", "src_00000009"], "2026-01-02"),
        claim(3, "asserted", ["nobody"], ["t", "u"], ["src_00000002"], "2026-01-02", 2),
    ]
    entities = [("a", "Beta", "organization", "d", None, None, None), ("b", "alpha", "person", "d", None, "a", None), ("c", "Gamma", "place", "d", None, "gone", None)]
    sources = [(f"src_0000000{k}", f"S{k}", "P", f"https://e.org/{k}", f"2026-01-0{k}", "webpage", None, None, None if k == 1 else "ex", None, None) for k in (1, 2)]
    return views.Corpus(make(claims, "claims"), make(entities, "entities"), make(sources, "sources"), make([("t", "Topic", "d"), ("v", "Other", "d")], "topics"))


def test_counts_and_indexes(corpus):
    assert {r["kind"]: r["n"] for r in views.counts(corpus).collect()} == {"claims": 3, "entities": 3, "sources": 2, "topics": 2}
    assert [(r["id"][-1], r["entities"]) for r in views.claims_index(corpus).collect()] == [("2", ["Beta", "Beta"]), ("3", ["nobody"]), ("1", ["Beta", "alpha"])]
    assert [(r["slug"], r["n_claims"]) for r in views.entities_index(corpus).collect()] == [("b", 1), ("a", 2), ("c", 0)]
    assert [(r["slug"], r["n_claims"]) for r in views.topics_index(corpus).collect()] == [("v", 0), ("t", 2)]
    assert [r["id"][-1] for r in views.sources_index(corpus).collect()] == ["2", "1"]


def test_details(corpus):
    assert [r["id"][-1] for r in views.entity_detail(corpus, "a").collect()] == ["2", "1"]
    assert [r["id"][-1] for r in views.topic_detail(corpus, "t").collect()] == ["3", "1"]
    detail = views.claim_detail(corpus, "clm_00000003").first()
    assert (detail["sources"], detail["topic_names"]) == (["S2"], ["Topic", "u"])
    source = views.source_detail(corpus, "src_00000001").first()
    assert (source["description"], [x[-1] for x in source["claims"]]) == ("Source from P", ["1", "2"])
    assert {r["slug"]: (r["parent_name"], r["subsidiaries"]) for r in views.entity_family(corpus).collect()} == {"a": (None, ["alpha"]), "b": ("Beta", []), "c": (None, [])}
    assert tuple(views.client_dashboard(corpus, "a").first()) == (2, 1, 2, 1, 1)


def test_logs_and_feeds(corpus):
    assert [(r["id"][-1], r["version"]) for r in views.corrections_log(corpus).collect()] == [("1", 3), ("1", 2), ("3", 2)]
    items = [r["item"] for r in views.feed_items(corpus).collect()]
    assert "<title>Title 2</title>" in items[0] and "Fri, 02 Jan 2026 00:00:00 GMT" in items[0]


def test_validation(corpus):
    found = {r["id"][-1]: r["errors"] for r in views.cross_reference_errors(corpus).collect()}
    assert found == {"2": ["Unknown source: src_00000009"], "3": ["Unknown entity: nobody", "Unknown topic: u"]}
    empty = views.Corpus(*(df.where("false") for df in (corpus.claims, corpus.entities, corpus.sources, corpus.topics)))
    problems = {r["id"][-1]: (r["errors"], r["warnings"]) for r in views.draft_reference_problems(corpus, empty).collect()}
    assert problems == {"1": ([], []), "2": (["src_00000009"], []), "3": ([], ["nobody"])}
    checked = drafts.check_rules(corpus.claims, drafts.claim_rules())
    assert all(r["errors"] == [] for r in checked.collect()) and drafts.all_or_nothing(checked).count() == 3
    bad = drafts.check_rules(corpus.claims.withColumn("status", views.F.lit("other")), drafts.claim_rules())
    assert all(r["errors"] == ["status"] for r in bad.collect()) and drafts.all_or_nothing(bad).count() == 0
