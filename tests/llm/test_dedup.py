"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, connected_components, without_rows
from quarry.llm.exact_dedup import DigestIndex, buckets_for, drop_known, exact_duplicates, keep_one, memtables_for, sha256
from quarry.llm import jaccard_join
from quarry.llm.jaccard_join import jaccard_components, join_cells, keep_one_of_each, overlap_needed
from tests.llm.texts import SCHEMA, frame, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def weak(text):
    """Sixteen digests for all texts: they clash."""
    return F.unhex(F.concat(F.lit("0"), F.substring(F.md5(text.cast("binary")), 1, 1)))


@pytest.mark.parametrize("digest", [None, weak])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_duplicates(spark, digest, keep):
    data = rows() + rows()[:3]
    found = exact_duplicates(frame(spark, data), keep=keep, **({"digest": digest} if digest else {})).collect()
    groups = {}
    for d, t, *_ in data:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    want = Counter()
    for ids in groups.values():
        first = max(ids) if keep == "largest" else min(ids)
        want.update((d, first, len(ids), d == first) for d in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found) == want
    if not digest:
        by_id = {d: t for d, t, *_ in data}
        assert all(bytes(r["digest"]) == hashlib.sha256((by_id[r["doc_id"]] or "").translate(LOWER).encode()).digest() for r in found)


def test_exact_duplicates_null_ids_and_empty_table(spark):
    data = [(None, "a", *[None] * 5, 1), (None, "b", *[None] * 5, 1), (2, "A", *[None] * 5, 1)]
    found = sorted(((str(r["doc_id"]), r["keep_id"], r["kept"]) for r in exact_duplicates(frame(spark, data)).collect()), key=str)
    assert found == [("2", 2, True), ("None", 2, False), ("None", None, True)]
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one(spark):
    data = rows() + rows()[:3] + [(None, "only here", *[None] * 5, 1), (None, "only here", *[None] * 5, 1), (None, "ONE two", *[None] * 5, 1)]
    kept = keep_one(frame(spark, data))
    assert kept.columns == frame(spark).columns
    best = {}
    for d, t, *_ in data:
        key = (t or "").translate(LOWER)
        best[key] = max((x for x in (best.get(key), d) if x is not None), default=None)
    assert Counter((r["doc_id"], (r["text"] or "").translate(LOWER)) for r in kept.collect()) == Counter((d, t) for t, d in best.items())


CLASHING = "doc_id int, text string, _bucket string, _bit string, _null string, _may string, _map string, _id string, _digest string, digest string, bucket string, map string, kept string"


@pytest.mark.parametrize("keep", [keep_one, keep_one_of_each])
def test_stages_keep_int_ids_and_clashing_columns(spark, keep):
    texts = ["one two three four five six seven"] * 2 + ["other words stand in this text here", "x"]
    data = [(k + 1, t, *"abcdefghijk") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(data, CLASHING)
    left = keep(docs)
    assert left.schema == docs.schema
    assert sorted(map(tuple, left.collect())) == [r for r in data if r[0] != (1 if keep is keep_one else 2)]
    assert keep(docs.where("false")).count() == 0 and keep(docs.where("false")).columns == docs.columns


def test_index_levels_and_lookup(spark):
    """Runs are merged level by level, keep the smallest identifier, and answer through their filters; a stored index is opened again."""
    index = DigestIndex(spark, Scratch(spark, "index").path, buckets=3, fan=2)
    rnd, want, seen = random.Random(2), {}, Counter()
    for batch in range(5):
        rows_ = [(rnd.randint(0, 10**6), f"t{rnd.randint(0, 60)}") for _ in range(40)]
        log = spark.createDataFrame(rows_, "ident long, text string").select("ident", sha256(F.col("text")).alias("digest"))
        hits = {bytes(r["digest"]) for r in index.add(log).collect()}
        own = Counter(t for _, t in rows_)
        assert hits == {hashlib.sha256(t.encode()).digest() for t, n in own.items() if n > 1 or t in seen}
        seen.update(own)
        for k, t in rows_:
            want[t] = min(k, want.get(t, k))
    assert [r.level for r in index.runs] == [2, 0]  # 4 runs of level 0 and one more
    index.save()
    again = DigestIndex.opened(spark, index.folder)
    asked = spark.createDataFrame([("t1",), ("nowhere",), ("t2",)], "text string").select(sha256(F.col("text")).alias("digest"))
    assert {bytes(r["digest"]) for r in again.lookup(asked).collect()} == {hashlib.sha256(t.encode()).digest() for t in ("t1", "t2") if t in want}
    found = {bytes(r["digest"]): (r["ident"], r["copies"]) for r in again.entries().collect()}
    assert found == {hashlib.sha256(t.encode()).digest(): (k, seen[t]) for t, k in want.items()}


def test_a_merge_of_runs_shuffles_nothing(spark):
    index = DigestIndex(spark, Scratch(spark, "index").path, buckets=4, fan=9)
    for k in range(2):
        index.add(spark.range(2000).select(F.col("id").alias("ident"), sha256((F.col("id") + k).cast("string")).alias("digest")))
    from quarry.llm.exact_dedup import _joined

    plan = _joined(index.runs[0].entries, index.runs[1].entries)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_a_second_batch_against_a_stored_index(spark):
    index = DigestIndex(spark, Scratch(spark, "index").path)
    first = spark.createDataFrame([(1, "A b"), (2, None), (3, "c")], "doc_id int, text string")
    assert drop_known(first, index).count() == 3
    index.save()
    second = spark.createDataFrame([(4, "a B"), (5, ""), (6, "d"), (7, "C"), (8, "d")], "doc_id int, text string")
    assert sorted(r["doc_id"] for r in drop_known(second, DigestIndex.opened(spark, index.folder)).collect()) == [6, 8]


def test_an_index_has_as_many_buckets_and_memtables_as_its_rows_need(spark, monkeypatch):
    assert [buckets_for(n) for n in (0, 64_000_000, 64_000_001, 10**10, 10**13)] == [16, 16, 17, 2500, 100_000]
    assert [memtables_for(n) for n in (0, 1 << 32, (1 << 32) + 1)] == [4, 4, 5]
    made, files, original = [], [], DigestIndex.add

    def add(index, log):
        hits = original(index, log)
        made.append(index.buckets)
        files.append(len(index.runs[-1].entries.inputFiles()))
        return hits

    monkeypatch.setattr(DigestIndex, "add", add)
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('t', id % 2500) as text")
    want = {(k, max(x for x in range(k % 2500, 6000, 2500)), len(range(k % 2500, 6000, 2500))) for k in range(6000)}
    monkeypatch.setattr("quarry.llm.exact_dedup.buckets_for", lambda n: buckets_for(n, 300))
    monkeypatch.setattr("quarry.llm.exact_dedup.memtables_for", lambda n: memtables_for(n, 1200))
    found = exact_duplicates(docs).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in found} == want and len(found) == 6000
    assert made == [20] * 5 and set(files) == {20}


def test_a_call_leaves_no_table_and_merged_runs_are_deleted(spark):
    before = {r["tableName"] for r in spark.sql("SHOW TABLES").collect()}
    assert exact_duplicates(frame(spark, rows())).count() == len(rows())
    assert {r["tableName"] for r in spark.sql("SHOW TABLES").collect()} == before

    def folders(index):
        return {r["path"].split("/run-")[1].split("/")[0].removesuffix("-filter") for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{index.folder}").select("path").collect() if "/run-" in r["path"]}

    def log(k):
        return spark.range(30).select((F.col("id") + k).alias("ident"), sha256((F.col("id") + k).cast("string")).alias("digest"))

    index = DigestIndex(spark, Scratch(spark, "index").path, buckets=2, fan=2)
    index.add(log(0))
    index.add(log(20))
    assert folders(index) == {r.name[4:] for r in index.runs} and len(index.runs) == 1
    index.save()
    old = index.runs[0].name[4:]
    index.add(log(40))
    index.add(log(60))
    assert old in folders(index)  # the stored index still names it
    assert DigestIndex.opened(spark, index.folder).entries().count() == 50
    index.save()
    assert old not in folders(index)
    again = DigestIndex.opened(spark, index.folder)
    assert again.entries().count() == 90
    for x in (index, again):
        x.discard()


def test_exact_duplicates_runs_no_python(spark):
    plan = exact_duplicates(frame(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_without_rows(spark):
    gone = spark.createDataFrame([(1,), (4,)], "doc_id long")
    left = without_rows(frame(spark), gone, "doc_id")
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, *_ in rows() if d not in (1, 4))


def test_connected_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 430)] + [(500, 500)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    frame_ = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(Scratch(spark, "cc"), frame_, "cc").collect()}
    assert found == {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def brute(data, words=5, percent=75):
    sets = {}
    for d, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(n=260):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    base = [[rnd.choice(words) for _ in range(m)] for m in (3, 5, 8, 20, 60, 190, 300, 700)]
    data = [(0, None), (1, ""), (2, " \t\n"), (3, "a b c"), (4, "A B C"), (5, "a b c d"), (6, "a b")]
    for k in range(7, n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 10])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        if rnd.random() < 0.2:
            w = w[: int(len(w) * rnd.uniform(0.6, 1))]
        data.append((k, " ".join(w).upper() if rnd.random() < 0.2 else " ".join(w)))
    return data


@pytest.mark.parametrize("options", [{}, {"block_sets": 10}, {"few": 3, "block_sets": 7}, {"name_bits": 5, "few": 3}])
def test_jaccard_components(spark, options):
    data = near_copies()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, sid string, n int").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, **options).collect()}
    assert found == brute(data)


def test_jaccard_edge_rows(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, None)], "doc_id long, text string")
    found = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect())
    assert found == [("3", 2, 3), ("3", 2, 3), ("9", 0, 9), ("None", 2, 3)]
    assert sorted(r["doc_id"] for r in keep_one_of_each(docs.where("doc_id is not null").distinct()).collect()) == [3, 9]


def framed(n, own=8, frame=40):
    """Pages of one frame and a few words of their own; every 50th is a near copy of the one before."""
    rnd, shared = random.Random(n), [f"f{k}" for k in range(frame)]
    data, last = [], []
    for k in range(n):
        last = [*last[:-1], "changed"] if k % 50 == 49 else shared + [f"o{rnd.randrange(10**9)}" for _ in range(own)]
        data.append((k, " ".join(last)))
    return data


def test_pages_of_one_frame_are_not_candidates(spark, monkeypatch):
    """Each text meets others at most once, however many pages share the frame; only near copies meet."""
    sent, link_blocks = [], jaccard_join._link_blocks
    monkeypatch.setattr(jaccard_join, "_link_blocks", lambda rows, *rest: sent.append(rows.count()) or link_blocks(rows, *rest))
    data = framed(1200)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, few=20, block_sets=64).collect()}
    assert found == {k: (44, k - (k % 50 == 49)) for k, _ in data}
    assert sum(sent) == 2 * 1200 // 50


def test_pages_of_one_frame_with_various_parts_of_their_own(spark):
    rnd, data = random.Random(8), []
    for k in range(150):
        words = [f"f{j}" for j in range(rnd.choice([30, 30, 30, 28]))] + [f"o{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 16))]
        data.append((k, " ".join(words)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, few=5, block_sets=16).collect()}
    assert found == brute(data)


def test_join_cells_against_all_pairs():
    rnd = random.Random(4)
    for _ in range(200):
        cells = sorted({(n, n - rnd.randint(0, n // 4)) for n in (rnd.choice([rnd.randint(1, 12), rnd.randint(40, 60)]) for _ in range(rnd.randint(1, 12)))})
        links = jaccard_join.Links(len(cells))
        alive = set()
        for x, (n, r) in enumerate(cells):
            for y, (m, q) in enumerate(cells):
                if overlap_needed(n, m, 75) <= min(r, q):
                    links.join(x, y)
                    alive |= {x, y}
        found = join_cells(*np.array(cells).T, 75)
        assert found.tolist() == [links.find(k) if k in alive else -1 for k in range(len(cells))]
