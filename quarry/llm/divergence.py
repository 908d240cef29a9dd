"""Divergence of sources from each other and from their language, by sketch-prefiltered term counts.

A first pass counts in how many documents of its language each term occurs, in a count-min sketch: two rows of slots, of which a term's smaller count is
never too low. Tasks' sketches are merged by addition, and what the later passes get is one bit a slot: whether the count reaches the threshold. A second pass leaves out
impossible terms before anything is shuffled and counts the others exactly, by language, source and term; those of too few documents go then, by exact
counts. Sketch slots saturate and have a bounded number, so the sketch costs no more than its size; where a corpus has many more terms than slots, more impossible terms pass
and are dropped later.

The sum over all kept terms of a pair of sources is sparse: most terms occur in few sources, and a term that occurs in neither of two gives the same
summand f0. So the sum is V * f0, plus what each source's own terms change (by a histogram of their probabilities), plus a correction for terms that both have, which
is a join on the term. Values are integers throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, Sent, documents, quoted, text_slices

#: Sketch rows; slots in one written slice; bounds of a row's slots; tasks of the sketch pass for each core.
ROWS, SLICE, FEWEST, MOST, TASKS = 2, 1 << 18, 1 << 18, 1 << 26, 4
#: Bytes of text whose terms are told apart together.
TOGETHER = 1 << 23

_LOWER = np.zeros(256, np.uint8)
_LOWER[128:] = np.arange(128, 256)
for _lo in (0x41, 0x61):
    _LOWER[_lo : _lo + 26] = np.arange(0x61, 0x61 + 26)


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of all the texts, the number of each term in order, and the text that each is of.

    A term is a run of letters A-Z (lower-cased), a-z and characters beyond ASCII, whose bytes are all 128 or more.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    at = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    low = _LOWER[raw]
    inside = low > 0
    edge = np.zeros(len(raw) + 1, bool)  # a text begins here
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    end = np.flatnonzero(inside & (~after | edge[1:]))
    offsets = np.concatenate([[0], np.cumsum(end - start + 1)]).astype(np.int32)
    runs = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])])
    found = runs.dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64), np.searchsorted(at, start, "right") - 1


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (lang, source, text) joined to about TOGETHER bytes of text."""
    held, size = [], 0
    for b in text_slices(batches, 2, 1 << 16, TOGETHER):
        own = pc.sum(pc.binary_length(b.column(2))).as_py() or 0
        if held and size + own > TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += own
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _keys(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, values.cast(pa.binary()).to_pylist())), "<u8")


def _slots(term: np.ndarray, lang: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each (term, language), by their keys, in each row."""
    x = (term ^ (lang * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    shift = np.uint64(64 - slots.bit_length() + 1)
    return np.stack([(x >> shift).astype(np.int64), ((x * np.uint64(0xD6E8FEB86659FD93) ^ x) >> shift).astype(np.int64)])


class _Terms:
    """The (text, term) pairs of a batch, each once, with the number of occurrences."""

    def __init__(self, b: pa.RecordBatch):
        self.terms, number, of = split_terms(b.column(2))
        self.wide = max(1, len(self.terms))
        pair, self.n = np.unique(of * self.wide + number, return_counts=True)
        self.doc, self.term = pair // self.wide, pair % self.wide
        self.langs = b.column(0).dictionary_encode()
        self.lang = self.langs.indices.to_numpy().astype(np.int64)
        self.keys, self.lang_keys = _keys(self.terms), _keys(self.langs.dictionary)

    def slots(self, slots: int) -> np.ndarray:
        return _slots(self.keys[self.term], self.lang_keys[self.lang[self.doc]], slots)


def document_sketch(rows: DataFrame, least: int, slots: int) -> np.ndarray:
    """Bits, by row and slot: whether the slot's number of documents reaches `least`. rows: lang, source, text.

    A task's slots saturate at `least`, which a sum then reaches as well. Sketches are added group by group of tasks and slice by slice.
    """
    dtype = np.uint8 if least < 256 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(ROWS * slots, dtype)
        for b in _gathered(batches):
            at = _Terms(b).slots(slots)
            for row in range(ROWS):
                slot, n = np.unique(at[row], return_counts=True)
                slot += row * slots
                sketch[slot] = np.minimum(n + sketch[slot], least)
        for k in range(0, len(sketch), SLICE):
            if (part := sketch[k : k + SLICE]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["slice", "counts"])

    def add(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, total = None, np.zeros(0, np.int64)

            def out() -> pa.RecordBatch:
                raw = np.packbits(total >= least).tobytes() if last else zlib.compress(np.minimum(total, least).astype(dtype).tobytes(), 1)
                return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([raw], pa.binary())], ["slice", "counts"])

            for b in batches:
                for key, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if key != own:
                        if own is not None:
                            yield out()
                        own, total = key, np.zeros(SLICE, np.int64)
                    counts = np.frombuffer(zlib.decompress(raw.as_buffer()), dtype)
                    total[: len(counts)] += counts
            if own is not None:
                yield out()

        return run

    tasks = TASKS * rows.sparkSession.sparkContext.defaultParallelism  # a sketch for each of these, however many splits there are
    sketches = rows.coalesce(tasks).mapInArrow(count, "slice int, counts binary").withColumn("salt", F.spark_partition_id() % 32)
    some = sketches.repartition("salt", "slice").sortWithinPartitions("slice", "salt").select("slice", "counts").mapInArrow(add(False), "slice int, counts binary")
    bits = np.zeros(ROWS * slots // 8, np.uint8)
    for r in some.repartition("slice").sortWithinPartitions("slice").mapInArrow(add(True), "slice int, counts binary").collect():  # at most 16 MB
        bits[r["slice"] * SLICE // 8 :][: SLICE // 8] = np.frombuffer(r["counts"], np.uint8)
    return bits


def possible_counts(rows: DataFrame, bits: Sent, slots: int) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of the terms that the sketch lets pass; several rows a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bits.open()
        for b in _gathered(batches):
            t = _Terms(b)
            at = t.slots(slots)
            keep = np.ones(len(t.doc), bool)
            for row in range(ROWS):
                slot = at[row] + row * slots
                keep &= (seen[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
            sources = b.column(1).dictionary_encode()
            group = t.lang * len(sources.dictionary) + sources.indices.to_numpy()
            found, of = np.unique(group[t.doc[keep]] * t.wide + t.term[keep], return_inverse=True)
            n, docs = np.bincount(of, t.n[keep], len(found)).astype(np.int64), np.bincount(of, minlength=len(found))
            group, term = found // t.wide, found % t.wide
            lang, source = group // max(1, len(sources.dictionary)), group % max(1, len(sources.dictionary))
            for k in range(0, len(found), 1 << 15):
                own = slice(k, k + (1 << 15))
                columns = [t.langs.dictionary.take(pa.array(lang[own])), sources.dictionary.take(pa.array(source[own])), t.terms.take(pa.array(term[own])), pa.array(n[own]), pa.array(docs[own])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


SCALE = 1_000_000_000


def _probability(count: Column, all_: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / all), exact for every long; null where all is 0."""
    wide = F.expr(f"CAST({SCALE} AS DECIMAL(10,0))") * (count + 2).cast("decimal(20,0)")
    small = (count + 2) * F.lit(SCALE).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    return F.lit(1).cast("long") + F.when(all_ == 0, None).when(count < 9_000_000_000, div(small, all_)).otherwise(div(wide, all_.cast("decimal(20,0)")))


def _difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one (part `pair`) and its terms that stand out most in its language (part `term`).

    Kept terms of a language are those in at least `least` of its documents. Null text, language and source are read as ''. A group without kept terms has the
    probabilities of no counts; a language without kept terms has pairs of value 0. Each row is a document, repeated ones too; an empty table gives no rows; other columns are not looked at.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "divergence")
    text = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    slots = FEWEST
    n_docs = docs.count()
    while slots < min(16 * n_docs, MOST):
        slots *= 2
    bits = Sent(spark, document_sketch(rows, least, slots))
    counts = possible_counts(rows, bits, slots).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    exact = counts.select("*", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("lang_docs")).where(F.col("lang_docs") >= least)
    sparse = scratch.write(exact.select("lang", "source", "term", "n", "lang_n"), "sparse")
    bits.destroy()

    # totals: of each group N, of each language V and N
    totals = sparse.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = sparse.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("kept", zero).alias("kept"), (F.coalesce("total", zero) + 2 * F.coalesce("kept", zero)).alias("all"), (F.coalesce("lang_total", zero) + 2 * F.coalesce("kept", zero)).alias("lang_all"))
    groups = scratch.write(groups.withColumn("p0", _probability(zero, F.col("all"))), "groups")
    terms = sparse.join(groups, ["lang", "source"]).withColumn("p", _probability(F.col("n"), F.col("all")))
    terms = scratch.write(terms.select("lang", "source", "term", "p", "p0", _probability(F.col("lang_n"), F.col("lang_all")).alias("q")), "terms")

    # pairs: V * f0, each source's own terms, terms of both
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    histogram = terms.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    own = histogram.join(other, "lang").where("source <> item")
    own = own.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (_difference(F.col("p"), F.col("q0")) - _difference(F.col("p0"), F.col("q0")))).alias("change"))
    own = scratch.write(own, "own")
    a, b = terms.select("lang", "term", "source", "p", "p0"), terms.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q, p0, q0 = map(F.col, ("p", "q", "p0", "q0"))
    shared = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(_difference(p, q) - _difference(p, q0) - _difference(p0, q) + _difference(p0, q0)).alias("change"))
    shared = scratch.write(shared, "shared")
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "change")
    changes = own.unionByName(turned(own)).unionByName(shared).unionByName(turned(shared))
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("kept") * F.coalesce(_difference(p0, q0), zero)).alias("change"))
    pairs = base.unionByName(changes).groupBy("lang", "source", "item").agg(F.sum("change").alias("value"))
    standing_out = terms.where("p > q").select("lang", "source", F.col("term").alias("item"), _difference(p, q).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    return out(pairs, "pair").unionByName(out(standing_out, "term").where(F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


OP12_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), occurrences AS (
    SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (
    SELECT lang, term FROM occurrences GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM occurrences JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), totals AS (
    SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM counts GROUP BY lang, source
), lang_totals AS (
    SELECT lang, CAST(sum(total) AS HUGEINT) AS total FROM totals GROUP BY lang
), p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2)) // (coalesce(t.total, 0) + 2 * s.v) AS p
    FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
    SELECT lang, term, 1 + (1000000000 * (CAST(sum(n) AS HUGEINT) + 2)) // (any_value(lt.total) + 2 * any_value(s.v)) AS q
    FROM counts JOIN sizes s USING (lang) JOIN lang_totals lt USING (lang) GROUP BY lang, term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
    SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms
QUALIFY rank <= 10
"""
