"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index.

Terms are all words of the examples and their beginnings, and one term for the words of a text without any of them. Document
frequencies are counted over all documents. A term's weight is its TF-IDF times log2(2 + how many times more often examples of
label 1 have it than those of label 0), smoothed: terms that go with the label weigh more, and none is left out. Examples with
equal vectors are one entry of the index with the sum of their votes; entries that share common terms stand together. A
text adds up its rare terms' postings, bounds each block of entries by the largest such sum in it and the largest weights of the
common terms there, visits blocks from the highest bound down and stops at the first whose bound is below the k-th best
similarity: the k neighbours are exact. Texts visit in batches, so that those that need a block share one product. The nearest k votes are weighted by 1 / (distance + 0.02) and calibrated by isotonic
regression of the examples' own votes, each without itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, Sent, packed, sum_slices, text_slices, trim, unpacked

BLOCK, OTHER = 64, 0
_POSTING = np.dtype([("at", "<i4"), ("v", "<f4")])
#: Terms that most examples have: a block holds their weights as a matrix of those that it has; those of all other terms are postings.
#: Entries are put together by the first `PIVOTAL` of them.
COMMON, PIVOTAL = 4096, 1024
#: Texts that visit the index together, and texts that are split into words at once.
BATCH, ROWS = 256, 1024
#: Texts whose rare terms are summed at once.
RARE = 64
#: Blocks of highest bound that a text visits before its other blocks are pruned.
FIRST = 4
#: Terms in one slice of the document frequencies; bytes in one piece of a packed model.
SLICE, PIECE = 1 << 16, 1 << 18
#: Pieces in one file; the driver takes a few files at a time.
PER_FILE = 8
#: Examples by which each term's frequency in a label is smoothed.
SMOOTH = 4.0
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’…"


#: A word's terms are itself and its beginnings of these lengths.
BEGINNINGS = (4, 6)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words in lower case of all the texts, the number of each word in order, and the text of each; null is empty. Arrow's kernels do it all."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
    of = pc.list_parent_indices(lists)
    words = pc.list_flatten(lists)
    some = pc.greater(pc.binary_length(words), 0)
    words = words.filter(some).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), of.filter(some).to_numpy().astype(np.int64)


def word_terms(words: pa.Array) -> list[pa.Array]:
    """For each kind of term (the word itself, its beginnings) the term of each word; null where it is too short to have one."""
    bare = pc.utf8_trim(words, characters=_STRIP)
    size = pc.utf8_length(bare)
    none = pa.scalar(None, bare.type)
    return [pc.if_else(pc.greater(size, n), pc.utf8_slice_codeunits(bare, 0, n) if n else bare, none) for n in (0, *BEGINNINGS)]


def distinct_terms(texts: pa.Array) -> list[pa.Array]:
    return [pc.unique(pc.drop_null(x)) for x in word_terms(split_words(texts)[0])]


class TermCounter:
    """Numbers and counts of the known terms in texts; term 0 counts the words without any. terms: the known ones of each kind, numbered on from 1."""

    def __init__(self, terms: list[pa.Array]):
        self.terms, self.first = terms, np.cumsum([1, *map(len, terms)]).tolist()
        self.width = self.first[-1]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Term numbers, ascending within a text, their counts, and where each text's begin (and the last one's end)."""
        words, at, of = split_words(texts)
        found = [pc.fill_null(pc.index_in(x, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(known) else np.full(len(words), -1) for x, known in zip(word_terms(words), self.terms, strict=True)]
        numbers = np.stack([np.where(x >= 0, x + first, -1) for x, first in zip(found, self.first, strict=False)], 1)
        numbers[(numbers < 0).all(1), 0] = OTHER
        keys = (of[:, None] * self.width + numbers[at])[numbers[at] >= 0]
        keys, counts = np.unique(keys, return_counts=True)
        text, ids = np.divmod(keys, self.width)
        return ids, counts, np.searchsorted(text, np.arange(len(texts) + 1))

    def counts(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        ids, counts, cut = self.flat(texts)
        return [(ids[lo:hi], counts[lo:hi]) for lo, hi in zip(cut.tolist(), cut.tolist()[1:], strict=False)]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the pools' first and last x, ascending, and their means; between pools, interpolate."""
    pools: list[list[float]] = []  # first x, last x, weight, weighted sum
    for k in np.argsort(x, kind="stable"):
        if pools and pools[-1][1] == x[k]:
            pools[-1][2] += w[k]
            pools[-1][3] += w[k] * y[k]
        else:
            pools.append([x[k], x[k], w[k], w[k] * y[k]])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, last, b, c = pools.pop()
            pools[-1][1] = last
            pools[-1][2] += b
            pools[-1][3] += c
    return np.array([v for p in pools for v in p[:2]]), np.array([p[3] / p[2] for p in pools for _ in (0, 1)])


Counts = tuple[np.ndarray, np.ndarray]


class NeighbourModel:
    """terms (as of TermCounter); idf (times any weight of their own) by term number; examples as (doc_id, label, weight, (terms, counts))."""

    def __init__(self, terms: list[pa.Array], idf: np.ndarray, examples: list[tuple], k: int):
        self.terms, self.idf, self.k = terms, idf, k
        entries: dict[bytes, list] = {}
        for (doc_id, label, weight, _), (ids, v) in zip(examples, self.weights([e[3] for e in examples]), strict=True):
            entry = entries.setdefault(self._key(ids, v), [ids, v.astype(np.float32), 0.0, 0.0, doc_id, label])
            entry[2 + label] += weight
        own, n, keys = list(entries.values()), len(entries), list(entries)
        entries.clear()
        at = np.repeat(np.arange(n, dtype=np.int32), [len(e[0]) for e in own])
        ids = np.concatenate([e[0] for e in own]) if own else np.zeros(0, np.int32)
        v = np.concatenate([e[1] for e in own]) if own else np.zeros(0, np.float32)
        held = np.bincount(ids, minlength=len(idf))
        rank = np.full(len(idf), len(idf), np.int32)
        rank[np.argsort(-held, kind="stable")] = np.arange(len(idf), dtype=np.int32)
        self.column = np.where(rank < COMMON, rank, -1)  # of the matrices, for common terms
        self.n_blocks, self.width = -(-n // BLOCK), min(COMMON, len(idf))
        place = self._together(at, rank[ids], v, n, min(PIVOTAL, len(idf)))
        own, at = [own[i][2:] for i in np.argsort(place)], place[at]
        self.votes = np.array([[e[0], e[1]] for e in own]).reshape(-1, 2)
        self.names = [(e[2], e[3]) for e in own]
        self.index = dict(zip(keys, place.tolist(), strict=True))
        in_matrix = self.column[ids] >= 0
        self.cells = (at[in_matrix].astype(np.int32), self.column[ids[in_matrix]].astype(np.int16), v[in_matrix])
        rare = np.flatnonzero(~in_matrix)
        rare = rare[np.lexsort((at[rare], ids[rare]))]
        self.rare = np.empty(len(rare), _POSTING)
        self.rare["at"], self.rare["v"] = at[rare], v[rare]
        self.cut = np.searchsorted(ids[rare], np.arange(len(idf) + 1)).astype(np.int32)
        self._spread()
        total = self.votes.sum(0) if n else np.zeros(2)
        self.prior = float(total[1] / total.sum()) if total.sum() else 0.0
        self.steps, self.means = np.zeros(1), np.full(1, self.prior)
        if examples:
            raw = [x[0] for x in self.votes_of([e[3] for e in examples], [(e[1], e[2]) for e in examples])]
            self.steps, self.means = isotonic(np.array(raw), np.array([float(e[1]) for e in examples]), np.array([e[2] for e in examples]))
        self.index = {}  # only for the examples' own votes

    def _spread(self) -> None:
        """Each block's common terms and their weights (entry x term), and the largest weight of each term in each block."""
        at, column, v = self.cells
        order = np.argsort(at // BLOCK, kind="stable")
        at, column, v = at[order], column[order], v[order]
        cut = np.searchsorted(at // BLOCK, np.arange(self.n_blocks + 1)).tolist()
        self.blocks, self.best = [], np.zeros((self.width, self.n_blocks), np.float32)
        for b, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
            terms, place = np.unique(column[lo:hi], return_inverse=True)
            weights = np.zeros((BLOCK, len(terms)), np.float32)
            weights[at[lo:hi] % BLOCK, place] = v[lo:hi]
            self.blocks.append((terms.astype(np.int64), weights))
            self.best[terms, b] = weights.max(0, initial=0)
        self.visited = self.met = 0  # blocks whose entries were compared, of all blocks that texts met

    def __getstate__(self) -> dict:
        return self.__dict__ | {"blocks": None, "best": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._spread()

    @staticmethod
    def _key(ids: np.ndarray, v: np.ndarray) -> bytes:
        return blake2b(ids.astype("<i4").tobytes() + np.round(v, 6).tobytes(), digest_size=16).digest()

    @staticmethod
    def _together(at: np.ndarray, column: np.ndarray, v: np.ndarray, n: int, width: int) -> np.ndarray:
        """A place for each entry: those next to the same pivot by the most common terms stand together, so that blocks have tight bounds."""
        matrix, own = np.zeros((n, width), np.float32), column < width
        matrix[at[own], column[own]] = v[own]
        pivots = matrix[:: max(1, int(np.sqrt(n)))]
        near = matrix @ pivots.T
        first = near.argmax(1) if n else np.zeros(0, np.int64)
        place = np.zeros(n, np.int32)
        if n:
            place[np.lexsort((-near.max(1), first, (pivots @ matrix.mean(0))[first]))] = np.arange(n)
        return place

    @property
    def postings(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Entries and weights by term."""
        at, column, v = self.cells
        out = {int(t): (at[column == c], v[column == c]) for t, c in enumerate(self.column) if c >= 0 and (column == c).any()}
        out |= {int(t): (self.rare["at"][lo:hi], self.rare["v"][lo:hi]) for t, (lo, hi) in enumerate(zip(self.cut, self.cut[1:], strict=False)) if lo < hi}
        return out

    def weights(self, counts: list[Counts]) -> list[Counts]:
        """Terms and their weights of norm 1, for each text."""
        out = []
        for ids, n in counts:
            w = (1 + np.log(n)) * self.idf[ids]
            norm = np.sqrt((w * w).sum())
            out.append((ids, w / norm) if norm else (ids[:0], w[:0]))
        return out

    def nearest(self, vectors: list[Counts]) -> list[Counts]:
        """For each vector the k entries of largest cosine, and the cosines, in single precision and rounded to six decimals; of equal ones the first in the index."""
        if not self.n_blocks:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        out: list = [None] * len(vectors)
        for lo in range(0, len(vectors), 4 * BATCH):
            some = vectors[lo : lo + 4 * BATCH]
            ids, q, of = (np.concatenate(x) for x in zip(*((v[0], v[1], np.full(len(v[0]), k)) for k, v in enumerate(some)), strict=True))
            common, own = np.zeros((len(some), self.width), np.float32), self.column[ids] >= 0
            common[of[own], self.column[ids[own]]] = q[own]
            near = np.argsort((common @ self.best).argmax(1), kind="stable")  # texts that need the same blocks visit together
            for k in range(0, len(some), BATCH):
                pick = near[k : k + BATCH]
                for i, found in zip(pick.tolist(), self._nearest([some[i] for i in pick.tolist()]), strict=True):
                    out[lo + i] = found
        return out

    def _nearest(self, vectors: list[Counts]) -> list[Counts]:
        m, n = len(vectors), self.n_blocks * BLOCK
        size = [len(v[0]) for v in vectors]
        ids, q, of = np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors]), np.repeat(np.arange(m), size)
        column = self.column[ids]
        own = column >= 0
        common = np.zeros((self.width, m), np.float32)
        common[column[own], of[own]] = q[own]
        part = np.concatenate([self._rare(ids[cut], q[cut].astype(np.float32), of[cut] - lo, min(RARE, m - lo)) for lo in range(0, m, RARE) for cut in [~own & (of >= lo) & (of < lo + RARE)]])
        bounds = part.max(2) + common.T @ self.best
        order = np.argsort(-bounds, axis=1, kind="stable")
        falling = np.take_along_axis(bounds, order, 1)
        scores = np.full((m, self.n_blocks, BLOCK), -np.inf, np.float32)
        floor, row = np.full(m, -1.0), np.arange(m)[:, None]
        for done, stop in ((0, FIRST), (FIRST, self.n_blocks)):
            text, rank = np.nonzero(falling[:, done:stop] >= floor[:, None])  # blocks whose bound reaches the k-th best so far
            block = order[text, done + rank]
            by = np.argsort(block, kind="stable")
            text, block = text[by], block[by]
            cut = [*np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist(), len(block)] if len(block) else []
            for lo, hi in zip(cut, cut[1:], strict=False):
                b, some = int(block[lo]), text[lo:hi]
                terms, weights = self.blocks[b]
                own = common.take(terms, 0)
                many = 4 * len(some) > 3 * m
                scores[some, b] = part[some, b] + (weights @ (own if many else own.take(some, 1))).T[some if many else slice(None)]
            self.visited += len(text)
            scores.reshape(m, -1)[:, len(self.names) :] = -np.inf
            if done == 0 and (seen := scores[row, order[:, :stop]].reshape(m, -1)).shape[1] >= self.k:
                floor = np.maximum(np.partition(seen, -self.k, 1)[:, -self.k], -1.0) - 1e-5  # single precision errs by less
        self.met += m * self.n_blocks
        out = []
        for k, flat in enumerate(scores.reshape(m, -1)):
            near = np.flatnonzero(flat >= floor[k])
            sims = np.round(flat[near], 6)
            top = np.lexsort((near, -sims))[: self.k]
            out.append((near[top], sims[top]))
        return out

    def _rare(self, ids: np.ndarray, q: np.ndarray, of: np.ndarray, m: int) -> np.ndarray:
        """Sums of the rare terms' postings, by text, block and entry."""
        n, low = self.n_blocks * BLOCK, self.cut[ids].astype(np.int64)
        times = self.cut[ids + 1] - low
        pick = np.repeat(low - np.cumsum(times) + times, times)
        pick += np.arange(len(pick))
        posting = self.rare.view("<i8").take(pick, mode="clip").view(_POSTING)
        np.add(posting["at"], np.repeat(of * n, times), out=pick)
        return np.bincount(pick, posting["v"] * np.repeat(q, times), m * n).astype(np.float32).reshape(m, self.n_blocks, BLOCK)

    def votes_of(self, counts: list[Counts], without: list[tuple[int, float]] | None = None) -> list[tuple[float, list]]:
        """For each text the share of the distance-weighted votes for label 1, and the three nearest entries as evidence."""
        vectors, out = self.weights(counts), []
        for i, (vector, (ids, sims)) in enumerate(zip(vectors, self.nearest(vectors), strict=True)):
            ids, sims = ids[sims > 0], sims[sims > 0]
            if not len(ids):
                out.append((self.prior, []))
                continue
            votes = self.votes[ids]
            if without and (own := self.index.get(self._key(*vector))) is not None:
                votes[ids == own, without[i][0]] -= without[i][1]
            votes = np.maximum(votes, 0)
            each = votes.sum(1)
            room = np.clip(self.k - (np.cumsum(each) - each), 0, each)  # the k nearest votes; the last entry counts in part
            weighted = votes * (room / np.maximum(each, 1e-12) / (1.02 - np.minimum(sims, 1.0)))[:, None]
            total = weighted.sum()
            evidence = [(*self.names[e], float(s)) for e, s in zip(ids[:3].tolist(), sims[:3].tolist(), strict=True)]
            out.append(((float(weighted[:, 1].sum() / total) if total > 0 else self.prior), evidence))
        return out

    def scores(self, counts: list[Counts]) -> list[tuple[float, list]]:
        """Calibrated score and evidence of each text; a text without neighbours gets the examples' share of label 1 as it is."""
        return [(float(np.clip(np.interp(raw, self.steps, self.means), 0.0, 1.0)) if evidence else raw, evidence) for raw, evidence in self.votes_of(counts)]


def leaning(labels: list[int], counts: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> np.ndarray:
    """By term, log2(2 + r) with r the smoothed ratio of its frequency in examples of label 1 to that in those of label 0.

    Examples with the same counts are one. Without both labels there is no ratio and every term has the same weight.
    """
    seen, n, known = np.zeros((2, n_terms)), np.zeros(2), set()
    for label, (ids, times) in zip(labels, counts, strict=True):
        if (key := (label, ids.tobytes(), times.tobytes())) not in known:
            known.add(key)
            seen[label, ids] += 1
            n[label] += 1
    if not n.all():
        return np.ones(n_terms)
    share = n / n.sum()
    return np.log2(2 + (seen[1] + SMOOTH * share[1]) / n[1] / ((seen[0] + SMOOTH * share[0]) / n[0]))


class Fitted:
    """A packed model, as it travels: the driver doesn't open it."""

    def __init__(self, raw: bytes | bytearray):
        self.raw = raw

    def open(self) -> NeighbourModel:
        return unpacked(self.raw)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_examples: int = 4000, k: int = 25) -> Fitted:
    """Learns from at most `most_examples` labelled rows of each label, chosen by hash of their id.

    Their votes are weighted so that each label has its share of all labelled rows. Rows without id or label are left out; an id with
    several labels counts as 1 if any is, and of rows that repeat an id the one of smallest text is learned from. Document frequencies of the terms
    cover all of docs. One task builds the index of the chosen rows, whose number is bounded. Without examples every score is 0.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    plain = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    known = labels.selectExpr("cast(doc_id as long) as doc_id", f"cast(`{label_col}` > 0 as int) as label").dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_examples) for v in (0, 1)]
    few = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * most_examples rows
    texts = plain.join(few, "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    examples = scratch.write(texts, "examples")
    per = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = sum(per.values()) / max(sum(sizes[v] for v in per), 1)  # so that votes average 1
    vote = {v: scale * sizes[v] / per[v] for v in per}

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 0, ROWS):
            for kind, found in enumerate(distinct_terms(b.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind, np.int32)), found], ["kind", "term"])

    listed = examples.select("text").mapInArrow(distinct, "kind int, term string").distinct().orderBy("kind", "term").toArrow()
    terms = [listed.filter(pc.equal(listed.column("kind"), k)).column("term").combine_chunks() for k in range(1 + len(BEGINNINGS))]
    shared, width = Sent(spark, terms), sum(map(len, terms)) + 2

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, df = shared.open(TermCounter), np.zeros(width, np.int64)
        for b in text_slices(batches, 0, ROWS):
            df[:-1] += np.bincount(counter.flat(b.column(0))[0], minlength=width - 1)
            df[-1] += b.num_rows
        part, slices = TaskContext.get().partitionId(), range(-(-width // SLICE))
        for x in slices:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x], pa.int32()), pa.array([df[x * SLICE : (x + 1) * SLICE].astype("<i8").tobytes()], pa.binary())], ["part", "slice", "counts"])

    found_df = sum_slices(plain.select("text").mapInArrow(frequencies, "part int, slice int, counts binary"), "<i8")
    df = np.concatenate([found_df[x] for x in sorted(found_df)]) if found_df else np.zeros(width)
    idf = Sent(spark, np.log1p(df[-1] / np.maximum(df[:-1], 1)).astype(np.float32))
    again = shared.again()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, found, counts = again.open(TermCounter), [], []
        for b in text_slices(batches, 2, ROWS):
            found += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            counts += [(ids.astype(np.int32), n.astype(np.int32)) for ids, n in counter.counts(b.column(2))]
        own = counter.terms
        weight = idf.open().astype(np.float64)
        weight *= leaning([label for _, label in found], counts, len(weight))
        model = NeighbourModel(own, weight, [(d, label, vote[label], c) for (d, label), c in zip(found, counts, strict=True)], k)
        raw = packed(model)
        del model, counts, found, weight
        trim()
        pieces = [raw[x : x + PIECE] for x in range(0, len(raw), PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["place", "piece"])

    one = examples.select("doc_id", "label", "text").repartition(1).sortWithinPartitions("doc_id")  # a bounded number of rows
    built = scratch.write(one.mapInArrow(build, "place int, piece binary"), "model", maxRecordsPerFile=str(PER_FILE))
    raw = bytearray(built.agg(F.sum(F.length("piece"))).first()[0] or 0)
    for r in built.toLocalIterator():  # a partition after the other: neither the JVM nor Python holds the model twice
        raw[r["place"] * PIECE : (r["place"] + 1) * PIECE] = r["piece"]
    raw = raw or packed(NeighbourModel(terms, np.zeros(width - 1), [], k))
    del terms, listed, df, found_df
    shared.destroy()
    idf.destroy()
    scratch.drop("examples")
    scratch.drop("model")
    trim()
    return Fitted(raw)


class _Scorer:
    """Scores of texts."""

    def __init__(self, model: NeighbourModel):
        self.model, self.counter = model, TermCounter(model.terms)

    def scores(self, texts: pa.Array) -> list[tuple[float, list]]:
        return self.model.scores(self.counter.counts(texts))


def score_toxicity(docs: DataFrame, model: Fitted, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, evidence (nearest examples: doc_id, label, similarity): one row per input row.

    A null text is scored as empty; an empty text has no neighbours and gets the examples' share of label 1. Repeated rows and null ids give their own rows.
    """
    shared = Sent.packed(docs.sparkSession, model.raw)  # the terms and vectors of at most twice most_examples texts
    schema = "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,label:int,similarity:double>>"
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.open(_Scorer)
        for b in text_slices(batches, 1, ROWS):
            found = scorer.scores(b.column(1))
            score = np.array([x[0] for x in found])
            evidence = [[{"doc_id": d, "label": v, "similarity": s} for d, v, s in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(evidence, kind)], ["doc_id", "score", "predicted", "evidence"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Fitted, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below threshold."""
    shared, place = Sent.packed(docs.sparkSession, model.raw), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.open(_Scorer)
        for b in text_slices(batches, place, ROWS):
            yield b.filter(pa.array([x[0] < threshold for x in scorer.scores(b.column(place))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import documents

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.where(~held_out))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
