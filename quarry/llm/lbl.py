"""A log-bilinear language model, trained in numpy with noise-contrastive estimation.

Tokens are lower-cased words and an end. Every word that occurs at least `least` times (of the `most_words` most frequent) is modelled by
itself; each other word belongs to one of `ENDINGS` groups by its ending, within which its probability is its smoothed share of the
group. The two tokens before a token give h = R[w1] C1 + R[w2] C2. Modelled words stand in classes of neighbouring frequency, groups and the
end are classes of their own, and P(w) = P(class) P(w in its class), softmaxes of h . Qc + bc and h . Q + b. Both are trained by noise-contrastive
estimation, so training costs the same whatever the vocabulary. Every task trains on all its training texts from the same start, and the
tasks' parameters are averaged by tokens. Scores are normalised exactly: the classes' sum for two contexts is the product of
two rows of a table, and the words' sums are batched matrix products, class by class.

Corpus counts are exact and cover all training texts. The `HEAD` most frequent words' counts are broadcast (a bound on size, not a
cut: they are summed at once); every other word's count comes by a join on its 64-bit hash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, Sent, mean_slices, text_slices

ENDINGS, HEAD, WIDTH, CLASSES = 64, 200_000, 24, 128
#: The end's key: no word has a space.
END_KEY = xxhash.xxh3_64_intdigest(b" ")
#: Texts whose words are told apart together.
ROWS = 1024
#: Parameters in one slice of the sums.
PIECE = 16384
#: Words that can be modelled by themselves: training sorts token numbers (these words, groups, end and start) by 16 bits.
MOST_OWN = 65_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of all the texts, A-Z lower-cased and cut at ASCII white space; the number of each word in order; the number of words of each text. Null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    of, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    some = pc.greater(pc.binary_length(words), 0)
    words = words.filter(some).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), np.bincount(of.filter(some).to_numpy(), minlength=len(texts))


def word_keys(words: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words.cast(pa.binary()).to_pylist())), ">u8").astype(np.uint64).view(np.int64)


def word_endings(words: pa.Array) -> np.ndarray:
    """The group of each word: by the last two bytes that are not punctuation."""
    last = pc.binary_slice(pc.ascii_trim(words, characters=".,;:!?\"'()|#$%&*-").cast(pa.binary()), -2, None).dictionary_encode()
    groups = np.array([zlib.crc32(x) % ENDINGS for x in last.dictionary.to_pylist()], np.int64)
    return groups[last.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


class Vocabulary:
    """What scoring needs of the corpus counts: the head's keys and counts (by falling count), totals, and the groups' totals.

    The first `own` words of the head are modelled by themselves: token numbers below own. own + g is a word of the group g, `end` the end and
    `start` what stands before a text.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, own: int, end_count: int, total: int, distinct: int, mass: np.ndarray):
        self.keys, self.head, self.own, self.end_count, self.total, self.distinct, self.mass = keys, counts, own, end_count, total, distinct, mass
        self.end, self.start = own + ENDINGS, own + ENDINGS + 1
        self._made()

    def _made(self) -> None:
        self.order = np.argsort(self.keys)
        self.sorted = self.keys[self.order]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the head, or -1; key; token number of each word."""
        keys = word_keys(words)
        at = np.searchsorted(self.sorted, keys)
        known = at < len(self.sorted)
        known[known] = self.sorted[at[known]] == keys[known]
        place = np.full(len(keys), -1)
        place[known] = self.order[at[known]]
        return place, keys, np.where((place >= 0) & (place < self.own), place, self.own + word_endings(words))

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places in the head (its length for the end, -1 for none), keys and numbers of all the texts' tokens, ends included, and the number of each text's."""
        words, at, sizes = split_tokens(texts)
        own = [np.append(x, end) for x, end in zip(self.words(words), (len(self.head), 0, self.end), strict=True)]
        at = np.insert(at, np.cumsum(sizes), len(words))
        return *(x[at] for x in own), sizes + 1

    def token_numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers alone, and the number of each text's tokens."""
        words, at, sizes = split_tokens(texts)
        own = np.append(self.words(words)[2], self.end)
        return own[np.insert(at, np.cumsum(sizes), len(words))], sizes + 1

    def unigram(self) -> np.ndarray:
        return np.concatenate([self.head[: self.own], self.mass[:, 0], [self.end_count]]).astype(np.float64) + 1

    def __getstate__(self) -> dict:
        return self.__dict__ | {"order": None, "sorted": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._made()


class LogBilinear:
    """unigram: counts by token number, of `own` modelled words, the groups and the end."""

    NAMES = ("R", "Q", "b", "Qc", "bc", "C1", "C2")

    def __init__(self, unigram: np.ndarray, own: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        words = len(unigram)
        self.size = max(1, -(-own // CLASSES))  # words of a class
        self.n_shared = -(-own // self.size)  # classes of several words
        self.own, self.noise = own, unigram / unigram.sum()
        self.class_of = np.concatenate([np.arange(own) // self.size, self.n_shared + np.arange(words - own)]).astype(np.int16)
        self.class_noise = np.bincount(self.class_of, self.noise)
        self.R = rng.normal(0, 0.1, (words + 1, WIDTH)).astype(np.float32)
        self.Q = rng.normal(0, 0.1, (words, WIDTH)).astype(np.float32)
        self.Qc = rng.normal(0, 0.1, (len(self.class_noise), WIDTH)).astype(np.float32)
        self.C1, self.C2 = (np.eye(WIDTH, dtype=np.float32) * x for x in (1.0, 0.5))
        self.b, self.bc = np.log(self.noise).astype(np.float32), np.log(self.class_noise).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, values[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def trainer(self, noise: int = 64, rate: float = 0.1) -> Trainer:
        return Trainer(self, noise, rate)

    def scorer(self) -> Scorer:
        return Scorer(self)


class Trainer:
    """Adagrad steps on a model."""

    def __init__(self, model: LogBilinear, noise: int, rate: float):
        self.model, self.noise, self.rate = model, noise, rate
        self.sums = {n: np.full(getattr(model, n).shape, 1e-4, np.float32) for n in model.NAMES}
        self.heads = []
        for q, b, p in (("Q", "b", model.noise), ("Qc", "bc", model.class_noise)):
            self.heads.append((q, b, np.cumsum(p), np.log(p * noise).astype(np.float32)))

    def step(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> None:
        """One step on a batch; its noise is drawn once and shared by all its contexts."""
        m, n, k = self.model, len(w), self.noise
        (rows1, back1, sum1), (rows2, back2, sum2) = _distinct(w1), _distinct(w2)
        r1, r2 = m.R[rows1], m.R[rows2]
        h = np.ones((n, WIDTH + 1), np.float32)  # the last column sums the biases' gradients
        np.add((r1 @ m.C1).take(back1, 0), (r2 @ m.C2).take(back2, 0), out=h[:, :WIDTH])
        parts = []
        for (q, b, cumulative, log_noise), of in zip(self.heads, (w, m.class_of.take(w)), strict=True):
            drawn = np.searchsorted(cumulative, rng.random(k)).clip(0, len(cumulative) - 1)
            parts.append((q, b, of, drawn, getattr(m, b) - log_noise))
        false_q = np.concatenate([np.concatenate([getattr(m, q)[drawn], bias[drawn, None]], 1) for q, _, _, drawn, bias in parts])
        false = h @ (0.5 * false_q).T
        np.tanh(false, out=false)
        false += 1
        false *= -0.5  # descent on the noise: less its probability to be data
        dh, dq_noise = false @ false_q[:, :WIDTH], false.T @ h
        later = []
        order = np.argsort(w.astype(np.uint16), kind="stable")  # 16 bits sort by radix; classes are in the order of words
        for at, (q, b, of, drawn, bias) in enumerate(parts):
            own = getattr(m, q).take(of, 0)
            g = 0.5 - 0.5 * np.tanh(0.5 * (np.einsum("ij,ij->i", h[:, :WIDTH], own) + bias.take(of)))  # ascent on the data
            own *= g[:, None]
            dh += own
            sorted_ = of.take(order)
            cut = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
            dq = np.add.reduceat((h * g[:, None]).take(order, 0), cut, 0)
            noise_rows, dq_of = _merged(drawn, dq_noise[at * k : at * k + k])
            later += [(q, sorted_[cut], dq[:, :WIDTH]), (b, sorted_[cut], dq[:, WIDTH]), (q, noise_rows, dq_of[:, :WIDTH]), (b, noise_rows, dq_of[:, WIDTH])]
        g1, g2 = sum1(dh), sum2(dh)
        later += [("R", rows1, g1 @ m.C1.T), ("R", rows2, g2 @ m.C2.T), ("C1", slice(None), r1.T @ g1), ("C2", slice(None), r2.T @ g2)]
        for name, rows, grad in later:
            grad = grad * np.float32(1 / n)
            total = self.sums[name][rows] + grad * grad
            self.sums[name][rows] = total
            getattr(m, name)[rows] += self.rate * grad / np.sqrt(total)


def _distinct(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Distinct tokens (below 2^16), the place of each token among them, and a function that sums rows by token."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    own = at.take(order)
    new = np.append(True, own[1:] != own[:-1])
    cut, back = np.flatnonzero(new), np.empty(len(at), np.int64)
    back[order] = np.cumsum(new) - 1
    return own[cut], back, lambda values: np.add.reduceat(values.take(order, 0), cut, 0)


def _merged(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and their sums, of a few that may repeat."""
    own, back = np.unique(rows, return_inverse=True)
    sums = np.zeros((len(own), values.shape[1]), np.float32)
    np.add.at(sums, back, values)
    return own, sums


class Scorer:
    """Normalised log probabilities of tokens, each given the two before it."""

    def __init__(self, model: LogBilinear):
        self.model = model
        self.h1, self.h2 = model.R @ model.C1, model.R @ model.C2
        first, second = self.h1 @ model.Qc.T, self.h2 @ model.Qc.T + model.bc
        top = first.max(1, keepdims=True), second.max(1, keepdims=True)
        self.top1, self.top2 = top[0][:, 0], top[1][:, 0]
        self.sum1, self.sum2 = np.exp(first - top[0]), np.exp(second - top[1])  # a pair of contexts' sum over classes is the product of its rows

    def log_p(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> np.ndarray:
        m, n = self.model, len(w)
        of = m.class_of[w]
        out, h = np.empty(n, np.float32), np.empty((n, WIDTH), np.float32)
        for k in range(0, n, 8192):
            a, c, own = w1[k : k + 8192], w2[k : k + 8192], of[k : k + 8192]
            h[k : k + 8192] = self.h1.take(a, 0) + self.h2.take(c, 0)
            z = np.einsum("ij,ij->i", self.sum1.take(a, 0), self.sum2.take(c, 0))
            out[k : k + 8192] = np.einsum("ij,ij->i", h[k : k + 8192], m.Qc.take(own, 0)) + m.bc[own] - np.log(z) - self.top1[a] - self.top2[c]
        if m.size == 1:
            return out
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(m.n_shared + 1)).tolist()
        for c, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
            begin, stop = c * m.size, min((c + 1) * m.size, m.own)
            for k in range(lo, hi, 8192):
                at = order[k : min(k + 8192, hi)]
                logits = h.take(at, 0) @ m.Q[begin:stop].T
                logits += m.b[begin:stop]
                logits -= logits.max(1, keepdims=True)
                picked = logits[np.arange(len(at)), w[at] - begin].copy()
                np.exp(logits, out=logits)
                out[at] += picked - np.log(logits.sum(1))
        return out


def _contexts(tokens: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each token; start before a text's first."""
    begins = np.cumsum(sizes) - sizes
    w1, w2 = np.empty_like(tokens), np.empty_like(tokens)
    w1[1:], w2[2:] = tokens[:-1], tokens[:-2]
    w2[:2] = start
    w1[begins] = w2[begins] = start
    second = (begins + 1)[sizes > 1]
    w2[second] = start
    return w1, w2


def corpus_counts(docs: DataFrame) -> DataFrame:
    """key, ending, n of every token of the texts (one column, text), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = np.zeros((3, 0), np.int64), 0

        def out(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1].astype(np.int32)), pa.array(rows[2])], ["key", "ending", "n"])

        for b in text_slices(batches, 0, ROWS):
            words, at, sizes = split_tokens(b.column(0))
            ends += len(sizes)
            held = np.concatenate([held, np.stack([word_keys(words), word_endings(words), np.bincount(at, minlength=len(words))])], 1)
            if held.shape[1] > 1_000_000:
                held = _summed(held)
                if held.shape[1] > 500_000:
                    yield out(held)
                    held = held[:, :0]
        if ends:
            yield out(np.concatenate([_summed(held), [[_signed(END_KEY)], [-1], [ends]]], 1))

    rows = docs.mapInArrow(run, "key long, ending int, n long")
    return rows.groupBy("key").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows (key, ending, n) with one for each key."""
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    cut = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1])) if rows.shape[1] else np.zeros(0, np.int64)
    return np.stack([rows[0, cut], rows[1, cut], np.add.reduceat(rows[2], cut)]) if len(cut) else rows


def read_vocabulary(counts: DataFrame, head: int = HEAD, least: int = 1000, most_words: int = 32_768) -> Vocabulary:
    """At most `head` words' keys and counts, and the groups' totals, come to the driver."""
    total, distinct, end = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("ending") == -1, F.col("n"))), F.lit(0))).first()
    size = F.floor(F.log2("n") * 32).cast("int")  # at most 2048 steps; whole steps are taken while they fit
    steps = sorted(counts.where("ending >= 0").groupBy(size.alias("step")).agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r["step"])
    lowest, held = 1 << 30, 0
    for r in steps:
        held += r["v"]
        if held > head:
            break
        lowest = r["step"]
    top = counts.where("ending >= 0").where(size >= lowest).toPandas().sort_values(["n", "key"], ascending=[False, True], ignore_index=True)
    keys, n, group = top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["ending"].to_numpy(np.int64)
    own = min(int((n >= least).sum()), most_words)
    mass = np.zeros((ENDINGS, 2), np.int64)
    for r in counts.where("ending >= 0").groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[r["ending"]] = r["n"], r["v"]
    np.subtract.at(mass, group[:own], np.stack([n[:own], np.ones(own, np.int64)], 1))
    return Vocabulary(keys, n, own, end, total, distinct, mass)


def train_model(docs: DataFrame, vocabulary: Vocabulary, shared: Sent, rounds: int = 1, batch: int = 8192, seed: int = 1) -> LogBilinear:
    """Trains on all texts of docs (one column, text); shared is the sent vocabulary."""
    context = docs.sparkSession.sparkContext
    model = LogBilinear(vocabulary.unigram(), vocabulary.own, seed)
    for turn in range(rounds):
        begin = context.broadcast(model.flat())

        def run(batches: Iterator[pa.RecordBatch], begin=begin, turn=turn) -> Iterator[pa.RecordBatch]:
            v, tokens, part = shared.open(), 0, TaskContext.get().partitionId()
            own = LogBilinear(v.unigram(), v.own)
            own.set_flat(begin.value)
            trainer, rng = own.trainer(), np.random.default_rng([seed, turn, part])
            for b in text_slices(batches, 0, ROWS):
                w, sizes = v.token_numbers(b.column(0))
                w1, w2 = _contexts(w, sizes, v.start)
                tokens += len(w)
                steps = -(-len(w) // batch)
                for k in range(steps):  # every batch has tokens of all these texts
                    trainer.step(w1[k::steps], w2[k::steps], w[k::steps], rng)
            if tokens:
                values = own.flat()
                cuts = [values[k : k + PIECE].tobytes() for k in range(0, len(values), PIECE)]
                columns = [pa.array(np.full(len(cuts), part, np.int32)), pa.array(np.arange(len(cuts), dtype=np.int32)), pa.array(np.full(len(cuts), tokens)), pa.array(cuts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "slice", "weight", "values"])

        found = mean_slices(docs.mapInArrow(run, "part int, slice int, weight long, values binary"))
        if not found:
            break
        model.set_flat(np.concatenate([found[k] for k in sorted(found)]))
    return model


def score_texts(scratch: Scratch, docs: DataFrame, counts: DataFrame, shared: Sent, model: LogBilinear) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row (doc_id, text)."""
    values = docs.sparkSession.sparkContext.broadcast(model.flat())

    def opened(v: Vocabulary) -> tuple[Vocabulary, Scorer]:
        model = LogBilinear(v.unigram(), v.own)
        model.set_flat(values.value)
        return v, model.scorer()

    both_sent = shared.again()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (v, scorer), row = both_sent.open(opened), TaskContext.get().partitionId() << 33
        floor = math.log10(v.total + v.distinct + 1)
        counts_ = np.append(v.head, v.end_count)
        seen = np.log10(counts_ + 1.0)
        in_group = np.zeros(v.end + 1)
        in_group[v.own : v.end] = -np.log10(v.mass[:, 0] + v.mass[:, 1] + 1.0)
        share = seen.copy()
        share[: v.own] = 0
        share[-1] = 0
        names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "key", "times"]
        for part in text_slices(batches, 1, ROWS):
            ids, all_keys, w, sizes = v.tokens(part.column(1))
            n = len(sizes)
            w1, w2 = _contexts(w, sizes, v.start)
            log_p = scorer.log_p(w1, w2, w).astype(np.float64) / math.log(10)
            in_head = ids >= 0
            at = np.where(in_head, ids, 0)
            cut = np.cumsum(sizes) - sizes
            base = np.add.reduceat(np.where(in_head, seen[at], 0.0) - floor, cut)
            score = np.add.reduceat(log_p + in_group[w] + np.where(in_head, share[at], 0.0), cut)
            known = np.add.reduceat((in_head & (counts_[at] > 0)).astype(np.int64), cut)
            own = row + np.arange(n)
            row += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), part.column(0), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names
            )
            tail = np.flatnonzero(~in_head)
            if len(tail):
                of, keys = np.repeat(own, sizes)[tail], all_keys[tail]
                order = np.lexsort((keys, of))
                of, keys = of[order], keys[order]
                begin = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])))
                times, m = np.diff(begin, append=len(of)).astype(np.int32), len(begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of[begin]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array(keys[begin]), pa.array(times)], names
                )

    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, key long, times int"
    both = scratch.write(docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("tail", F.col("times").isNotNull()), "scored", "tail")
    tail = both.where("tail").select("row", "key", "times").join(counts.select("key", "n"), "key")  # words that no count has add nothing
    seen = tail.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    zero = F.coalesce("more", F.lit(0.0))
    return both.where("not tail").join(seen, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base") + zero).alias("base_score"), (F.col("score") + zero).alias("score")
    )


def language_model_scores(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, head: int = HEAD, least: int = 1000, most_words: int = 32_768
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    `learn` marks the rows to learn from (null: not). base_score is the add-one unigram log10 probability, score the model's. A null or
    empty text is its end alone. Repeated rows and null ids give their own rows; an empty table gives none. Without training texts
    the base gives every token probability 1 and the model keeps its starting weights. Words that occur `least` times or more are modelled by
    themselves, at most `most_words` of them and no more than the head; a `most_words` beyond `MOST_OWN` is refused.
    """
    if not 0 <= most_words <= MOST_OWN:
        raise ValueError(f"most_words is {most_words}, not from 0 to {MOST_OWN}")
    scratch = Scratch(docs.sparkSession, "lbl")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), learn.alias("learn"))
    training = plain.where("learn").select("text")
    counts = scratch.write(corpus_counts(training), "counts")
    vocabulary = read_vocabulary(counts, head, least, most_words)
    shared = Sent(docs.sparkSession, vocabulary)  # at most `head` words
    model = train_model(training, vocabulary, shared, rounds)
    return score_texts(scratch, plain, counts, shared, model).withColumn("train_tokens", F.lit(vocabulary.total).cast("long"))


def op9_lm_scores(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import documents

    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    scores = language_model_scores(documents(spark, sf_dir), remainder != 2)
    return scores.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
