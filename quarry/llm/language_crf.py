"""Language identification by a linear-chain conditional random field over words.

A word's features are its beginnings, endings and inner n-grams and, if it is frequent in the examples, the word itself (lexicon);
transitions between the languages of neighbouring words are learned too, from examples that are also
joined into code-switched sequences. Forward-backward over the whole text gives each word's language probabilities;
their mean is the document's. Documents of like length run in step in numpy, and the distinct words of a slice of documents get their features and weights together.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Sent, text_slices, trim
from quarry.llm.units import Cache

BUCKETS = 1 << 15
SEGMENT = 32
#: Words (with padding) that run in step at once.
CELLS = 200_000
#: Code points whose n-grams are hashed at once, and words whose weights are summed at once.
CODES, WORDS = 1 << 18, 1 << 14


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


class Grams:
    """Buckets of features by kind: beginnings, endings, inner n-grams, words. Caches of bounded size."""

    def __init__(self, most: int = 100_000):
        self.p, self.s, self.n, self.w = (Cache(lambda gram, kind=kind: zlib.crc32(f"{kind}{gram}".encode()) % BUCKETS, most) for kind in "psnw")


def letters(word: str) -> str:
    """The word in lower case; only its letters, apostrophes and hyphens."""
    word = word.lower()
    return word if word.isalpha() else "".join([c for c in word if c.isalpha() or c in "'-"])


def word_features(word: str, lexicon: frozenset[str] | set[str], grams: Grams) -> list[int]:
    """Hashed features of a word's letters."""
    word = letters(word)
    marked = f"^{word}$"
    p, s, n = grams.p, grams.s, grams.n
    found = {p[marked[:2]], p[marked[:3]], p[marked[:4]], s[marked[-2:]], s[marked[-3:]], s[marked[-4:]]}
    found.update([n[marked[k : k + 2]] for k in range(len(marked) - 1)])
    found.update([n[marked[k : k + 3]] for k in range(len(marked) - 2)])
    if word in lexicon:
        found.add(grams.w[word])
    return list(found)


#: What a byte does to the register of a CRC-32.
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def _byte(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(state ^ byte) & 0xFF] ^ (state >> 8)


def _code(state: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The registers after the UTF-8 bytes of one code point each."""
    out = _byte(state, codes)
    wide = np.flatnonzero(codes > 0x7F)
    if len(wide):
        c, s = codes[wide], np.broadcast_to(state, codes.shape)[wide]
        size = 2 + (c > 0x7FF) + (c > 0xFFFF)
        s = _byte(s, np.choose(size - 2, [0xC0 | c >> 6, 0xE0 | c >> 12, 0xF0 | c >> 18]))
        for later in (2, 1, 0):
            s = np.where(size > later + 1, _byte(s, 0x80 | c >> 6 * later & 0x3F), s)
        out[wide] = s
    return out


def _begun(kind: str) -> np.ndarray:
    return np.array(zlib.crc32(kind.encode()) ^ 0xFFFFFFFF, np.uint32)


def all_features(forms: list[str], lexicon: frozenset[str] | set[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of words that are letters already, one word's after another's and each in ascending order, and where each word's begin.

    The same buckets as word_features, which takes a word at a time: the CRCs of all n-grams are taken together.
    """
    n = len(forms)
    codes = np.frombuffer("".join([f"^{f}$" for f in forms]).encode("utf-32-le") + bytes(8), "<u4")
    end = np.cumsum(np.fromiter(map(len, forms), np.int64, n) + 2) - 1
    first, own = np.append(0, end[:-1] + 1), np.arange(n)
    places: list[np.ndarray] = []

    def add(word: np.ndarray, state: np.ndarray) -> None:
        places.append(word * BUCKETS + (~state & BUCKETS - 1))

    long = end - first > 2  # a word of one letter has no more than three marked characters
    p = _code(_code(_begun("p"), codes[first]), codes[first + 1])
    add(own, p)
    p = _code(p, codes[first + 2])
    add(own, p)
    add(own[long], _code(p, codes[first + 3])[long])
    for k in (1, 2, 3):
        some = own if k < 3 else own[long]
        s = _begun("s")
        for back in range(k, -1, -1):
            s = _code(s, codes[end[some] - back])
        add(some, s)
    known = [k for k, f in enumerate(forms) if f in lexicon]
    places.append(np.array(known, np.int64) * BUCKETS + np.array([zlib.crc32(f"w{forms[k]}".encode()) % BUCKETS for k in known], np.int64))
    found = [np.concatenate(places)]
    for lo in range(0, len(codes) - 2, CODES):
        hi = min(lo + CODES, len(codes) - 2)
        word = np.searchsorted(end, np.arange(lo, hi))
        rest = end[word] - np.arange(lo, hi)
        two = _code(_code(_begun("n"), codes[lo:hi]), codes[lo + 1 : hi + 1])
        three = _code(two, codes[lo + 2 : hi + 2])
        found.append(_different(np.concatenate([(word * BUCKETS + (~x & BUCKETS - 1))[rest >= k] for k, x in ((1, two), (2, three))])))
    word, buckets = np.divmod(_different(np.concatenate(found)), BUCKETS)
    return buckets, np.searchsorted(word, own)


def _different(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def all_letters(words: list[str]) -> list[str]:
    """`letters` of each word, '' for a word without a letter; words have no white space."""
    if not words:
        return []
    codes = np.frombuffer("\n".join(words).lower().encode("utf-32-le"), "<u4")
    letter, ends = _is_letter()[codes], codes == 10
    some = np.zeros(len(words), bool)
    some[np.cumsum(ends)[letter]] = True
    forms = codes[letter | ends | (codes == 39) | (codes == 45)].tobytes().decode("utf-32-le").split("\n")
    return [f if s else "" for f, s in zip(forms, some.tolist(), strict=True)]


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of all the texts, split as str.split does, the number of each word in order, and the text of each; null is empty."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words, of = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(words), 0)
    words = words.filter(some).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(), of.filter(some).to_numpy()


def forward_backward(emission: np.ndarray, transition: np.ndarray, start: np.ndarray, lengths: np.ndarray, with_transitions: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals (time, sequence, label), and, if asked for, the expected transitions summed over all sequences.

    emission (time, sequence, label) holds log weights; sequences are sorted by falling length.
    """
    steps, n, k = emission.shape
    local = np.exp(emission - emission.max(2, keepdims=True))
    move, first = np.exp(transition - transition.max()), np.exp(start - start.max())
    alpha, beta = np.zeros_like(local), np.ones_like(local)
    live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps)]  # sequences longer than t
    for t in range(steps):
        m = live[t]
        a = (first if t == 0 else alpha[t - 1, :m] @ move) * local[t, :m]
        alpha[t, :m] = a / a.sum(1, keepdims=True)
    expected = np.zeros((k, k))
    for t in range(steps - 1, 0, -1):
        m = live[t]
        after = local[t, :m] * beta[t, :m]
        b = after @ move.T
        if with_transitions:
            expected_t = (alpha[t - 1, :m, :, None] * move) * after[:, None, :]
            expected += (expected_t / expected_t.sum((1, 2), keepdims=True)).sum(0)
        beta[t - 1, :m] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    return both / np.maximum(both.sum(2, keepdims=True), 1e-30), expected


class LanguageCrf:
    def __init__(self, languages: list[str], lexicon: set[str]):
        self.languages, self.lexicon, self.grams = languages, lexicon, Grams()
        k = len(languages)
        self.weights, self.transition, self.start = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"grams": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.grams = Grams()

    def emission(self, word: str) -> bytes:
        """A word's label weights as packed 32-bit floats; none for a word without letters."""
        return self.weights[word_features(word, self.lexicon, self.grams)].sum(0).astype("<f4").tobytes() if has_letter(word) else b""

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Label weights of all the words (words x labels) as 32-bit floats, and whether each has a letter; zeros for one without."""
        out, some = np.zeros((len(words), len(self.languages)), np.float32), np.zeros(len(words), bool)
        for lo in range(0, len(words), WORDS):
            forms = all_letters(words[lo : lo + WORDS])
            at = np.array([k for k, f in enumerate(forms) if f], np.int64)
            if len(at):
                buckets, begin = all_features([f for f in forms if f], self.lexicon)
                out[lo + at] = np.add.reduceat(self.weights[buckets], begin, 0)
                some[lo + at] = True
        return out, some

    def fill(self, cache: Cache, words: set[str]) -> None:
        """Puts the words that the cache lacks into it, all in one sum."""
        new = list(words.difference(cache))
        if len(cache) + len(new) > cache.most:
            cache.clear()
            new = list(words)
        some = [w for w in new if has_letter(w)]
        cache.update(dict.fromkeys(set(new).difference(some), b""))
        if some:
            forms = {w: letters(w) for w in some}  # a word's weights are those of its letters, which spellings with capitals, digits and marks share
            fresh = [f for f in dict.fromkeys(forms.values()) if not cache.get(f)]
            flat, ends = [], []
            for f in fresh:
                flat += word_features(f, self.lexicon, self.grams)
                ends.append(len(flat))
            made = {}
            if fresh:
                sums = np.add.reduceat(self.weights[flat], [0, *ends[:-1]], 0).astype("<f4")
                width, raw = 4 * sums.shape[1], sums.tobytes()
                made = {f: raw[k * width : (k + 1) * width] for k, f in enumerate(fresh)}
            cache.update([(w, made.get(f) or cache[f]) for w, f in forms.items()])
            if len(cache) + len(made) <= cache.most:
                cache.update(made)

    def fit(self, sequences: list[tuple[list[str], list[int]]], epochs: int, seed: int, rate: float = 0.05, decay: float = 1e-4) -> None:
        """Adam on the conditional likelihood of sequences of exactly SEGMENT words."""
        rng, k = np.random.default_rng(seed), len(self.languages)
        vocab: dict[str, int] = {}
        words = np.fromiter((vocab.setdefault(w, len(vocab)) for ws, _ in sequences for w in ws), np.int32).reshape(-1, SEGMENT)
        labels = np.fromiter((x for _, ls in sequences for x in ls), np.int32).reshape(-1, SEGMENT)
        forms, flat, width = all_letters(list(vocab)), [], []
        for lo in range(0, len(forms), WORDS):
            some, begin = all_features(forms[lo : lo + WORDS], self.lexicon)
            flat.append(some.astype(np.int32))
            width.append(np.diff(begin, append=len(some)))
        flat, width = np.concatenate(flat), np.concatenate(width)
        begin = np.cumsum(width) - width
        del vocab, forms
        params = [self.weights.astype(np.float64), self.transition, self.start]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(words))
            for lo in range(0, len(order), 256):
                pick = order[lo : lo + 256]
                own, inverse = np.unique(words[pick].T.ravel(), return_inverse=True)
                n = width[own]
                at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                used, of = flat[at], np.repeat(np.arange(len(own)), n)
                by_word = np.add.reduceat(params[0][used], np.cumsum(n) - n, 0)
                emission = by_word[inverse].reshape(SEGMENT, len(pick), k)
                marginal, expected = forward_backward(emission, params[1], params[2], np.full(len(pick), SEGMENT), True)
                gold = labels[pick].T
                error = np.eye(k)[gold] - marginal
                word_grad = np.stack([np.bincount(inverse, error[:, :, c].ravel(), len(own)) for c in range(k)], 1)
                grads = [
                    np.stack([np.bincount(used, word_grad[of, c], BUCKETS) for c in range(k)], 1),
                    np.bincount((gold[:-1] * k + gold[1:]).ravel(), minlength=k * k).reshape(k, k) - expected,
                    error[0].sum(0),
                ]
                step += 1
                for p, g, mm, vv in zip(params, grads, m, v, strict=True):
                    g = g / len(pick) - decay * p
                    mm += 0.1 * (g - mm)
                    vv += 0.01 * (g * g - vv)
                    p += rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
        self.weights, self.transition, self.start = params[0].astype(np.float32), params[1], params[2]

    def marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Word marginals of each document, from its words' weights (words x languages)."""
        out: list = [None] * len(emissions)
        order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
        at = 0
        while at < len(order):
            longest = max(1, len(emissions[order[at]]))
            group = order[at : at + max(1, CELLS // longest)]
            at += len(group)
            lengths = np.array([len(emissions[i]) for i in group])
            block = np.zeros((longest, len(group), len(self.languages)), np.float32)
            for j, i in enumerate(group):
                block[: lengths[j], j] = emissions[i]
            found, _ = forward_backward(block, self.transition.astype(np.float32), self.start.astype(np.float32), lengths)
            for j, i in enumerate(group):
                out[i] = found[: lengths[j], j]
        return out


def fit_language_crf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 300, epochs: int = 3, seed: int = 7) -> LanguageCrf | None:
    """Learns from the whole texts of at most rows_per_language rows of each language, chosen by hash of the id; None without any.

    Rows with a null language, id or text are left out. Of rows that repeat an id with one language, the one of smallest text counts. Rows whose hash is far from
    the lowest are left out before they are ranked, by the number of ids of their language, so that no task ranks a language's whole table.
    """
    known = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{lang_col}` as lang", f"`{text_col}` as text").dropna()
    plain = known.select("doc_id", "lang", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)).alias("u"))
    # a row for each language, of which the model that is broadcast later has 128 KB of weights
    sizes = plain.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    low = plain.join(F.broadcast(sizes), "lang").where(F.col("u") * F.col("n") < 4 * rows_per_language + 100).select("lang", "u", "doc_id").distinct()
    first = Window.partitionBy("lang").orderBy("u", "doc_id")
    few = low.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= rows_per_language).select("doc_id", "lang")
    texts = known.join(F.broadcast(few), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sorted({(r["doc_id"], r["lang"], r["text"]) for r in texts.collect()})
    one: dict[str, str] = {}  # a word that occurs again is the same object, so that the driver holds each once
    words = [([one.setdefault(w, w) for w in text.split() if has_letter(w)], lang) for _, lang, text in rows]
    words = [(w, lang) for w, lang in words if w]
    if not words:
        return None
    languages = sorted({lang for _, lang in words})
    form = dict(zip(one, all_letters(list(one)), strict=True))
    counts = Counter(word for w, _ in words for word in {form[x] for x in w})
    model = LanguageCrf(languages, {w for w, n in counts.items() if n >= 3})
    del rows, one, form, counts
    rng = np.random.default_rng(seed)
    sequences, halves = [], []
    for w, lang in words:
        label = [languages.index(lang)] * SEGMENT
        w = w * -(-SEGMENT // len(w)) if len(w) < SEGMENT else w  # short texts are repeated to one sequence
        for k in sorted({*range(0, len(w) - SEGMENT + 1, SEGMENT), len(w) - SEGMENT}):  # the last may overlap the one before
            sequences.append((w[k : k + SEGMENT], label))
    for _ in range(len(sequences) // 4):
        (a, la), (b, lb) = (sequences[i] for i in rng.integers(0, len(sequences), 2))
        cut = int(rng.integers(4, SEGMENT - 4))
        halves.append((a[:cut] + b[cut:], la[:cut] + lb[cut:]))
    model.fit(sequences + halves, epochs, seed)
    model.grams = Grams()
    del words, sequences, halves
    trim()
    return model


class _Tagger:
    def __init__(self, model: LanguageCrf | None):
        self.model = model

    def tag(self, texts: pa.Array) -> tuple[list[str], list[float], list[np.ndarray]]:
        """Language, score and word marginals of each text."""
        n, own = len(texts), self.model
        langs, scores = ["und"] * n, [0.0] * n
        if not own:
            return langs, scores, [np.zeros((0, 1))] * n
        words, at, of = split_words(texts)
        weights, some = own.emissions(words)
        some = some[at]
        at, cut = at[some], np.searchsorted(of[some], np.arange(n + 1)).tolist()
        marginals = own.marginals([weights[at[lo:hi]] for lo, hi in zip(cut, cut[1:], strict=False)])
        for i, p in enumerate(marginals):
            if len(p):
                mean = p.mean(0, dtype=np.float64)
                best = int(mean.argmax())
                langs[i], scores[i] = own.languages[best], float(min(mean[best], 1.0))
        return langs, scores, marginals

    def spans(self, p: np.ndarray) -> list[dict]:
        of = p.argmax(1)
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        return [{"lang": self.model.languages[of[c]], "first": int(c), "words": int(e - c)} for c, e in zip(cuts, np.append(cuts[1:], len(of)), strict=True)] if len(of) else []


def identify_language(docs: DataFrame, model: LanguageCrf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans: one row per input row.

    score is the mean probability, over all words with a letter, of the language for which it is largest (the first in alphabetical
    order of equals). spans are the runs of words whose likeliest language is the same: lang, first word, words. A text that
    is null or has no letter, and any text without a model, is `und` with score 0 and no spans. Repeated rows and
    null ids give their own rows; an empty table gives none.
    """
    shared = Sent(docs.sparkSession, model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.open(_Tagger)
        for b in text_slices(batches, 1, 1024):
            langs, scores, marginals = tagger.tag(b.column(1))
            spans = pa.array([tagger.spans(p) for p in marginals], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first:int,words:int>>"
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageCrf | None, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that have a language: some word with a letter, and words whose likeliest languages have a mean probability of at least `least`."""
    shared, place = Sent(docs.sparkSession, model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.open(_Tagger)
        for b in text_slices(batches, place, 1024):
            langs, _, marginals = tagger.tag(b.column(place))
            yield b.filter(pa.array([x != "und" and float(p.max(1).mean()) >= least for x, p in zip(langs, marginals, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import documents

    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit_language_crf(docs.where(~held_out))
    return identify_language(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
