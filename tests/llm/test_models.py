"""Learned operators: exactness of what is exact, and held-out quality."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import language_crf, lbl, toxicity
from tests.llm.texts import SCHEMA, frame, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLEAN = "the river house stone green walk table light paper morning garden window".split()
BAD = ["idiot", "scum", "moron"]


def toxic_rows(n=300, seed=4):
    rnd = random.Random(seed)
    out, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = [rnd.choice(CLEAN) for _ in range(rnd.randint(10, 60))]
        if bad:
            for _ in range(rnd.randint(1, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(BAD).upper() + "!"
        out.append((k, " ".join(words), *[None] * 5, 1))
        labels.append((k, int(bad)))
    return out, labels


def dense(model, vector):
    x = np.zeros(len(model.idf))
    for t, v in vector:
        x[t] = v
    return x


def test_nearest_is_exact(monkeypatch):
    rng = np.random.default_rng(1)
    idf = rng.random(40) + 0.1
    counts = [dict(zip(rng.choice(40, rng.integers(1, 6), False).tolist(), rng.integers(1, 5, 6).tolist(), strict=False)) for _ in range(400)]
    monkeypatch.setattr(toxicity, "COMMON", 16)
    counts = [(np.array(sorted(c)), np.array([c[t] for t in sorted(c)])) for c in counts]
    model = toxicity.NeighbourModel([], idf, [(k, k % 2, 1.0, c) for k, c in enumerate(counts)], 9)
    stored = {}
    for t, (at, v) in model.postings.items():
        for a, x in zip(at, v, strict=True):
            stored.setdefault(int(a), []).append((t, x))
    matrix = np.stack([dense(model, stored[k]) for k in range(len(stored))])
    vectors = model.weights(counts[:80])
    for vector, (_, sims) in zip(vectors, model.nearest(vectors), strict=True):
        assert np.allclose(sims, np.sort(matrix @ dense(model, zip(*vector, strict=True)))[::-1][:9], atol=2e-6)
    assert 0 < model.visited < model.met


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    x, y, w = rng.random(200), rng.random(200), rng.random(200)
    steps, means = toxicity.isotonic(x, y, w)
    assert (np.diff(steps) >= 0).all() and (np.diff(means) >= -1e-12).all()
    fitted = np.interp(x, steps, means)
    assert np.isclose((fitted * w).sum(), (y * w).sum())


def test_toxicity_on_held_out_rows(spark):
    data, labels = toxic_rows(1000)
    docs, known = frame(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, known.where("doc_id < 800"))
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert [k for k, v in labels if k >= 800 and found[k]["predicted"] != v] == []
    assert all(0 <= r["score"] <= 1 and len(r["evidence"]) for r in found.values())
    assert {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()} == {k for k in found if not found[k]["predicted"]}


def test_toxicity_finds_a_copy_whose_words_are_in_one_example_only(spark):
    rnd = random.Random(9)
    texts = [" ".join([*rnd.sample(CLEAN, 4), *(f"w{k}x{j}" for j in range(20))]) for k in range(60)]
    data = [(100 * copy + k, t, *[None] * 5, 1) for copy in range(3) for k, t in enumerate(texts)]
    docs, known = frame(spark, data), spark.createDataFrame([(d, int(d % 100 < 12)) for d, *_ in data if d < 200], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs.where("doc_id >= 200"), toxicity.fit_toxicity(docs, known)).collect()
    assert len(found) == 60
    for r in found:
        assert r["predicted"] == (r["doc_id"] < 212)
        assert r["evidence"][0]["doc_id"] % 100 == r["doc_id"] % 100 and math.isclose(r["evidence"][0]["similarity"], 1, rel_tol=2e-6)


def test_rows_that_repeat_an_id_are_one_example(spark):
    docs = spark.createDataFrame([(1, "b words here"), (1, "a words here"), (2, "other text stands"), (None, "c")], "doc_id int, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels).open()
    assert sorted(model.names) == [(1, 1), (2, 0)]


def test_toxicity_without_examples_and_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(frame(spark), none)
    found = toxicity.score_toxicity(frame(spark), model).collect()
    assert len(found) == len(rows()) and all(r["score"] == 0 and r["predicted"] == 0 for r in found)
    assert toxicity.score_toxicity(spark.createDataFrame([], SCHEMA), model).count() == 0


def brute_marginals(emission, transition, start):
    t, k = emission.shape
    total = np.zeros((t, k))
    for path in np.ndindex(*[k] * t):
        w = math.exp(start[path[0]] + sum(emission[i, path[i]] for i in range(t)) + sum(transition[path[i], path[i + 1]] for i in range(t - 1)))
        for i in range(t):
            total[i, path[i]] += w
    return total / total.sum(1, keepdims=True)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([5, 3, 1])
    emission, transition, start = rng.normal(size=(5, 3, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    found, _ = language_crf.forward_backward(emission, transition, start, lengths)
    for s, n in enumerate(lengths):
        assert np.allclose(found[:n, s], brute_marginals(emission[:n, s], transition, start))


WORDS = {"en": "the of and house garden window walking nothing", "de": "der die und haus garten fenster gehen nichts", "fr": "le les et maison jardin fenêtre marcher rien"}


def language_rows(n=240):
    rnd = random.Random(6)
    out = []
    for k in range(n):
        lang = sorted(WORDS)[k % 3]
        out.append((k, " ".join(rnd.choice(WORDS[lang].split()) for _ in range(rnd.randint(3, 50))), lang, *[None] * 4, 1))
    return out


def test_language_on_held_out_rows_and_code_switching(spark):
    data = language_rows()
    docs = frame(spark, data)
    model = language_crf.fit_language_crf(docs.where("doc_id < 120"))
    found = {r["doc_id"]: r for r in language_crf.identify_language(docs, model).collect()}
    assert np.mean([found[d]["lang_pred"] == lang for d, _, lang, *_ in data if d >= 120]) > 0.98
    odd = [(1, None), (2, ""), (3, "12 34 ..."), (4, "der die und haus der garten le les et maison le jardin"), (5, "haus " * 3000)]
    found = {r["doc_id"]: r for r in language_crf.identify_language(frame(spark, [(d, t, *[None] * 5, 1) for d, t in odd]), model).collect()}
    assert [(found[d]["lang_pred"], found[d]["score"], found[d]["spans"]) for d in (1, 2, 3)] == [("und", 0.0, [])] * 3
    assert [(s["lang"], s["first"], s["words"]) for s in found[4]["spans"]] == [("de", 0, 6), ("fr", 6, 6)]
    assert found[5]["lang_pred"] == "de"
    kept = language_crf.keep_identified(frame(spark, [(d, t, *[None] * 5, 1) for d, t in odd]), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5] and kept.columns == frame(spark).columns


def test_language_learns_from_the_whole_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_crf.LanguageCrf, "fit", lambda self, sequences, epochs, seed: seen.extend(sequences))
    n = 2 * language_crf.SEGMENT - 1
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(3)) for k in range(n)]
    language_crf.fit_language_crf(frame(spark, [(1, " ".join(words), "en", *[None] * 4, 1)]))
    assert {w for s, _ in seen for w in s} == set(words) and {len(s) for s, _ in seen} == {language_crf.SEGMENT}


def test_rows_that_repeat_an_id_teach_their_own_language(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_crf.LanguageCrf, "fit", lambda self, sequences, epochs, seed: seen.extend((self.languages[ls[0]], ws[0]) for ws, ls in sequences if len(set(ls)) == 1))
    data = [(5, "house " * 40, "en", *[None] * 4, 1), (5, "maison " * 40, "fr", *[None] * 4, 1), (5, "zebra " * 40, "en", *[None] * 4, 1), (None, "nobody " * 40, "en", *[None] * 4, 1)]
    language_crf.fit_language_crf(frame(spark, data))
    assert set(seen) == {("en", "house"), ("fr", "maison")}  # of two English rows of one id the smaller text


def test_languages_are_bounded_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_crf.LanguageCrf, "fit", lambda self, sequences, epochs, seed: seen.extend(ws[0] for ws, ls in sequences if len(set(ws)) == 1))
    names = ["".join(chr(97 + k // 26**j % 26) for j in range(3)) for k in range(3000)]
    docs = spark.createDataFrame([(k, f"{w} " * language_crf.SEGMENT, "en" if k % 3 else "de") for k, w in enumerate(names)], "doc_id int, text string, lang string")
    language_crf.fit_language_crf(docs, rows_per_language=20)
    assert len(seen) == len(set(seen)) == 40


def test_a_text_of_three_languages_is_kept(spark):
    model = language_crf.fit_language_crf(frame(spark, language_rows()))
    docs = frame(spark, [(1, " ".join(WORDS[x] for x in ("en", "de", "fr")), *[None] * 5, 1)])
    assert language_crf.identify_language(docs, model).first()["score"] < 0.4
    assert language_crf.keep_identified(docs, model).count() == 1


def test_language_without_examples(spark):
    model = language_crf.fit_language_crf(frame(spark).where("false"))
    assert model is None
    assert {r["lang_pred"] for r in language_crf.identify_language(frame(spark), model).collect()} == {"und"}


def brute_base(data, learn):
    words = {d: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for d, t, *_ in data}
    counts = Counter(w for d in words if learn(d) for w in words[d])
    n, v = sum(counts.values()), len(counts)
    return {d: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in words.items()}


@pytest.mark.parametrize("head", [3, 200_000])
def test_base_scores_are_exact(spark, head):
    data = rows(8, 120)
    found = {r["doc_id"]: r for r in lbl.language_model_scores(frame(spark, data), F.col("doc_id") % 4 != 0, rounds=1, head=head).collect()}
    for d, (n, known, total, base) in brute_base(data, lambda d: d % 4 != 0).items():
        r = found[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def slow_log_p(m, a, c, w):
    h = m.R[a] @ m.C1 + m.R[c] @ m.C2
    log_sum = lambda x: x.max() + np.log(np.exp(x - x.max()).sum())
    of, classes = m.class_of[w], m.Qc @ h + m.bc
    members = np.flatnonzero(m.class_of == of)
    words = m.Q[members] @ h + m.b[members]
    return classes[of] - log_sum(classes) + words[list(members).index(w)] - log_sum(words)


@pytest.mark.parametrize("own", [0, 5, 700])
def test_model_is_normalised_and_scored_exactly(own):
    rng = np.random.default_rng(0)
    unigram = rng.random(own + lbl.ENDINGS + 1) + 0.1
    model = lbl.LogBilinear(unigram, own)
    model.set_flat(model.flat() + rng.normal(0, 0.5, len(model.flat())))
    scorer, n = model.scorer(), len(unigram)
    for a, c in ((0, 5), (n, n), (n - 1, 3)):
        p = scorer.log_p(np.full(n, a), np.full(n, c), np.arange(n))
        assert np.isclose(np.exp(p.astype(np.float64)).sum(), 1, atol=1e-4)
        assert np.allclose(p[::7], [slow_log_p(model, a, c, w) for w in range(0, n, 7)], atol=1e-3)


def test_scores_are_the_sums_of_the_models_log_probabilities(spark):
    """With every word modelled the score is the plain sum over tokens; with a small head, words of groups have their smoothed share."""
    data = [(k, " ".join(random.Random(k).choices([f"w{j}" for j in range(30)], k=20)), *[None] * 5, 1) for k in range(40)] + [(90, "never seen w1", *[None] * 5, 1), (91, None, *[None] * 5, 1)]
    docs = frame(spark, data)
    for head, least in ((200_000, 1), (12, 20)):
        kept = {}
        original = lbl.score_texts
        lbl.score_texts = lambda scratch, d, counts, shared, model: kept.update(model=model, v=shared.open()) or original(scratch, d, counts, shared, model)
        try:
            found = {r["doc_id"]: r["score"] for r in lbl.language_model_scores(docs, F.col("doc_id") < 40, head=head, least=least).collect()}
        finally:
            lbl.score_texts = original
        m, v = kept["model"], kept["v"]
        counts = Counter(w for d, t, *_ in data if d < 40 for w in t.split())
        for d, t, *_ in data:
            w1 = w2 = v.start
            total = 0.0
            for word in [*(t or "").split(), None]:
                token = v.end if word is None else int(v.words(pa.array([word]))[2][0])
                total += slow_log_p(m, w1, w2, token) / math.log(10)
                if v.own <= token < v.end:
                    group = [w for w in counts if int(v.words(pa.array([w]))[2][0]) == token]
                    total += math.log10((counts[word] + 1) / (sum(counts[w] for w in group) + len(group) + 1))
                w1, w2 = token, w1
            assert math.isclose(found[d], total, rel_tol=1e-4)


def test_training_beats_the_unigram_on_text_with_structure(spark):
    rnd = random.Random(1)
    data = []
    for k in range(400):
        words = []
        for _ in range(60):
            a = rnd.randint(0, 9)
            words += [f"a{a}", f"b{a}", f"c{a}"]
        data.append((k, " ".join(words), *[None] * 5, 1))
    found = lbl.language_model_scores(frame(spark, data), F.col("doc_id") % 7 != 2, rounds=4, least=100).where("doc_id % 7 = 2").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert found["s"] > 0.85 * found["b"]


def test_more_words_than_training_can_sort_are_refused(spark):
    for most in (-1, lbl.MOST_OWN + 1):
        with pytest.raises(ValueError, match="most_words"):
            lbl.language_model_scores(frame(spark), F.lit(True), most_words=most)
    last = np.array([lbl.MOST_OWN + lbl.ENDINGS + 1, 1, 1, lbl.MOST_OWN + lbl.ENDINGS + 1])  # the largest token number: the start
    tokens, back, sums = lbl._distinct(last)
    assert tokens.tolist() == [1, last[0]] and back.tolist() == [1, 0, 0, 1] and sums(np.array([[1], [2], [3], [4]])).tolist() == [[5], [5]]


def test_language_model_edge_tables(spark):
    assert lbl.language_model_scores(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    found = lbl.language_model_scores(frame(spark, [(1, None, *[None] * 5, 1), (None, "a", *[None] * 5, 1)]), F.lit(False)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]


def test_spellings_of_a_word_share_its_weights(monkeypatch):
    from quarry.llm import language_crf
    from quarry.llm.units import Cache

    model, asked, own = language_crf.LanguageCrf(["a", "b"], {"word"}), [], language_crf.word_features
    model.weights[:] = np.random.default_rng(1).normal(size=model.weights.shape)
    monkeypatch.setattr(language_crf, "word_features", lambda w, *more: asked.append(w) or own(w, *more))
    cache = Cache(model.emission, 100)
    model.fill(cache, {"Word", "word,", "WORD1", "12"})
    assert asked == ["word"] and cache["Word"] == cache["word,"] == cache["WORD1"] == cache["word"] and cache["12"] == b""
    model.fill(cache, {"(word)", "Other"})
    assert asked == ["word", "other"] and np.allclose(np.frombuffer(cache["(word)"], "<f4"), np.frombuffer(model.emission("word"), "<f4"))


def odd_forms(n=300):
    rnd = random.Random(5)
    letters = [chr(c) for c in (*range(97, 123), 0xDF, 0xE9, 0x3C2, 0x430, 0x5D0, 0x4E2D, 0x10400, 0x20000)]
    words = ["".join(rnd.choice(letters) for _ in range(rnd.choice([1, 1, 2, 3, 5, 12]))) for _ in range(n)] + ["o'x", "a-b", "-a", "x" * 300]
    return [language_crf.letters(w) for w in words]


def test_features_of_many_words_are_those_of_each(monkeypatch):
    forms = odd_forms()
    grams, lexicon = language_crf.Grams(), set(forms[::3])
    for codes in (1 << 18, 7):
        monkeypatch.setattr(language_crf, "CODES", codes)
        buckets, begin = language_crf.all_features(forms, lexicon)
        assert [x.tolist() for x in np.split(buckets, begin[1:])] == [sorted(language_crf.word_features(f, lexicon, grams)) for f in forms]
    words = ["Word,", "12", "İx", "ΑΣ", "'-", "O'X!", "ß9"]
    assert language_crf.all_letters(words) == [language_crf.letters(w) if language_crf.has_letter(w) else "" for w in words]


def test_learning_takes_little_of_the_drivers_memory():
    import tracemalloc

    rnd, n = random.Random(2), language_crf.SEGMENT
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(5000 * n)]
    sequences = [(words[k : k + n], [k // n % 2] * n) for k in range(0, len(words), n)]
    tracemalloc.start()
    try:
        language_crf.LanguageCrf(["a", "b"], set()).fit(sequences, 1, 7)
        assert tracemalloc.get_traced_memory()[1] < 90e6
    finally:
        tracemalloc.stop()


def test_words_of_a_slice_are_weighted_together(monkeypatch):
    forms = odd_forms(100)
    model = language_crf.LanguageCrf(["a", "b"], set(forms[::2]))
    model.weights[:] = np.random.default_rng(1).normal(size=model.weights.shape)
    each = np.stack([np.frombuffer(model.emission(f), "<f4") for f in forms])
    monkeypatch.setattr(language_crf, "word_features", None)  # takes a word at a time
    monkeypatch.setattr(language_crf, "WORDS", 9)
    found, some = model.emissions([*forms, "12"])
    assert np.allclose(found[:-1], each, atol=1e-5) and some.tolist() == [True] * len(forms) + [False]
    langs, scores, marginals = language_crf._Tagger(model).tag(pa.array([None, " ", f"{forms[0]}  12\x1c{forms[1]}\n", "1 2"]))
    assert langs[0] == langs[1] == langs[3] == "und" and langs[2] in "ab" and [len(m) for m in marginals] == [0, 0, 2, 0] and scores[2] > 0
