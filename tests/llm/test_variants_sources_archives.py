"""Spelling variants, source divergence and WARC archives against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from quarry.llm import divergence, queries, spelling, warc
from quarry.llm.common import Scratch
from tests.llm.texts import frame, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NULL = object()


def tables(spark, name, data, schema, **more):
    folder = Scratch(spark, "made").path
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


# spelling variants


def brute_words(docs, slip):
    found = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(docs, slip, ratio=10):
    words, out, forms = brute_words(docs, slip), {}, {}
    around = {w: [x for x in words if near(w, x)] for w in words}
    for w, n in words.items():
        best = min(around[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= ratio * n else None
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n, len(around[w]), words.get(forms[w]))
    return out


def word_docs():
    rnd, base = random.Random(5), ["straße", "kilometer", "kilometers", "aaaaaaaa", "élévation", "elevations", "unglaublich"]
    words = list(base)
    for w in base:
        for _ in range(12):
            k = rnd.randrange(len(w))
            words.append(rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("aeiouéß×") + w[k:], w[:k] + rnd.choice("aeiouéÿ") + w[k + 1 :]]))
    docs = [(d, " ".join(rnd.choices(words, [200 if w in base else rnd.randint(1, 9) for w in words], k=rnd.randint(0, 150)))) for d in range(150)]
    docs += [(None, "Kilometer KILOMETER kilometEr, élÉvation"), (7, None), (8, ""), (7, "kilometre kilometre")]
    return docs + [(1000 + k, "b" * 5000 + "a" + "c" * k + " " + "b" * 5001 + "c" * k) for k in (0, 1, 1, 0)]


@pytest.mark.parametrize("slip", [None, 31, 3])
def test_variants_equal_brute_force(spark, slip):
    docs = word_docs()
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(df, slip=slip).collect()}
    assert found == brute_variants(docs, slip)
    assert any(f for f, *_ in found.values()) and any(f and f != r for f, r, *_ in found.values())


def test_variants_of_odd_tables(spark):
    assert spelling.spelling_variants(frame(spark, []).where("false"), slip=31).collect() == []
    odd = [(d, t) for d, t, *_ in rows()]
    found = {r["word"]: r["n"] for r in spelling.spelling_variants(frame(spark), slip=31).collect()}
    assert found == brute_words(odd, 31)
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame(spark), ratio=1)


def test_equal_keys_are_equal_edits():
    words = ["aabbccdd", "aabbccd", "aabbcdd", "xabbccdd", "aabbccdde", "ddccbbaa"]
    k1, k2, kind, of = spelling.edit_keys(pa.array(words), 7)
    by_key = defaultdict(set)
    for a, b, k, o in zip(k1.tolist(), k2.tolist(), kind.tolist(), of.tolist(), strict=True):
        by_key[a, b].add((k, words[o]))
    plain = defaultdict(set)
    for w in words:
        plain[w].add((spelling.OWN, w))
        for i in range(len(w)):
            plain[w[:i] + "*" + w[i + 1 :]].add((spelling.WILD, w))
            if len(w) > 7:
                plain[w[:i] + w[i + 1 :]].add((spelling.SHORTER, w))
    assert sorted(map(sorted, by_key.values())) == sorted(map(sorted, plain.values()))


# source divergence


def terms_of(t):
    return [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]


def brute_divergence(docs, least, top=10):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = terms_of(text)
        counts[lang, source].update(own)
        df[lang].update(set(own))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = [s for x, s in groups if x == lang]
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def p(c, kept=kept):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        ps, q = {s: p(counts[lang, s]) for s in sources}, p(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)}
            own = [(-f(ps[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and ps[s][t] > q[t]]
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(own)[:top], 1)}
    return out


def source_docs():
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ("the", "Of", "été", "日本", "🙂x", "zz") for b in ("", "a", "B", "ßc", "dd")]
    docs = []
    for _ in range(220):
        s = rnd.choice(["s1", "s2", "s3", None, "s1", "s1"])
        k = {"s1": 0, "s2": 10, "s3": 20, None: 5}[s]
        docs.append((rnd.choice(["en", "en", "fr", None]), s, "".join(rnd.choice(words[k : k + 10] + words[:3]) + rnd.choice([" ", "-", "1", "\n"]) for _ in range(rnd.randint(0, 40)))))
    return docs + [("xx", "only", "one two"), ("yy", "a", ""), ("yy", "b", None), ("en", "empty", "123 ... \x00"), ("en", "s1", "the " * 20000)] + docs[:5]


@pytest.mark.parametrize("least", [1, 10, 40])
def test_divergence_equals_brute_force(spark, least):
    docs = source_docs()
    df = spark.createDataFrame([(x, s, t, "n") for x, s, t in docs], "lang string, source string, text string, term string").repartition(5)
    found = [tuple(r) for r in divergence.source_divergence(df, least).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_divergence(docs, least)


def test_divergence_of_an_empty_table(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(df).collect() == []


def test_sketch_never_underestimates(spark):
    docs = [("en", "s", " ".join(f"w{chr(97 + k % 26)}{'x' * (k // 26)}" for k in range(400) if d % (1 + k // 20) == 0)) for d in range(60)]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(4)
    slots = 1 << 18
    bits = divergence.document_sketch(df, 10, slots)
    t = divergence._Terms(pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*docs, strict=True)], ["lang", "source", "text"]))
    at, frequency = t.slots(slots), Counter(t.term.tolist())
    for k in range(len(t.term)):
        if frequency[t.term[k]] >= 10:
            assert all(bits[(at[r][k] + r * slots) >> 3] >> (7 - (int(at[r][k]) & 7)) & 1 for r in range(divergence.ROWS))
    assert 0 < sum(bin(x).count("1") for x in bits.tolist()) <= 2 * len(frequency)


def test_probabilities_stay_exact_for_counts_beyond_a_long_product(spark):
    df = spark.createDataFrame([(5, 10), (12_345_678_901_234, 98_765_432_109_876)], "n long, m long")
    got = [r[0] for r in df.select(divergence._probability(df["n"], df["m"])).collect()]
    assert got == [1 + 10**9 * (n + 2) // m for n, m in ((5, 10), (12_345_678_901_234, 98_765_432_109_876))]


# WARC


def nasty_pages():
    record = warc.VERSION + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    payloads = [
        None, "", "x", "a" * 999, "a" * 1000, "a" * 1000, "é" * 500, "é" * 500, "é" * 499, "\r\n\r\n" * 400, warc.CUT, warc.CUT * 50, record * 30, "\r\n\r\n" + record * 3, "text " + warc.END + record,
        "\r\n\r\nWARC/1.\r\n\r\n\r\nWARC/1.1\r", "\r\n\r\n\r\n\r\nWARC/1.1\r\n" * 20, "\r\n\r\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\n", warc.CUT + "Content-Length: 7\r\n\r\n" + "z" * 2000, "日本語🙂" * 700, "日本語🙂" * 700,
    ]
    data = [(k * 7 % 23 - 4, f"http://h/{k}?a b\r\n\r\nWARC/1.1\r\n" if k % 3 else None, p) for k, p in enumerate(payloads)]
    return [*data, (None, "u", "é" * 500), (None, "u", "n" * 1500), (50, "u", "r" * 1200), (50, "u", "r" * 1200), (50, "v", "r" * 1200), (3, "v", "r" * 1200), (None, None, "w" * 1000), (None, None, "w" * 1000)]


def brute_warc(pages):
    groups, out = defaultdict(list), Counter()
    for k, (i, _, p) in enumerate(pages):
        raw = (p or "").encode()
        if len(raw) >= 1000:
            groups[raw].append(((i is not None, i or 0), k))
    first = {raw: max(g, key=lambda x: (x[0], -x[1])) for raw, g in groups.items()}
    for k, (i, _, p) in enumerate(pages):
        raw = (p or "").encode()
        revisit = raw in first and first[raw][1] != k
        out[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", pages[first[raw][1]][0] if revisit else None] += 1
    return out


@pytest.mark.parametrize("split", ["100", "1500", "128m"])
def test_op13_whatever_payloads_hold_and_wherever_files_are_split(spark, split):
    pages = nasty_pages()
    folder = tables(spark, "pages", pages, "page_id long, url string, html string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = Counter(tuple(r) for r in queries.QUERIES["op13_warc"](spark, folder).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == brute_warc(pages)


def test_warc_fields_payloads_and_gzip(spark):
    pages = [(1, "http://h/a", "p" * 20 + warc.CUT + "q"), (2, None, "")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id int, url string, html string, key string").coalesce(1)
    for compression in ("none", "gzip"):
        path = f"{Scratch(spark, 'warc-test').path}/a"
        warc.write_warc(warc.warc_records(df), path, compression)
        found = {r["record_id"]: r for r in warc.read_warc(spark, path).collect()}
        assert bytes(found["<urn:page:1>"]["payload"]).decode() == pages[0][2] and found["<urn:page:1>"]["uri"] == "http://h/a"
        assert bytes(found["<urn:page:2>"]["payload"]) == b"" and found["<urn:page:2>"]["uri"] is None and found["<urn:page:2>"]["refers_to"] is None


def test_broken_archives_raise_and_empty_ones_are_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"{Scratch(spark, 'warc-test').path}/a"
    warc.write_warc(warc.warc_records(empty), path)
    assert warc.read_warc(spark, path).collect() == []
    good = warc.warc_records(spark.createDataFrame([(1, "u", "h" * 50), (2, "u", "i")], "page_id long, url string, html string").coalesce(1)).collect()
    for bad in ("".join(r["record"] for r in good), good[0]["record"][:-3], "no archive"):
        path = f"{Scratch(spark, 'warc-test').path}/a"
        spark.createDataFrame([(bad,)], "record string").coalesce(1).write.option("lineSep", warc.END).text(path)
        with pytest.raises(ValueError, match="chain of records"):
            warc.read_warc(spark, path)


def test_records_of_other_makers(spark):
    """Other versions of blocks: no HTTP header, other fields and cases, binary payloads."""
    block = bytes(range(256)) + warc.CUT.encode()
    raw = b"WARC/1.1\r\ncontent-length: 3\r\nWARC-Type: warcinfo\r\n\r\nabc\r\n\r\n" + b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Type: image/png\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    path = f"{Scratch(spark, 'warc-test').path}"
    import os

    os.makedirs(path.removeprefix("file://"))
    with open(f"{path.removeprefix('file://')}/a.warc", "wb") as f:
        f.write(raw)
    found = {r["type"]: bytes(r["payload"]) for r in warc.read_warc(spark, path).collect()}
    assert found == {"warcinfo": b"abc", "resource": block}
