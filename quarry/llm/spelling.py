"""Spelling variants of a corpus' words by pairless wildcard groups.

Two words are near if one insertion, deletion or replacement of a code point turns one into the other. Words that differ by a replacement share a
group (position, prefix, suffix): the word with a wildcard at that position. A group keeps its size and its two top words, which is all that a member needs: its
near words there are the others, and the best of them is the top word or, for the top word itself, the second. Insertions and deletions are one thing
seen from two sides: a word's deletions join the vocabulary, and the group of a word's own key holds the longer words that lead to it. Both kinds of group
are dealt by one shuffle; each word's groups are then summed. No pair of words is ever a row of its own.

A key is the sum of two 64-bit mixes of (code point, position), so a word of n letters costs n keys of fixed size, however long it is; two
different keys are equal with a chance of 2^-128. A group has no more members than there are letters (times positions, for deletions),
so none is large, and counting combines on the map side, so a word that fills a third of the corpus is one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, ascii_lower, documents, quoted, text_slices

#: Letters of words.
LETTERS = r"A-Za-zÀ-ÿ"
#: Kinds of keys: a word with a wildcard, a word without one of its code points, the word itself.
WILD, SHORTER, OWN = 0, 1, 2


def counted_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters in whole texts, A-Z lower-cased, of at least `least_length` code points and `least_count` occurrences.

    With `slip`, one in so many occurrences loses a code point first, by the crc32 of `<id>:<run>` (a null id is empty there). Null and empty texts have
    no words; repeated rows count each; other columns are not looked at.
    """
    run = F.explode(F.regexp_extract_all(F.col(quoted(text_col)), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).alias("ident"), run.alias("run"))
    is_ascii = F.octet_length("run") == F.length("run")
    rows = rows.select("ident", F.when(is_ascii, F.lower("run")).otherwise(ascii_lower(F.col("run"))).alias("word"))
    if slip:
        rows = rows.withColumn("h", F.crc32(F.concat("ident", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        rows = rows.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _placed(code: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit value of a code point at a place."""
    return _mix(_mix(code.astype(np.uint64) + np.uint64(seed << 32)) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])


#: Stands for the wildcard; no code point.
ANY = 0x110000


def edit_keys(words: pa.Array, least_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the keys of words, the kind of each key and the number of its word: a wildcard at each place, each distinct deletion that leaves `least_length` code points, the word itself."""
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    code = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(code)) - start[of]
    # equal neighbours give the same deletion: the first of them stands for all
    cut = (size[of] > least_length) & ((place == 0) | (code != np.concatenate([[0], code[:-1]])))
    halves = []
    for seed in (1, 2):
        here, before = _placed(code, place, seed), _placed(code, place - 1, seed)
        to, back = _sums(here), _sums(before)
        own = to[start + size] - to[start]
        wild = own[of] - here + _placed(np.full(len(code), ANY), place, seed)
        k = np.arange(len(code))
        shorter = to[k] - to[start[of]] + back[(start + size)[of]] - back[k + 1]
        halves.append(np.concatenate([wild, shorter[cut], own]).view(np.int64))
    kinds = np.repeat(np.array([WILD, SHORTER, OWN], np.int8), [len(code), int(cut.sum()), len(size)])
    return halves[0], halves[1], kinds, np.concatenate([of, of[cut], np.arange(len(size))])


def _keys(words: DataFrame, least_length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1, 8192, 1 << 18):
            ident, n = b.column(0).to_numpy(), b.column(2).to_numpy()
            k1, k2, kind, of = edit_keys(b.column(1), least_length)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, kind, ident[of], n[of])], ["k1", "k2", "kind", "id", "n"])

    return words.select("id", "word", "n").mapInArrow(run, "k1 long, k2 long, kind byte, id long, n long")


def near_words(words: DataFrame, least_length: int) -> DataFrame:
    """id, n_near, best (n, id): of each word (id, word, n) that has near words, their number and the most frequent one (the smallest id of equals)."""
    order = Window.partitionBy("k1", "k2").orderBy(F.desc("kind"), F.desc("n"), "id")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct("n", (-F.col("id")).alias("back"))
    rows = _keys(words, least_length).select(
        "id", "kind",
        F.row_number().over(order).alias("place"), F.count(F.lit(1)).over(group).alias("size"),
        F.first("kind").over(group).alias("top_kind"), F.first(member).over(group).alias("top"), F.nth_value(member, 2).over(group).alias("second"),
    ).where("size > 1")
    others, is_top = F.col("size") - 1, F.col("place") == 1
    # a deletion is near the word that has its key, if there is one; the key of a word is the first of its group
    rows = rows.where((F.col("kind") != SHORTER) | (F.col("top_kind") == OWN))
    n = F.when(F.col("kind") == SHORTER, F.lit(1)).otherwise(others)
    best = F.when(is_top, F.col("second")).otherwise(F.col("top"))
    found = rows.select("id", n.cast("long").alias("n_near"), best.alias("best")).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
    return found.select("id", "n_near", F.struct(F.col("best.n").alias("n"), (-F.col("best.back")).alias("id")).alias("best"))


def _roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """id, root: where each chain of forms (id, form) ends. Each step doubles how far every pointer reaches; chains are as short as counts have factors."""
    current, step = scratch.write(forms.toDF("id", "root"), "roots0"), 0
    while True:
        step += 1
        on = current.select(F.col("id").alias("root"), F.col("root").alias("further"))
        jumped = current.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        jumped = scratch.write(jumped, f"roots{step}")
        if jumped.where("moved").isEmpty():
            return jumped.select("id", "root")
        current = jumped.select("id", "root")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of `counted_words`.

    form is the near word of largest n (of equals the smallest in code-point order) if it occurs at least `ratio` times as often, else null; root follows
    the forms to the last. Empty tables give no rows. Words of any length are compared whole.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word, or chains of forms would not end")
    scratch = Scratch(docs.sparkSession, "spelling")
    counts = scratch.write(counted_words(docs, least_length, least_count, slip, id_col, text_col), "counts")
    # ids ascend with the words, so the smaller id is the smaller word; they are written once and only read from there
    words = scratch.write(counts.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = scratch.write(near_words(words, least_length), "near")
    both = words.join(near, "id", "left").withColumn("has_form", F.col("best.n") >= F.col("n") * ratio)
    forms = both.where("has_form").select("id", F.col("best.id").alias("form"))
    roots = _roots(scratch, forms)
    spelt = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    root = words.select(F.col("id").alias("root_id"), F.col("word").alias("root_word"))
    formed = both.where("has_form").join(roots.withColumnRenamed("root", "root_id"), "id").withColumn("form_id", F.col("best.id")).join(spelt, "form_id").join(root, "root_id")
    plain = both.where("NOT coalesce(has_form, false)")
    near_n = F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")
    found = formed.select("word", "form", F.col("root_word").alias("root"), "n", near_n, F.col("best.n").alias("form_n"))
    return found.unionByName(plain.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", near_n, F.lit(None).cast("long").alias("form_n")))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), slip=31)


#: crc32 by its table, which is made from the polynomial; letters have one or two bytes.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t
), runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS ident,
           translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents
), bytes AS (
    SELECT run, flatten(list_transform(string_split(ident || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)) AS b FROM runs
), hashed AS (
    SELECT run, xor(list_reduce(list_transform(b, lambda x: CAST(x AS BIGINT)), lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes, crc
), slipped AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
), words AS (
    SELECT word, count(*) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), places AS (
    SELECT word, n, unnest(range(length(word))) AS i FROM words
), wild AS (
    SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS k FROM places
), shorter AS (
    SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS k FROM places
), pairs AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM wild a JOIN wild b USING (k) WHERE a.word <> b.word
    UNION ALL SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.k
    UNION ALL SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.k
), near AS (
    SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM pairs GROUP BY word
), best AS (
    SELECT word, n_near, best_n, min(other) AS other FROM near JOIN pairs USING (word) WHERE other_n = best_n GROUP BY ALL
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN other END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words LEFT JOIN best USING (word)
), steps AS (
    SELECT word, word AS last, 0 AS step FROM words
    UNION ALL SELECT s.word, f.form, s.step + 1 FROM steps s JOIN formed f ON f.word = s.last WHERE f.form IS NOT NULL
), roots AS (
    SELECT word, arg_max(last, step) AS root FROM steps GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""
