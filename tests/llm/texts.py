"""Small tables with the awkward cases: null and empty texts, odd white space, ties, repeated rows, other columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, ident string, norm string, digest string, bin string, n int"


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["the", "of", "Haus", "été", "don't", "l'eau", "x9", "日本", "<|endoftext|>", "...", "ß", "🙂", "a b"]
    texts = [None, "", " ", "\n\n\n", "One two", "ONE TWO", "one two", "tab\tand\r\nline  two   three", "\x00nul", "a" * 3000, "word " * 5000]
    texts += ["".join(rnd.choice(words) + rnd.choice([" ", "\n", "  ", ", "]) for _ in range(rnd.randint(1, 80))) for _ in range(n)]
    texts += texts[-5:]
    return [(k * 3 - 5, t, "en", "i", "norm", "d", "b", 1) for k, t in enumerate(texts)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
