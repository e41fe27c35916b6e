"""Repeated three-word windows of operator 9, also where different windows share a hash."""

import random
from collections import Counter

from tracemill.llm import quality_rules


def repeated(text):
    words = (text or "").split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})


def test_equal_hashes_of_different_windows_hide_no_repeat(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    texts += [None, "", "a", "a b", "a b c", "a a a a", "a b c a b c", "x y z " * 40, " ".join(map(str, range(3000)))]
    want = {i: repeated(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bits in (0, 1, 3, 64):
        got = {r.doc_id: r.n_repeat_words for r in quality_rules.text_statistics(docs, hash_bits=bits).select("doc_id", "n_repeat_words").collect()}
        assert got == want, bits
