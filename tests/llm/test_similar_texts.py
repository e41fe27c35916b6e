"""Operator 10 by similarity: crowds of alike texts against all pairs, and the pieces that it is made of."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tracemill.llm import simhash
from tracemill.llm.common import row_key, table


def shingle_sets(rows, width=5):
    out = {}
    for i, t in rows:
        w = [x for x in re.split("[\\x20\\x09-\\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}
    return out


def heads(rows):
    """Smallest id of each component of pairs that share 0.8 of their shingles or more."""
    sets = shingle_sets(rows)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 5 * n >= 4 * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {root(i) for i in sets}


def crowd(n, words, edits, seed):
    """Copies of one text with so many words changed that many pairs come near the bound from both sides."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice(edits)):
            w[r.randrange(words)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("edits", [(2, 4, 6), (5, 6, 7), (9, 12)])
def test_crowds_lose_no_link(spark, edits):
    rows = crowd(700, 220, edits, 3)
    got = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), width=5, similar=True).collect()]
    assert len(got) == len(set(got)) and set(got) == heads(rows)


def test_blocks_lose_no_link(spark):
    rows = crowd(300, 200, (5, 6, 7), 5) + [(1000 + i, t) for i, t in crowd(40, 90, (1, 2), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(*row_key("doc_id", "text"), "text")
    one = simhash._sketched(docs, 5, False).selectExpr("node", "struct(d0, d1, d2, d3) as least", "hs")
    ids = {r.node: r.least.d1 for r in one.collect()}
    up = {i: i for i in ids.values()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in simhash.similar_links(one, docs, 5, block=23).collect():
        a, b = sorted((root(ids[r.a]), root(ids[r.b])))
        up[b] = a
    assert {root(i) for i in up} == heads(rows)


def test_short_and_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "a b c d e f g h i"), (6, "a b c d e f g h i j"), (7, "a b c d e f g h"), (8, "x " * 5000), (9, "x " * 4000), (10, "x")]
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), width=5, similar=True).collect()}
    assert got == heads([(i, t) for i, t in rows if i > 2]) | {1}


def test_overlaps_are_counts():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 6000, n)) for n in (0, 1, 5, 3000, 3000, 6000)]
    got = simhash.overlaps(sets, sets[::-1])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in simhash.keep_one(docs, width=5, similar=True).collect()} == heads(rows)


def test_links_come_from_trees(spark):
    """A pair beyond the trees' radius is no link, whatever the sets say."""
    sets = spark.createDataFrame([(1, 0, [1, 2, 3]), (2, (1 << simhash.WIDE) - 1, [1, 2, 3]), (3, (1 << simhash.WIDE + 1) - 1, [1, 2, 3])], "node long, fp long, hs array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert sorted(map(tuple, simhash._confirmed(pairs, sets).collect())) == [(1, 2), (2, 3)]


def test_the_radius_loses_no_pair_of_the_share():
    """How many bits of fingerprints differ at the share, in small sets and large ones."""
    r = np.random.default_rng(4)
    for a, common, b in ((1, 4, 0), (0, 4, 1), (1, 8, 1), (10, 80, 10), (50, 400, 50)):
        h = lambda n: r.integers(0, 1 << 64, n, dtype=np.uint64)
        for _ in range(300):
            both = h(common)
            x, y = simhash.majority(np.concatenate([both, h(a)])), simhash.majority(np.concatenate([both, h(b)]))
            assert (x ^ y).bit_count() <= simhash.WIDE
