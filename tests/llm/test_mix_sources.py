"""The mix over many small sources, against targets and blocks worked out here."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.llm import mixing


def plain_targets(sizes):
    """By raising a common level little by little: what a source may take at level t is min(2 * size, weight * t)."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = 1.5 * sum(sizes.values())
    lo, hi = 0.0, 4.0 * sum(sizes.values()) + 1
    for _ in range(200):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if sum(min(2 * n, weight[s] * t) for s, n in sizes.items()) < want else (lo, t)
    return {s: min(2.0 * n, weight[s] * hi) for s, n in sizes.items()}


def mixed(spark, rows, **kw):
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    return df, mixing.mix(df, **kw)


SHAPES = {
    "300 of 40 words": [(f"s{i:03}", 40) for i in range(300)],
    "24 of 130 words": [(f"s{i:02}", 130) for i in range(24)],
    "one word each": [(f"s{i:04}", 1) for i in range(900)],
    "all sizes": [(f"a{i}", n) for i, n in enumerate([1, 2, 3, 40, 130, 700, 5000, 20_000] * 5)] + [("hot", 700)] * 100 + [(None, 50)] * 4,
    "many documents": [(random.Random(i).choice("abcdefg") * (1 + i % 5), i % 211) for i in range(4000)],
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_sources_come_near_their_targets(spark, shape):
    rows = SHAPES[shape]
    df, out = mixed(spark, rows)
    got = out.collect()
    sizes, docs, took = defaultdict(int), defaultdict(list), defaultdict(int)
    for s, n in rows:
        sizes[s] += n
        docs[s].append(n)
    target = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.size == rows[r.doc_id][1] and r.source == rows[r.doc_id][0] and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        took[r.source] += r.taken
    for s in sizes:
        assert abs(took[s] - target[s]) <= max(0.5, 0.02 * target[s]), (s, took[s], target[s])
    assert sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_large_sources_follow_the_schedule(spark):
    rows = [("a", 300)] * 900 + [("b", 300)] * 500 + [("c", 300)] * 300 + [("d", 77)] * 3
    _, out = mixed(spark, rows)
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= max(0.5, 0.02 * r.target), r


def test_lattice_deals_each_source_evenly(spark):
    rows = [(i, 0, 4, n) for i, n in enumerate([50, 1, 200, 7, 0, 30])]
    got = defaultdict(list)
    for r in mixing.lattice(spark.createDataFrame(rows, "sid long, part long, level int, slots long")).collect():
        got[r.sid].append((r.slot, r.rank))
    assert {i: len(got[i]) for i, *_ in rows} == {i: n for i, _, _, n in rows}
    assert sorted(s for x in got.values() for s, _ in x) == list(range(288))
    for i, x in got.items():
        assert [k for _, k in sorted(x)] == list(range(len(x)))
    for at in range(0, 288, 48):
        assert abs(sum(at <= s < at + 48 for s, _ in got[2]) - 200 / 6) <= 4
