"""Scores of the trained operators against plain versions that go document by document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tracemill.llm import quality_qda, quality_rules, queries, toxicity
from tracemill.llm.common import crc_bucket, table

SF = "/root/testdata/sf0.01"


def plain_marginals(emissions, trans):
    """P(state 1) of each token by summing over forward and backward weights, in plain numbers."""
    n = len(emissions)
    fwd = [[0.0, 0.0] for _ in range(n)]
    bwd = [[1.0, 1.0] for _ in range(n)]
    w = lambda i, k: math.exp(emissions[k]) if i else 1.0
    for k in range(n):
        for j in (0, 1):
            fwd[k][j] = w(j, k) * (sum(fwd[k - 1][i] * math.exp(trans[i][j]) for i in (0, 1)) if k else 1.0)
    for k in range(n - 2, -1, -1):
        for i in (0, 1):
            bwd[k][i] = sum(math.exp(trans[i][j]) * w(j, k + 1) * bwd[k + 1][j] for j in (0, 1))
    return [fwd[k][1] * bwd[k][1] / (fwd[k][0] * bwd[k][0] + fwd[k][1] * bwd[k][1]) for k in range(n)]


def plain_toxic(crf, text):
    chains, last = [[]], 0
    for m in re.finditer(r"[^\W\d_]+|[.!?\n]", text or ""):
        if m[0] in ".!?\n":
            chains.append([])
        else:
            if len(chains[-1]) == toxicity.CHAIN:
                chains.append([])
            chains[-1].append((m[0].lower(), m.span()))
        last = m.end()
    spans, top, total, n = [], -8.0, 0.0, len(re.findall(r"[^\W\d_]+|[.!?\n]", text or ""))
    for c in filter(None, chains):
        for p, (_, span) in zip(plain_marginals([crf.emissions([w])[0] for w, _ in c], crf.trans), c):
            top = max(top, math.log(p / (1 - p)) if 0 < p < 1 else 30.0)
            if p > 0.5:
                spans.append(span)
                total += p
    z = [1.0, max(-8.0, min(8.0, top)), math.log1p(total), math.log1p(n) if total > 0 else 0.0]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, crf.calibration)))), spans


def test_toxic_scores_and_spans(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    labels = labels.where(crc_bucket(labels["doc_id"], 3) != 1)
    crf = toxicity.fit_crf(toxicity.sample(docs.select("doc_id", "text"), labels, 1500))
    texts = {r.doc_id: r.text for r in docs.collect()}
    hits = 0
    for r in toxicity.score(docs, labels).collect():
        score, spans = plain_toxic(crf, texts[r.doc_id])
        assert abs(r.score - score) < 1e-6 and r.spans == ",".join(f"{a}:{b}" for a, b in spans) and r.n_toxic == len(spans)
        hits += bool(spans)
    assert hits


@pytest.mark.parametrize("text", ["İİİ ok badword here", "ok BADWORD here. badword", "ΑΣ badword ﬁ İ badword", "bad word"])
def test_offsets_are_those_of_the_text_itself(text):
    class Stub:
        trans = [[0.0, 0.0], [0.0, 0.0]]

        def emissions(self, words):
            return [5.0 if w == "badword" else -5.0 for w in words]

    (_, _, _, spans), *_ = list(toxicity.Scorer(Stub()).documents([text]))
    assert [text[a:b].lower() for a, b in spans] == ["badword"] * text.lower().count("badword")


def test_long_and_many_labelled_rows_are_sampled(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 2 else 300)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i // 2) % 2) for i in range(100)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, 20, longest=100)
    assert 0 < len(got) < 40 and all(len(t) == 10 for t, _ in got)
    assert len(toxicity.sample(docs.unionAll(docs).unionAll(docs), labels, 5, longest=1000)) == 20


def test_quality_scores(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    labels = labels.where(crc_bucket(labels["doc_id"], 5) != 0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    x = {i: quality_qda.statistics(t) for i, t in texts.items()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and r.doc_id in x}
    moments = {}
    for c in (0, 1):
        rows = np.array([x[i] for i in sorted(y) if y[i] == c])
        moments[c] = (float(len(rows)), rows.sum(axis=0), rows.T @ rows)
    raw = quality_qda.discriminant(moments, 0.1)
    bins = Counter((y[i], int(np.rint(raw.log_odds([x[i]])[0] / quality_qda.BIN))) for i in y)
    a, b = quality_qda.platt([(c, k * quality_qda.BIN, n) for (c, k), n in bins.items()])
    for r in quality_qda.classify(docs, labels).collect():
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * float(raw.log_odds([x[r.doc_id]])[0])))))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(want >= 0.3)
    kept = {r.doc_id for r in quality_qda.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in quality_qda.classify(docs, labels).where("predicted = 1").collect()}


def test_rule_posteriors(spark):
    rows = {r.doc_id: r for r in quality_rules.judge(table(spark, SF, "documents")).collect()}
    ratio = lambda a, b: a / max(b, 1)

    def votes(r):
        mean, repeats, stops = ratio(r.word_chars, r.n_words), ratio(r.n_repeat_words, r.n_words), ratio(r.n_stops, r.n_words)
        variety = ratio(r.n_distinct, r.n_words) * math.sqrt(r.n_words)
        return (
            -1 if ratio(r.n_symbols, r.n_words) > 0.2 else 0,
            -1 if ratio(r.n_symbols, r.word_chars) > 0.05 else 0,
            -1 if ratio(r.n_letters, r.word_chars) < 0.8 else 0,
            -1 if mean < 3 or mean > 12 else 0,
            -1 if ratio(r.n_dup_lines, r.n_lines) > 0.3 else 0,
            -1 if repeats > 0.3 else 0,
            -1 if ratio(r.n_doubled, r.n_words) > 0.2 else 0,
            -1 if variety < 3 else 1 if variety > 6 else 0,
            -1 if stops < 0.005 else 1 if 0.02 < stops < 0.5 else 0,
        )

    v = {i: votes(r) for i, r in rows.items()}
    base, weight = quality_rules.fit_rules(sorted(Counter(v.values()).items()))
    for i, r in rows.items():
        p = 1 / (1 + math.exp(-(base + sum(w[x] for w, x in zip(weight, v[i])))))
        assert abs(p - r.posterior) < 1e-9 and r.kept == (not r.base_failed and p >= 0.5)


def test_queries_are_all_here():
    assert len(queries.queries()) == 11
