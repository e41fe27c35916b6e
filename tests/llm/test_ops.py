"""The training-data operators against plain versions, and on rows that invite mistakes."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tracemill.llm import bpe, graph, license_rules, line_dedup, mixing, pii, pivot_search, quality_qda, quality_rules, queries, simhash, toxicity
from tracemill.llm.common import crc_bucket, shared_folder, table

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use themselves.
CLASH = "score double, predicted int, fp long, d0 int, d1 int, h1 long, pos int, n int, label int, taken long, size long, spot long, __r0 int, __h0 int, bits int, words string, spans string, x int, sid int, times int"
PASSAGE = "one line here\nanother line\nand a third one\nthen a fourth"


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "naïve", "日本", "😀"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    same = text(80)
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "two words"), (6, same), (7, same), (7, same), (7, text(30)), (None, same), (None, None), (8, PASSAGE), (9, "before\n" + PASSAGE + "\nafter"),
        (10, text(60_000)), (11, "w" * 300_000), (12, "a b c " * 5000), (13, "#$%& " * 40), (14, "mail a@b.co now"), (15, same[:-1]),
    ]
    df = spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit("1").cast(kind))
    return df.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(16)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- every operator on odd rows and on none ---------------------------------


def all_results(docs, labels):
    vocabulary = queries.multi_vocabulary()
    return {
        "toxicity": toxicity.score(docs, labels, per_class=50),
        "qda": quality_qda.classify(docs, labels),
        "qda_keep": quality_qda.keep_good(docs, labels),
        "bpe": bpe.round_trip(docs, *vocabulary),
        "bpe_encode": bpe.encode(docs, *vocabulary),
        "lines": line_dedup.dedup_lines(docs),
        "pii": pii.find(docs),
        "license": license_rules.scan(docs),
        "mix": mixing.mix(docs, block=16),
        "mixed": mixing.mixed_documents(docs, block=16),
        "rules": quality_rules.judge(docs),
        "simhash": simhash.near_duplicates(docs),
        "simhash_keep": simhash.keep_one(docs),
    }


def test_odd_rows_give_a_row_each(odd, labels):
    n = odd.count()
    for name, df in all_results(odd, labels).items():
        got = df.collect()
        if name in ("qda_keep", "mixed", "simhash_keep"):
            assert df.columns == odd.columns, name
        else:
            assert len(got) == n, name
        if name == "lines":
            assert df.columns == odd.columns


def test_no_rows(odd, labels):
    for name, df in all_results(odd.limit(0), labels.limit(0)).items():
        assert df.collect() == [], name
    vectors = odd.sparkSession.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivot_search.top_k(vectors).collect() == []


# --- 1 toxicity ---------------------------------------------------------------


def test_forward_backward_is_the_sum_over_all_paths():
    import itertools
    import math

    import numpy as np

    rng = np.random.default_rng(0)
    emit, lengths, t = rng.normal(size=9), [4, 1, 3, 1], rng.normal(size=(2, 2)).tolist()
    got = toxicity.marginal_logits(emit, lengths, t)[0]
    at = 0
    for n in lengths:
        e = emit[at : at + n]
        for k in range(n):
            z = [0.0, 0.0]
            for path in itertools.product((0, 1), repeat=n):
                w = sum(x * y for x, y in zip(path, e)) + sum(t[a][b] for a, b in zip(path, path[1:]))
                z[path[k]] += math.exp(w)
            assert abs(got[at + k] - math.log(z[1] / z[0])) < 1e-9
        at += n


def test_toxic_documents_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    out = queries.op1_toxic_crf(spark, d).join(labels, "doc_id").where("held_out")
    got = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert got.get((0, 1), 0) <= 2 and got[(1, 1)] >= 0.9 * (got[(1, 1)] + got.get((1, 0), 0))
    span = queries.op1_toxic_crf(spark, d).where("n_toxic > 0 and predicted = 1").join(docs.where("lang = 'en'"), "doc_id").first()
    a, b = map(int, span.spans.split(",")[0].split(":"))
    assert re.fullmatch(r"[^\W\d_]+", span.text[a:b])


def test_scores_do_not_see_labels_of_the_fold(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("toxic", F.when(crc_bucket(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    fold = lambda x: x.where(crc_bucket(F.col("doc_id"), 3) != 1)
    a, b = toxicity.score(docs, fold(labels)), toxicity.score(docs, fold(flipped))
    assert rows_of(a) == rows_of(b)


# --- 2 pivot search -----------------------------------------------------------


def brute_top(vectors, k, every):
    q = [(i, [int(x) for x in v]) for i, v in vectors if v is not None]
    out = []
    for i, v in {i: v for i, v in sorted(q, reverse=True)}.items():
        if i % every == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i and len(w) == len(v)))
            out += [(i, n, j, -x) for n, (x, j) in enumerate(s[:k], 1)]
    return Counter(out)


def test_top_k_is_exact(spark):
    r = random.Random(4)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [b + r.gauss(0, 0.1) for b in r.choice(base)]) for i in range(400)] + [(500 + i, base[0]) for i in range(60)] + [(700, None), (701, [float("nan")] * 6), (702, [1.0, None]), (703, []), (None, base[1]), (800, [1.0, 2.0]), (801, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = rows_of(pivot_search.top_k(df, k=7, every=20, pivots=6, rings=3, sample=80, first=1, block=16))
    import math

    import numpy as np

    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    assert got == brute_top(good, 7, 20)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert rows_of(pivot_search.top_k(df)) == Counter([(0, 1, 1, 2 * 1024 * 1024)])


# --- 3 byte-level BPE ---------------------------------------------------------


def test_ids_are_those_of_the_rank_library(spark, odd):
    import tiktoken

    path, pattern = queries.multi_vocabulary()
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " ", "　", "a", "é", "日", "😀", "1", "½", "!", "'s", "'t", "\x1c", "\x85", "​", "\r\n", "٣", "the", "Straße", ".", ", ", "ā", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in bpe.encode(df, path, pattern).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == enc.encode_ordinary(t)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for x in bpe.round_trip(df, path, pattern).collect():
        ids = got[x.doc_id].ids
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[x.doc_id].encode()))
    back = {x.doc_id: bytes(x.data).decode() for x in bpe.decode(bpe.encode(df, path, pattern), path).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    big = {x.doc_id: x.n_tokens for x in bpe.round_trip(odd.where("doc_id in (10, 11, 12)"), path, pattern).collect()}
    assert big == {x.doc_id: len(enc.encode_ordinary(x.text)) for x in odd.where("doc_id in (10, 11, 12)").collect()}


def test_offsets_cover_split_characters(spark):
    path, pattern = queries.multi_vocabulary()
    text = "a日😀é x"
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, pattern).first()
    with open(path, "rb") as f:
        pieces = {r: b for b, r in bpe.read_ranks(f.read()).items()}
    at = 0
    for i, a, b in zip(row.ids, row.starts, row.ends):
        raw = pieces[i]
        assert raw in text[a:b].encode() or text[a:b].encode() in raw
        at += len(raw)
    assert at == len(text.encode()) and row.starts[0] == 0 and row.ends[-1] == len(text)


# --- 4 quality discriminant -----------------------------------------------------


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op4_quality_qda(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out")
    got = {(r.quality, r.predicted): r["count"] for r in out.groupBy("quality", "predicted").count().collect()}
    assert got.get((0, 1), 0) + got.get((1, 0), 0) <= 1


def test_discriminant_is_the_density_ratio():
    import numpy as np

    k = len(quality_qda.STATISTICS)
    rng = np.random.default_rng(1)
    xs = {c: rng.normal(c, 1 + c, size=(500, k)) for c in (0, 1)}
    model = quality_qda.discriminant({c: (float(len(x)), x.sum(0), x.T @ x) for c, x in xs.items()}, 0.1)
    x = rng.normal(size=(20, k))
    z = (x - np.array(model.center)) / np.array(model.scale)
    want = []
    for c in (0, 1):
        cov = np.linalg.inv(np.array(model.factors[c]).T @ np.array(model.factors[c]))
        m = z - np.array(model.means[c])
        want.append(-0.5 * np.einsum("ij,jk,ik->i", m, np.linalg.inv(cov), m) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.log_odds(x), np.clip(want[1] - want[0], -quality_qda.REACH, quality_qda.REACH), atol=1e-6)


def test_quality_without_labels_is_even(spark, labels):
    docs = table(spark, SF, "documents")
    assert {round(r.score, 9) for r in quality_qda.classify(docs, labels.limit(0)).collect()} == {0.5}


# --- 5 line dedup ---------------------------------------------------------------


def brute_lines(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not any(words(x) for x in w):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone) if gone else t))
    return Counter(out)


def test_lines_match_plain_version(spark):
    r = random.Random(8)
    rows = [(i, "\n".join(r.choice(["a", "b", "", " ", "c d"]) for _ in range(r.randint(0, 12)))) for i in range(120)] + [(None, "a\nb\nc d"), (900, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert rows_of(got.select("doc_id", "text")) == brute_lines(rows)


def test_lines_keep_the_first_passage(odd):
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(odd).where("doc_id in (8, 9)").collect()}
    assert got == {8: PASSAGE, 9: "before\nafter"}


# --- 6 personal data --------------------------------------------------------------


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def base_spans(t):
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 14 <= len(digits(m)) <= 19 and luhn(digits(m)):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(digits(m)) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_match_the_patterns(spark):
    r = random.Random(3)
    parts = ["1", "2", "4000", "0", "255", "256", ".", ".", "@", "a", "b-", "+1 ", "(555)", " ", "-", "x@y.z", "_", "é", "😀", "+", "1.2.3.4", "4111111111111111", "phone ", "\n", "(at)", "[dot]", "com", "437-555-0689", "+1 (437) 555-0689"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(1500)] + [(7000, None), (7001, "9" * 50_000), (7002, "a." * 20_000), (7003, "")]
    texts = dict(rows)
    for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        want = base_spans(texts[x.doc_id] or "")
        assert x.base_spans == want
        assert set(filter(None, want.split(","))) <= set(x.spans.split(","))
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [want.count(f"{k}:") for k in pii.KINDS]


def test_base_spans_of_the_documents(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for x in pii.find(table(spark, SF, "documents")).collect():
        assert x.base_spans == base_spans(texts[x.doc_id] or "")


def test_trees_and_thresholds():
    x = [(a, b, 0, 0, 0, 0, 0) for a in range(6) for b in range(4)]
    good = [10.0 if a > 2 and b < 2 else 0.0 for a, b, *_ in x]
    bad = [0.0 if a > 2 and b < 2 else 10.0 for a, b, *_ in x]
    t = pii.Trees().fit(x, good, bad)
    assert all((t.margin(r) > 0) == (g > 0) for r, g in zip(x, good))
    assert pii.calibrated([(3.0, 9, 1), (2.0, 9, 0), (1.0, 0, 9)], 0.9) == 2.0
    assert pii.calibrated([(1.0, 0, 5)], 0.9) == float("inf")


# --- 7 licences ----------------------------------------------------------------------


def test_licences(spark):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    rows = [(1, "Prose. Released under the MIT License."), (2, mit), (3, "Licensed under the Apache License, Version 2.0."), (4, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."), (5, "A licensed driver has a license."), (6, "no such thing"), (7, None), (8, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.")]
    got = {r.doc_id: r.licences for r in license_rules.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["Apache-2.0"], 4: ["GPL-3.0-only", "CC-BY-NC-4.0"], 5: [], 6: [], 7: [], 8: []}


def test_published_headers_have_their_licence(spark):
    gpl = "This program is free software{0} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{1} either version {2} of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution."
    clause = "\n\n3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License."
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    texts = {
        "GPL-3.0-or-later": [gpl.format(":", ",", 3), gpl.format(";", ";", 3)], "GPL-2.0-or-later": [gpl.format(";", ";", 2), gpl.format(":", ",", 2)], "MPL-2.0": [mpl, mpl.replace("\n", " ")],
        "BSD-3-Clause": [bsd + clause.format("the copyright holder"), bsd + clause.format("Acme Widgets, Inc.")], "BSD-2-Clause": [bsd], "Apache-2.0": [apache], "ISC": [isc],
    }
    rows = [(name, t) for name, ts in texts.items() for t in ts]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in license_rules.scan(df).collect()} == {i: [name] for i, (name, _) in enumerate(rows)}


def test_licence_table_is_sound():
    for s, name in license_rules.SENTENCES.items():
        assert license_rules.normalise(s) == s and any(h in s for h in license_rules.HINTS), s
    known = {*license_rules.SENTENCES.values(), *license_rules.CALLED.values(), *(f"SPDX-{n}" for n in license_rules.SPDX.values())}
    assert all(i in known for _, rule in license_rules.RULES for i in rule)


# --- 8 mixing ----------------------------------------------------------------------------


def brute_mix(rows, block):
    """Targets by redistribution, slots one by one, blocks word by word. rows: (key, source, size, spot)."""
    sizes = Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    target = mixing.source_targets(list(sizes.items()))
    order = sorted(target, key=lambda s: (s is None, s or ""))
    total = sum(target[s] for s in order)
    edges, at = [], 0.0
    for s in order:
        at += target[s]
        edges.append(at / total)
    rank, times = Counter(), Counter()
    for i in range(round(total / block)):
        x = (i * mixing.GOLDEN % mixing.TURN) / mixing.TURN
        s = order[next(k for k, e in enumerate(edges) if x < e or k == len(edges) - 1)]
        blocks = -(-sizes[s] // block)
        if blocks and rank[s] < 2 * blocks:
            times[s, rank[s] % blocks] += 1
        rank[s] += 1
    return target, times


def test_mix_matches_slot_by_slot_version(spark):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["a", "b", "c", "d", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    block = 16
    got = mixing.mix(df, block=block).collect()
    target, times = brute_mix([(x.doc_id, x.source, x.size, x.spot) for x in got], block)
    sized = defaultdict(list)
    for x in got:
        assert x.size == len(words(rows[x.doc_id][1])) and abs(x.target - target[x.source]) < 1e-6 and 0 <= x.taken <= 2 * x.size
        sized[x.source].append(x)
    for s, xs in sized.items():
        at = 0
        buckets = max(16, len(rows) // 20_000)
        for x in sorted(xs, key=lambda x: (((x.spot & (2**64 - 1)) >> 33) % buckets, x.spot, x.doc_id, x.size)):
            assert x.taken == sum(times[s, (at + k) // block] for k in range(x.size))
            at += x.size
        assert abs(sum(x.taken for x in xs) - target[s]) <= 4 * block
    assert rows_of(mixing.mix(df.repartition(7), block=block)) == Counter(tuple(x) for x in got)


def test_small_sources_take_their_target(spark):
    tails = {"t40": 40, "t100": 100, "t400": 400, "t1000": 1000}
    rows = [(s, 2000) for s in "abcdefghijkl" for _ in range(20)] + [(s, n // 4) for s, n in tails.items() for _ in range(4)]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    for r in got:
        assert r.over <= 0 and abs(r.taken - r.target) <= (0.5 if r.source in tails else 0.1 * r.target), r


def test_targets_stop_at_twice_the_source():
    t = mixing.source_targets([("a", 10), ("b", 1000), ("c", 1000), (None, 50)])
    assert t["a"] == 20 and t[None] <= 100 and abs(sum(t.values()) - 1.5 * 2060) < 1e-9 and all(t[s] <= 2 * n + 1e-9 for s, n in [("b", 1000), ("c", 1000)])
    assert mixing.source_targets([]) == {} and mixing.source_targets([("a", 0)]) == {"a": 0.0}


# --- 9 quality rules ------------------------------------------------------------------------


def test_rule_statistics_match_plain_version(spark, odd):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 100_000).dropDuplicates(["doc_id"]))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for x in quality_rules.judge(docs).collect():
        t = texts[x.doc_id] or ""
        w = words(t)
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [s for s in t.split("\n") if words(s)]
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and (not x.kept or not x.base_failed)


def test_em_finds_reliable_rules():
    r = random.Random(0)
    votes = Counter()
    for _ in range(4000):
        good = r.random() < 0.8
        v = tuple((-1 if r.random() < (0.02 if good else 0.7) else 0) for _ in range(3)) + ((-1 if r.random() < 0.3 else 0),)
        votes[v] += 1
    base, w = quality_rules.fit_rules(sorted(votes.items()))
    assert base > 0 and all(w[j][-1] < -2 for j in range(3)) and w[3][-1] > -0.7
    quality_rules.fit_rules([])


def test_rules_keep_clean_documents(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op9_quality_rules(spark, d).join(table(spark, d, "labels"), "doc_id").where("not base_failed")
    got = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) <= 0.01 * got[(1, True)] and got.get((0, True), 0) <= 0.1 * got[(0, False)]


# --- 10 SimHash -----------------------------------------------------------------------------


def brute_fingerprint(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", w) if x]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def brute_components(fps):
    """fps: (id, fingerprint) of all rows."""
    up = {f: f for _, f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    distinct = sorted(up)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[root(b)] = root(a)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return Counter((i, f"{f:016x}", least.get(root(f))) for i, f in fps)


def test_fingerprints_and_components(spark, odd):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id is null or doc_id not in (10, 11)"))
    got = rows_of(simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id"))
    assert got == brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])


@pytest.mark.parametrize("tree_size", [3, 50])
def test_crowded_shards_lose_no_link(spark, tree_size):
    r = random.Random(7)
    centres = [r.getrandbits(64) for _ in range(4)]
    fps = set()
    for c in centres:
        x = c
        for _ in range(60):
            x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(100)} | {0, 2**64 - 1, 2**63}
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    df = spark.createDataFrame(signed, "fp long").repartition(5)
    roots = {x.node: x.root for x in graph.connected_components(simhash.shard_links(df, tree_size)).collect()}
    mine = defaultdict(set)
    for (x,) in signed:
        mine[roots.get(x, x)].add(x % 2**64)
    want = defaultdict(set)
    for i, f, c in brute_components([(k, x) for k, x in enumerate(sorted(fps))]):
        want[c].add(int(f, 16))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_bk_tree_follows_only_edges_within_the_radius():
    r = random.Random(0)
    xs = [r.getrandbits(16) for _ in range(300)]
    tree = simhash.BKTree()
    for x in xs:
        tree.add(x)
    for q in xs[:50]:
        assert set(tree.within(q, 3)) == {x for x in xs if (x ^ q).bit_count() <= 3}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, d)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert sorted(after.columns) == sorted(columns)
        if name == "quality":
            scores = {r.doc_id: r.predicted for r in queries.op4_quality_qda(spark, d).collect()}
            assert {r.doc_id for r in after.collect()} == {i for i, p in scores.items() if p}
        if name == "lines":
            assert rows_of(after.select("doc_id", "text")) == brute_lines([(r.doc_id, r.text) for r in before.collect()])
        if name == "near_duplicates":
            # Texts without words share the empty shingle, so they are one group.
            want = brute_near_copies([(r.doc_id, r.text) for r in before.collect()])
            assert Counter(r.doc_id for r in after.collect()) == Counter(want)
        if name == "mixture":
            want = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.mix(before).where("size > 0").collect()}
            assert Counter(r.doc_id for r in after.collect()) == Counter({i: n for i, n in want.items() if n})
        if name == "tokens":
            assert Counter((r.doc_id, r.decoded_sha256) for r in after.collect()) == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in before.collect())
        before = after
    assert rows_of(corpus_pipeline.run(spark, d)) == rows_of(before)
    shared = shared_folder(spark).removeprefix("file:")
    left = [f for f in os.listdir(shared) if f.startswith("pipeline-")]
    assert left and all(os.listdir(os.path.join(shared, f)) == ["tokens"] for f in left)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in rel.columns) for r in df.collect()) == Counter(rel.fetchall())


def test_crowded_parts_lose_no_link(spark):
    r = random.Random(11)
    centre, fps = r.getrandbits(64), set()
    while len(fps) < 90:
        x = centre
        for _ in range(r.randint(1, 4)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    want = Counter(c for *_, c in brute_components([(k, x) for k, x in enumerate(sorted(fps))]).elements())
    roots = {x.node: x.root for x in graph.connected_components(simhash.shard_links(df, 7, 11)).collect()}
    got = Counter(roots.get(x.fp, x.fp) for x in df.collect())
    assert sorted(got.values()) == sorted(want.values())


def brute_near_copies(rows):
    """Ids that stay of rows (id, text): the smallest of each component of pairs with five-word Jaccard of 0.8 or more."""
    sets, up = {}, {}
    for i, t in rows:
        w = [x for x in re.split("[\\x20\\x09-\\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i], up[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}, i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 5 * n >= 4 * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {root(i) for i in sets}


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(2000)]
    rows = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(60, 600)))) for k in range(60)]
    for k in range(60, 220):
        w = rows[r.randrange(60 if k < 160 else k)][1].split()
        for _ in range(max(1, int(len(w) * r.choice([0.005, 0.01, 0.02, 0.05])))):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((k, " ".join(w)))
    rows += [(300, ""), (301, None), (302, "one"), (303, "One "), (304, "two words")]
    rows += [(1000 + x.doc_id, x.text) for x in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near_copies(rows)
    assert len([i for i in got if i < 220]) < 150
