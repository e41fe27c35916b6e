"""Personal data in forms that no example teaches, licences as people name them, other vocabularies, and how crowds are dealt."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.llm import bpe, license_rules, pii, queries, simhash


# --- personal data ---------------------------------------------------------------------------


def added(spark, texts):
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), id_col="i", text_col="t").orderBy("doc_id").collect()
    return [[(s.split(":")[0], texts[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in r.spans.split(",") if s and s not in r.base_spans.split(",")] for r in rows]


def test_cases_of_the_review(spark):
    got = added(spark, ["I looked at home dot com was not there", "account DE89 3704 0044 0532 0130 00 holds it", "tel (020) 7946 0958"])
    assert got == [[], [], [("phone", "(020) 7946 0958")]]


NAMES = ["priya", "m.okafor", "hans_k", "lucia.v", "t-rex42", "omar77", "yuki.s", "bea"]
HOSTS = ["fastmail", "riverbank", "telco", "unibas", "orchid", "northsea"]


def planted(r):
    """Text with a span in braces; contexts, orders and separators are others than those of the examples."""
    n = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))
    end = r.choice(["com", "org", "net", "fr", "nl", "eu"])
    name, host = r.choice(NAMES), r.choice(HOSTS)
    area = f"{r.randint(2, 9)}{n(2)}"
    return r.choice(
        [
            f"Questions? Drop {{{name} [at] {host} [dot] {end}}} a line",
            f"newsletter by {{{name}(at){host}(dot){end}}}",
            f"signed, {{{name} AT {host} DOT {end}}}",
            f"curator {{{name} {{at}} {host}.{end}}}".replace("{at}", "[at]"),
            f"sinkhole {{{r.randint(11, 220)}[.]{r.randint(0, 255)}[.]{r.randint(0, 255)}[.]{r.randint(0, 255)}}} was listed",
            f"peer {{2a02:{n(3)}:{r.choice('abcdef')}{n(2)}::{r.choice('abcdef')}}} dropped packets",
            f"voicemail of {{({area}) {r.randint(2, 9)}{n(2)}-{n(4)}}} is full",
            f"whatsapp {{{area}-{r.randint(2, 9)}{n(2)}-{n(4)}}} any time",
            f"reception {{(0{r.randint(20, 99)}) {n(4)} {n(4)}}} after nine",
        ]
    )


def harmless(r):
    n = lambda k: "".join(str(r.randint(1, 9)) for _ in range(k))
    return r.choice(
        [
            f"everyone gathered at {r.choice(HOSTS)} dot {r.choice(['then', 'so', 'we'])} spoke",
            f"he glanced at {r.choice(HOSTS)} dot com yesterday",
            f"she was staying at {r.choice(HOSTS)}.org all week",
            f"invoice {n(3)}-{n(3)}-{n(4)} is open",
            f"ticket {n(3)}.{n(3)}.{n(4)} was closed",
            f"account FR76 {n(4)} 00{n(2)} {n(4)} {n(4)} {n(4)} 18",
            f"played {r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)} on tape",
            "nic 3c:22:fb:" + r.choice(["0a:9e:41", "7d:00:1b"]),
            f"model {n(4)}.{n(4)}.{n(4)}.{n(4)} sold out",
            f"verse {r.randint(1, 99)}:{r.randint(1, 50)} was read",
        ]
    )


def test_forms_that_no_example_teaches(spark):
    r = random.Random(21)
    texts, want = [], []
    for _ in range(800):
        if r.random() < 0.5:
            t = planted(r)
            a, b = t.index("{"), t.rindex("}")
            want.append(t[a + 1 : b])
            texts.append(t[:a] + t[a + 1 : b] + t[b + 1 :])
        else:
            texts.append(harmless(r))
            want.append(None)
    got = added(spark, texts)
    right = sum(w is not None and w in [s for _, s in g] for g, w in zip(got, want, strict=True))
    found, planted_ = sum(map(len, got)), sum(w is not None for w in want)
    missed = [(t, g) for t, g, w in zip(texts, got, want, strict=True) if w and w not in [s for _, s in g]][:8]
    wrong = [(t, g) for t, g, w in zip(texts, got, want, strict=True) if g and [s for _, s in g] != [w]][:8]
    assert right >= 0.9 * planted_ and right >= 0.95 * found, (right, planted_, found, missed, wrong)


def test_thresholds_come_from_rows_the_trees_have_not_seen(spark):
    shown = pii.examples(spark)
    for k in range(len(pii.KINDS)):
        mine = [s for s in shown if s[0] == k]
        margins = pii.unseen_margins([], shown, k)
        assert sum(a for _, a, _ in margins) == 10 * sum(s[2] for s in mine) and sum(b for *_, b in margins) == 10 * sum(not s[2] for s in mine)
    # A row whose label only its own fold knows is judged by the others'.
    lone = [{f: 5 for f in pii.FEATURES} | {"k": 0, "good": 9, "bad": 0}]
    assert [m for m in pii.unseen_margins(lone, [], 0)] == [(0.0, 100.0, 0.0)]


def test_what_teaches_is_bounded(spark):
    text = " ".join(f"u{'x' * (i % 30)}{i}@h{i % 7}.com" for i in range(200))
    rows = pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    every, few = pii.teaching_rows(rows, 10_000), pii.teaching_rows(rows, 3)
    assert len(few) == 3 and sum(r["good"] for r in every) == 200 and few == sorted(every, key=lambda r: (-r["good"] - r["bad"], *[r[f] for f in pii.FEATURES]))[:3]


# --- licences --------------------------------------------------------------------------------

NOTICES = {
    "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
    "This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details": "MIT",
    "Licensed under MIT (see LICENSE)": "MIT",
    "Licensed under MIT": None,
    "MIT License": "MIT",
    "Apache License, Version 2.0": "Apache-2.0",
    "This library is released under the Apache 2.0 license.": "Apache-2.0",
    "Licensed to the Apache Software Foundation (ASF) under one or more\n * contributor license agreements.  See the NOTICE file distributed with\n * this work for additional information regarding copyright ownership.\n * The ASF licenses this file to You under the Apache License, Version 2.0\n * (the \"License\"); you may not use this file except in compliance with": "Apache-2.0",
    "# SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
    "/* SPDX-License-Identifier: (GPL-2.0+ OR BSD-3-Clause) AND mit */": "GPL-2.0-or-later,BSD-3-Clause,MIT",
    "// SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note": "GPL-2.0-only,Linux-syscall-note",
    "SPDX-License-Identifier: LicenseRef-Own": "",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.": "GPL-3.0-only",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE": "Apache-2.0",
    "Use of this source code is governed by a BSD-style license that can be\nfound in the LICENSE file.": "LicenseRef-BSD-style",
    "Released under the WTFPL license": "WTFPL",
    "        DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n": "WTFPL",
    "Distributed under the PSF license.": "PSF-2.0",
    "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2": "PSF-2.0",
    "This program is distributed under the terms of the GNU General Public License v3.0 or later, see COPYING license": "GPL-3.0-or-later",
    "Licensed under the GNU LGPL v2.1 license.": "LGPL-2.1-only",
    "He lost his driving license on Monday.": "",
    "The license server at MIT is down.": "",
}


def test_notices_name_their_licence(spark):
    texts = list(NOTICES)
    rows = license_rules.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {texts[r.doc_id]: r.licences for r in rows}
    want = {t: w if w is not None else "MIT" for t, w in NOTICES.items()}
    assert {t: set(filter(None, g.split(","))) for t, g in got.items()} == {t: set(filter(None, w.split(","))) for t, w in want.items()}


def test_every_name_and_identifier_is_found(spark):
    names = list(license_rules.CALLED)
    df = spark.createDataFrame([(n, f"spdx-license-identifier: {s}") for n, s in zip(names, list(license_rules.SPDX) * 9, strict=False)], "n string, s string")
    for r in df.select("n", "s", license_rules.looked_up(license_rules.CALLED, license_rules.called(license_rules._normal(F.col("n")))).alias("a"), license_rules.identified(F.col("s")).alias("b")).collect():
        assert r.a == license_rules.CALLED[r.n] and r.b == [f"SPDX-{license_rules.SPDX[r.s.split(': ')[1]]}"]


# --- byte-level BPE --------------------------------------------------------------------------

#: A public pattern of another tokenizer.
OTHER = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


@pytest.mark.parametrize("pattern", ["own", OTHER])
@pytest.mark.parametrize("joined", [[], [b"\n\n"], [b"  ", b"\r\n", b" \n"]])
def test_other_vocabularies_and_patterns_give_the_library_ids(pattern, joined):
    import tiktoken

    path, own = queries.multi_vocabulary()
    pattern = own if pattern == "own" else pattern
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    for t in joined:
        ranks.setdefault(t, len(ranks) + 7)
    encoder = bpe.Encoder(ranks, bpe.merges_of(ranks), pattern)
    assert encoder.cuts == (pattern == own and not any(t.endswith(b"\n") for t in joined))
    library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    parts = ["a", "Bc", "12", "345", " ", "  ", "\n", "\n\n", "\r\n", "\t", "'s", "'LL", "é", "日本", "　", " ", ".", "--", " ", "😀"]
    texts = ["a\n\nb", "a  b\r\nc", *("".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(4000))]
    for t, entries in zip(texts, encoder.entries(texts), strict=True):
        assert [int(i) for e in entries for i in e[0].split(",")] == library.encode_ordinary(t), repr(t)


def test_cuts_hold_for_the_registered_vocabulary_only():
    path, own = queries.multi_vocabulary()
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    assert bpe.may_cut(ranks, own) and not bpe.may_cut(ranks, OTHER) and not bpe.may_cut(ranks | {b"\x80\n": 1}, own) and not bpe.may_cut(ranks | {b"\t\n": 1}, own)


def test_an_id_outside_the_vocabulary_is_an_error(spark):
    path, _ = queries.multi_vocabulary()
    with pytest.raises(Exception, match="KeyError|999999999"):
        bpe.decode(spark.createDataFrame([(1, [999999999])], "doc_id long, ids array<int>"), path).collect()


# --- near duplicates -------------------------------------------------------------------------


@pytest.mark.parametrize("strays", [1, 5, 40])
def test_only_strays_ask(spark, strays):
    n, block = 2000, 50
    rows = [(7, k, 0 if k < n - strays else k, k, [k]) for k in range(n)] + [(8, 1, 1, 1, [1]), (8, 2, 2, 2, [2])] + [(9, 1, 1, 1, [1]), (9, 2, 1, 2, [2])]
    shard = spark.createDataFrame(rows, "shard long, node long, root long, fp long, hs array<long>")
    dealt = simhash.dealt_blocks(shard, block, 1 << 19).collect()
    askers = -(-strays // block)
    of = Counter(r.shard for r in dealt)
    assert of[7] == (n - strays) * askers + strays * (askers + -(-(n - strays) // block)) and of[8] == 3 - 1 + 2 - 1 and of[9] == 0
    # Each stray meets every other member in one pair of blocks and no pair is dealt without a stray.
    met = Counter()
    by = {}
    for r in dealt:
        if r.shard == 7:
            by.setdefault((r.lo, r.hi), []).append(r)
    for (lo, hi), members in by.items():
        for a in members:
            for b in members:
                if a.node < b.node and (lo == hi or a.own != b.own):
                    met[a.node, b.node] += 1
    assert set(met.values()) == {1} and {p for p in met if p[1] >= n - strays} == {(a, b) for b in range(n - strays, n) for a in range(b)}
    assert all(any(r.root != 0 for r in members) for members in by.values())
