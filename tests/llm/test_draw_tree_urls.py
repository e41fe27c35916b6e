"""Importance resampling, the Merkle tree and the URL filter against plain versions, and on rows that invite mistakes."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import odd  # noqa: F401

from tracemill.llm import merkle, queries, resampling, url_filter
from tracemill.llm.common import table

SF = "/root/testdata/sf0.001"


# --- importance resampling -------------------------------------------------------------------


def brute_features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", low)
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute_draw(rows, target, percent=25, least=20, seed=7):
    """(id, text) to Counter of (id, n_features, weight, score, rank)."""
    s, t = Counter(), Counter()
    feats = [brute_features(x) for _, x in rows]
    for _, f in feats:
        s.update(f)
    for x in target:
        t.update(brute_features(x)[1])
    s_all, t_all = float(sum(s.values())) + 10000, float(sum(t.values())) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all)))
    out = []
    for (i, x), (n, f) in zip(rows, feats, strict=True):
        w = math.floor(sum(map(gain, f)) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return Counter((r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in out)


def drawn(df):
    return Counter((r.id, r.n_features, r.weight, r.score, r.rank) for r in df.collect())


def test_draw_matches_plain_version(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ähre", "ähre", "日本", "x\u00a0y", "É", "naïve", "a_b", "C3PO"]
    rows = [(r.choice([-5, 2**62]) + k, "".join(r.choice(vocabulary) + r.choice([" ", "\n", ", ", "-", "\x00", "\u2003"]) for _ in range(r.randint(0, 60)))) for k in range(300)]
    # Equal rows, one id with several texts, rows without an id or a text, and a third of all rows alike.
    rows += [rows[5]] * 3 + [(rows[7][0], rows[9][1]), (None, rows[11][1]), (None, rows[11][1]), (900, None), (901, ""), (902, "!?")] + [(77, " ".join(vocabulary))] * 150
    target = [" ".join(r.choice(vocabulary[:20]) for _ in range(30)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    for percent, least in ((25, 20), (100, 0), (3, 20), (0, 20)):
        assert drawn(resampling.resample(docs, wanted, percent, least)) == brute_draw(rows, target, percent, least)
    got = resampling.drawn_documents(docs.withColumn("rank", F.lit("x")).withColumn("id", F.lit(1)), wanted)
    assert got.columns == ["doc_id", "text", "rank", "id"]
    best = {(r.id, r.k1) for r in resampling.resample(docs, wanted).where("rank is not null").collect()}
    assert {(x.doc_id, x.h) for x in got.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()} == best


def test_selection_takes_the_smallest_keys_of_any_sign(spark):
    r = random.Random(5)
    rows = list({(r.choice([-(2**63), -70000, -1, 0, 65535, 65536, 2**63 - 1]), r.choice([-(2**40), -3, 5, 2**33])) for _ in range(60)})
    df = spark.createDataFrame(rows, "a long, b long")
    ranges = [(min(x), max(x)) for x in zip(*rows, strict=True)]
    for k in (1, 2, len(rows) // 2, len(rows)):
        got = df.where(resampling.smallest(df, [F.col("a"), F.col("b")], k, ranges))
        assert {tuple(x) for x in got.collect()} == set(sorted(rows)[:k])


def test_pieces_of_long_texts_have_the_features_of_the_whole():
    text = ("alpha Beta, gamma42 " * 50 + "x" * 300 + " délta\n") * 3
    whole = brute_features(text)
    for piece in (1, 7, 100, 10**9):
        parts = list(resampling.features(text.encode(), piece=piece))
        assert sum(n for n, _ in parts) == whole[0] and Counter(np.concatenate([f for _, f in parts]).tolist()) == Counter(whole[1])


def test_draw_prefers_the_target(spark):
    docs, bench = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    r = resampling.resample(docs, bench).where("n_words >= 20").groupBy(F.col("rank").isNotNull().alias("drawn")).agg(F.avg("weight").alias("w"), F.count("*").alias("n")).collect()
    by = {x.drawn: x for x in r}
    assert by[True].w > by[False].w and by[True].n == (by[True].n + by[False].n) * 25 // 100


# --- Merkle tree -----------------------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes):
    """Levels of a tree by the plain rule."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def brute_path(levels, k):
    out = []
    for level in levels[:-1]:
        run = level[k // 3 * 3 : k // 3 * 3 + 3]
        out.append((k % 3, [x for j, x in enumerate(run) if j != k % 3]))
        k //= 3
    return out


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); Counter of what checked() returns."""
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append((row[0] is None, row[0] or 0, brute_leaf(row), row))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [brute_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order]
    top = brute_tree([t[-1][0] for t in trees])
    out = Counter()
    for t, s in enumerate(order):
        for k, (_, _, leaf, row) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = brute_path(trees[t], k) + brute_path(top, t)
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            node = brute_leaf((*row[:4], row[4].replace("\n", "") if even and row[4] is not None else row[4]))
            for place, others in path:
                node = sha("".join([*others[:place], node, *others[place:]]))
            out[row[0], leaf, trees[t][-1][0], top[-1][0], sha("".join(x for _, o in path for x in o)), node, node == top[-1][0]] += 1
    return out


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(docs):
    df = merkle.checked(docs, merkle.without_newlines())
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in df.collect())


def test_manifest_of_several_levels_of_blocks(spark):
    r = random.Random(4)
    # A source of several blocks, one block full to the last, one over it, and more sources than a block of the upper tree holds.
    sizes = {"hot": 3000, "full": merkle.BLOCK, "over": merkle.BLOCK + 1, None: 5, "": 1, "é": 2, "Z": 4} | {f"s{k}": 1 for k in range(merkle.BLOCK + 20)}
    rows = [(s, r.choice(["de", None]), r.choice([3, None]), r.choice(["a\nb", "ab", "", None, "日\n"])) for s, n in sizes.items() for _ in range(n)]
    r.shuffle(rows)
    rows = [(k - 40, *x) for k, x in enumerate(rows)]
    got = manifest(spark.createDataFrame(rows, MANIFEST).repartition(13))
    assert got == brute_manifest(rows)
    assert {x[6] for x in got} == {True, False}


def test_manifest_of_odd_rows(spark):
    rows = [(1, "a", "x", 1, "t")] * 5 + [(1, "a", "x", 1, "u\n"), (None, "a", None, None, None), (None, None, None, None, None), (2, "a", "1:x", 1, "-"), (3, "a", "", 1, "\n" * 1000 + "w" * 10**6)]
    docs = spark.createDataFrame(rows, MANIFEST)
    assert manifest(docs) == brute_manifest(rows)
    assert manifest(docs.selectExpr("*", "1 as g", "2 as i", "3 as leaf", "4 as copy", "5 as kind", "6 as n", "7 as salt")) == brute_manifest(rows)
    assert manifest(docs.limit(0)) == Counter()
    assert manifest(docs.limit(1)) == brute_manifest(rows[:1])


def test_a_proof_tells_any_change(spark):
    docs = table(spark, SF, "documents")
    assert merkle.checked(docs).where("not verified").count() == 0
    changed = merkle.checked(docs, {"lang": F.when(F.col("doc_id") == 17, "xx").otherwise(F.col("lang"))}).where("not verified")
    assert [r.doc_id for r in changed.collect()] == [17]


# --- URL filter ------------------------------------------------------------------------------


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :])[0]


def brute_rule(host, path, rules=url_filter.RULES):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.host + r.path), default=None)


def brute_judge(rows, order=5, most=url_filter.MAX_CONTEXTS):
    """(page_id, url) to a list of what judge() returns, without the threshold: all counts from the whole texts, no memory of runs."""
    parts = [(i, *brute_parts(u)) for i, u in rows]
    text = lambda h, p: re.sub("[^\\x21-\\x7e]", "\x7f", h + p)
    n, held = defaultdict(lambda: defaultdict(lambda: [0, 0])), []
    for _, h, p in parts:
        if r := brute_rule(h, p):
            if zlib.crc32(h.encode()) % 5 == 0:
                held.append((text(h, p), r.allow))
                continue
            s = "\x02" * order + text(h, p) + "\x03"
            for i in range(order, len(s)):
                for k in range(order + 1):
                    n[s[i - k : i]][s[i]][not r.allow] += 1
    total = {c: sum(map(sum, f.values())) for c, f in n.items()}
    keep = sorted((c for c in n if total[c] >= 2), key=lambda c: (-total[c], len(c), c))[:most]

    def p(which, context, c):
        out = 1 / 96
        for k in range(len(context) + 1):
            end = context[len(context) - k :]
            f = {x: v[which] for x, v in n[end].items() if v[which]} if end in kept else None
            if not f:
                break
            out = (f.get(c, 0) + len(f) * out) / (sum(f.values()) + len(f))
        return out

    kept = set(keep)
    both = all(any(v[w] for c in kept for v in n[c].values()) for w in (0, 1))

    def score(t):
        if not t or not both:
            return 0.0
        s = "\x02" * order + t + "\x03"
        return sum(math.log(p(0, s[i - order : i], s[i])) - math.log(p(1, s[i - order : i], s[i])) for i in range(order, len(s))) / (len(t) + 1)

    bins = [(max(-10000, min(10000, math.floor(score(t) / 0.001))), a) for t, a in held]
    yes, no = [b for b, a in bins if a], [b for b, a in bins if not a]
    least = 0
    if yes and no and both:
        tries = sorted({0, *(b + 1 for b in yes + no)} | {b for b in yes + no})
        low = min(yes + no)
        value = lambda t: sum(b >= t for b in yes) * len(no) + sum(b < t for b in no) * len(yes)
        top = max(max(value(t) for t in tries if t <= max(yes + no)), value(low))
        least = min((t for t in range(min(0, low), max(yes + no) + 1) if value(t) == top), key=lambda t: (abs(t), -t))
    out = []
    for i, h, q in parts:
        r, s = brute_rule(h, q), score(text(h, q))
        verdict = ("allow" if r.allow else "block") if r else "allow" if math.floor(s / 0.001) >= least else "block"
        out.append((i, h, q, r.text if r else None, verdict))
    return out, least


def judged(df):
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect())


ODD_URLS = [
    None, "", "no scheme.com/", "://", "http://", "HTTP://A.COM", "http://A.COM/", "http://com/x", "http://xcom/", "http://www.Example.com/en/", "http://m.www.example.com/en/1", "http://wwwexample.com/en/", "http://example.com/EN/", "http://example.com/en?x", "https://a.net/es/?q#f", "https://a.net/fr/", "https://a.net/en/",
    "x://a.b/c?u=http://com/", "http://É.com/é/ü", "http://ß.org/日本", "http://a.org?x/y", "http://a.org#x", "http://user:pw@a.net:80/fr/", "http://a.org/" + "long/" * 20000, "http://a.org/a b\nc", "mailto:a@b",
]


@pytest.mark.parametrize("order,most", [(5, 20_000), (2, 40)])
def test_urls_match_plain_version(spark, order, most):
    rows = [(r.page_id, r.url) for r in table(spark, SF, "pages").collect()]
    rows += [(10_000 + k, u) for k, u in enumerate(ODD_URLS)] + [(10_001, ODD_URLS[6])] * 3 + [(None, "http://a.org/")]
    want, least = brute_judge(rows, order, most)
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(5), order=order, most=most)
    assert judged(got) == Counter(want)
    assert {round(r.threshold * 1000) for r in got.select("threshold").distinct().collect()} == {least}


def test_contexts_beyond_twenty_thousand_count(spark):
    """A model of more contexts than were once kept; all that occur twice are in it."""
    r = random.Random(9)
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    names = [name() for _ in range(3000)]
    urls = [f"http://{n}.com/{n[::-1]}" for n in names[:1500] for _ in range(2)] + [f"http://{n}.net/fr/{n[::-1]}" for n in names[1500:] for _ in range(2)]
    rows = list(enumerate(urls + [f"http://{n}.org/{n[::-1]}" for n in names]))
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    want, least = brute_judge(rows)
    assert judged(url_filter.judge(df)) == Counter(want)
    assert Counter(want) != Counter(brute_judge(rows, 5, 20_000)[0])


def test_url_models_tell_kinds_of_hosts_apart(spark):
    r = random.Random(6)
    good, bad = ["library", "school", "science", "museum", "garden"], ["casino", "jackpot", "poker", "bonus", "slots"]
    host = lambda ws, end: "-".join(r.choice(ws) for _ in range(2)) + str(r.randint(1, 99)) + end
    urls = [f"http://{host(good, '.com')}/page/{r.randint(1, 999)}" for _ in range(400)] + [f"http://{host(bad, '.net')}/fr/{r.randint(1, 999)}" for _ in range(200)]
    asked = [(f"http://{host(good, '.org')}/x/{r.randint(1, 999)}", "allow") for _ in range(100)] + [(f"http://{host(bad, '.org')}/x/{r.randint(1, 999)}", "block") for _ in range(100)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls + [u for u, _ in asked])], "page_id long, url string")
    found = {x.page_id: x.verdict for x in url_filter.judge(pages).collect()}
    right = sum(found[len(urls) + k] == v for k, (_, v) in enumerate(asked))
    assert right >= 190


def test_threshold_by_hand():
    assert url_filter.threshold([]) == 0 and url_filter.threshold([(5, True, 9)]) == 0
    assert url_filter.threshold([(-3, False, 1), (3, True, 1)]) == 0
    assert url_filter.threshold([(7, False, 2), (40, True, 1)]) == pytest.approx(0.008)
    assert url_filter.threshold([(-40, False, 2), (-7, True, 1)]) == pytest.approx(-0.007)


def test_urls_with_one_kind_only_or_none(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "http://a.org/")], "page_id long, url string")
    assert {r.page_id: (r.verdict, r.score) for r in url_filter.judge(pages).collect()} == {1: ("allow", None), 2: ("allow", 0.0)}
    assert url_filter.judge(pages.limit(0)).collect() == []
    wide = pages.selectExpr("*", "1 as host", "'x' as path", "true as rule", "0 as text", "9 as score")
    assert judged(url_filter.judge(wide)) == judged(url_filter.judge(pages))
    assert sorted(r.page_id for r in url_filter.allowed_pages(wide).collect()) == [1, 2] and url_filter.allowed_pages(wide).columns == wide.columns


# --- all three -------------------------------------------------------------------------------


def test_odd_documents_give_a_row_each(spark, odd):  # noqa: F811
    n = odd.count()
    assert resampling.resample(odd, odd.select("text")).count() == n
    assert merkle.checked(odd, merkle.without_newlines(), [c for c in merkle.COLUMNS if c in odd.columns], group="source" if "source" in odd.columns else "text").count() == n
    assert resampling.resample(odd.limit(0), odd.limit(0)).collect() == []


def test_queries_have_their_columns(spark):
    want = {"op11_resampling": ["doc_id", "n_features", "weight", "score", "rank"], "op12_merkle_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"], "op13_url_filter": ["page_id", "host", "path", "rule", "verdict"]}
    for name, columns in want.items():
        assert queries.queries()[name](spark, SF).columns[: len(columns)] == columns
