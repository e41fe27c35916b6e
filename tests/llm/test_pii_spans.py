"""Personal data beside the base rules: what is added, what is left alone, and how long it takes."""

import random
import time

from tracemill.llm import pii

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(r, n=6):
    return "".join(r.choice(LETTERS) for _ in range(r.randint(2, n)))


def card(r):
    d = [r.randint(1, 9) for _ in range(15)]
    total = sum(x if i % 2 else 2 * x - 9 * (x > 4) for i, x in enumerate(d))
    s = "".join(map(str, [*d, -total % 10]))
    return [s[i : i + 4] for i in range(0, 16, 4)]


def personal(r):
    """Kind, text before, and the span."""
    n = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))
    end = r.choice(["com", "org", "net", "de", "io", "edu"])
    return r.choice(
        [
            ("email", r.choice(["mail ", "write to ", "contact: ", ""]), f"{word(r)}.{word(r)} at {word(r)} dot {end}"),
            ("email", r.choice(["e-mail ", "", "and "]), f"{word(r)}{n(2)} [at] {word(r)} [dot] {end}"),
            ("ip", r.choice(["server ", "from host ", "address "]), f"{n(2)}0[.]{r.randint(0, 255)}[.]{r.randint(0, 255)}[.]{r.randint(0, 255)}"),
            ("ip", r.choice(["server ", "ipv6 ", "ping "]), f"2001:db8:{n(2)}::{r.choice('abcdef')}{n(2)}"),
            ("card", r.choice(["card ", "visa ", "paid with "]), r.choice("._/").join(card(r))),
            ("phone", r.choice(["phone ", "call ", "tel. ", "mobile "]), f"{r.randint(201, 989)}{r.choice('-. ')}{r.randint(200, 999)}{r.choice('-. ')}{n(4)}"),
            ("phone", r.choice(["", "and ", "dial "]), f"({r.randint(201, 989)}) {r.randint(200, 999)}-{n(4)}"),
        ]
    )


def alike(r):
    n = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))
    return r.choice(
        [
            f"part {n(3)}-{n(3)}-{n(4)}",
            f"order {r.randint(201, 989)}-{n(3)}-{n(4)}",
            f"serial {n(3)}.{n(3)}.{n(4)}",
            f"they met at {word(r)} dot {word(r)}",
            f"look at {word(r)} dot and go",
            f"look at {word(r)}.com",
            f"at {r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}",
            "mac 00:1a:2b:3c:4d:" + r.choice(["5e", "5f", "aa"]),
            f"item {n(4)}.{n(4)}.{n(4)}.{n(4)}",
            f"version {r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 9999)}",
        ]
    )


def test_added_spans_held_out(spark):
    r = random.Random(12)
    rows, truth, planted = [], set(), 0
    for i in range(1500):
        text = " ".join(word(r) for _ in range(r.randint(3, 12)))
        what = r.random()
        if what < 0.4:
            kind, before, span = personal(r)
            a = len(text) + 2 + len(before)
            text += ". " + before + span
            truth.add((i, f"{kind}:{a}:{a + len(span)}"))
            planted += 1
        elif what < 0.8:
            text += ". " + alike(r)
        else:
            text += f". mail {word(r)}@{word(r)}.com or +1 437 555 0{r.randint(100, 999)}"
        rows.append((i, text + " " + " ".join(word(r) for _ in range(3)) + "."))
    got = set()
    for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got |= {(x.doc_id, s) for s in set(filter(None, x.spans.split(","))) - set(filter(None, x.base_spans.split(",")))}
    right = len(got & truth)
    assert right >= 0.9 * planted and right >= 0.95 * len(got), (right, planted, len(got), sorted(got - truth)[:10], [(rows[i][1], s) for i, s in sorted(truth - got)[:10]])


def test_prose_and_numbers_are_left_alone(spark):
    texts = ["meet me at noon dot please, look at this dot and go", "look at this dot and go", "part 123-456-7890", "the order 437-555-0689 was late", "at 10:22:33 sharp", "see 2024-01-31 and 01/02/2024", "", None]
    assert [x.spans for x in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()] == [""] * len(texts)


def test_every_kind_has_trees_that_ask_several_features(spark):
    shown = pii.examples(spark)
    for k in range(len(pii.KINDS)):
        known = pii.taught([], shown, k)
        t = pii.Trees().fit([x for x, _, _ in known], [g for _, g, _ in known], [b for _, _, b in known])
        asked = set()

        def walk(node):
            if isinstance(node, tuple):
                asked.add(pii.FEATURES[node[0]])
                walk(node[2])
                walk(node[3])

        for tree in t.trees:
            walk(tree)
        assert len(asked) >= 2, (pii.KINDS[k], asked)


def test_spans_of_many_matches_take_time_in_proportion(spark):
    def took(n):
        text = " ".join(f"u{i}@host{i % 7}.com 437-555-{i % 10000:04d}" for i in range(n))
        began = time.time()
        (row,) = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        assert row.n_email == n and row.spans.count("email:") == n and row.spans.startswith("email:0:")
        last = max(int(s.split(":")[2]) for s in row.spans.split(",") if s.startswith("email"))
        assert text[:last].endswith(".com") and len(text) - last == 13
        return time.time() - began

    took(100)
    assert took(40_000) < 40


def test_scans(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    rows = [(i, [r.randint(0, 99) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 255, 256, 257, 512, 1000])]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    for add, plain in ((lambda a, b: a + b, lambda a, b: a + b), (F.greatest, max)):
        for x in df.select("i", pii.scanned(F.col("v"), add).alias("s")).collect():
            want, acc = [], 0
            for v in rows[x.i][1]:
                want.append(acc)
                acc = plain(acc, v)
            assert x.s == want


def test_rows_beyond_the_drivers_share_teach_as_well(spark, monkeypatch):
    """Trees grown over the table are those that the driver grows from all its rows."""
    r = random.Random(31)
    texts = [f"{r.choice(['mail', 'see', 'part'])} u{'x' * r.randint(0, 30)}@h{r.randint(0, 99)}.com and {r.choice(['card', 'order', ''])} {r.randint(10**13, 10**18)} or +1 {r.randint(10**8, 10**12)} " + r.choice(["", "phone 437-555-0689", "ann.lee at example dot com"]) for _ in range(60)]
    rows = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    each, shown = pii.teaching(rows), pii.examples(spark)
    monkeypatch.setattr(pii.Trees.__init__, "__defaults__", (2, 0.3, 1.0))
    kinds = [0, 2]
    far = pii.far_models(each, shown, kinds, 0.7)
    seen = pii.teaching_rows(rows, 10_000)
    for k in kinds:
        known = pii.taught(seen, shown, k)
        assert sum(x["k"] == k for x in seen) > 5
        near = pii.Trees().fit(*map(list, zip(*known, strict=True)))
        assert max(abs(near.margin(x) - far[k][0].margin(x)) for x, *_ in known) < 1e-6
        bound = pii.calibrated(pii.unseen_margins(seen, shown, k), 0.7)
        below = max((z for x, *_ in known if (z := near.margin(x)) < bound - 1e-6), default=bound)
        assert bound < float("inf") and abs(far[k][1] - (bound + below) / 2) < 1e-6
    asked = []
    monkeypatch.setattr(pii, "far_models", lambda each, shown, kinds, precision: asked.append(kinds) or dict.fromkeys(kinds, far[0]))
    pii.find(spark.createDataFrame([(1, " ".join(texts))], "doc_id long, text string"), most=5).collect()
    assert len(asked) == 1 and set(asked[0]) >= set(kinds)
