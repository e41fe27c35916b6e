"""Personal data: candidate spans judged by gradient-boosted trees, with DataFrame functions only.

High-recall generators propose spans, which may overlap. Each candidate has a few small
whole-number features of its form and of the words around it. As their combinations are
few, the corpus is reduced to a table of combinations with counts; trees are boosted on
that table by the driver and go back into the plan as one expression. Spans by the base
rules always stay; the trees decide on the other candidates, by a threshold for each kind
that is calibrated on the counts.

What teaches: spans of the base rules stand for personal data; against them stand matches
that fail a check (parts of an address, check digit, number of digits), candidates right
behind a word such as "part", "order" or "version", and prose that only reads like an
address. Sentences labelled by hand (EXAMPLES) teach the forms that base rules never match,
with a weight that keeps them in sight beside the corpus. Further candidates of the corpus
have no label and teach nothing. No feature says which generator proposed a candidate.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import checkpointed

KINDS = ("email", "ip", "card", "phone")

#: Base patterns. They find what the plain ones find, leftmost and without overlap, in time
#: linear in the text: a run of characters is entered at its start or where the last match
#: ended (\G), and what can't be given back is not tried again.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't have a match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}

_AT = r"(?:\x20?(?:\[at\]|\(at\)|\{at\})\x20?|\x20at\x20)"
_DOT = r"(?:\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\x20dot\x20|\.|\[\.\]|\(\.\))"
#: Further generators: kind, pattern, and what a text must have. Cheap and generous; the trees judge.
MORE = [
    ("email", rf"(?i)(?<![a-z0-9._%+@-])[a-z0-9._%+-]{{1,64}}{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}}){{1,3}}(?![a-z0-9])", r"(?i)[\[({\x20]at[\])}\x20]"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])", r"[0-9][\[(](?:\.|dot)[\])][0-9]"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f:]"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])", r"[0-9]{4}[\x20./_-][0-9]{4}[\x20./_-]"),
    ("phone", r"(?<![0-9+(])(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    ("phone", r"(?<![0-9+])00[1-9][0-9]{0,2}[\x20.-][\x20().0-9-]{6,15}[0-9](?![0-9])", r"00[1-9][0-9]{0,2}[\x20.-]"),
    ("phone", r"(?<![0-9+.,-])0[0-9]{1,4}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,4}(?![0-9.,-])", r"0[0-9]{1,4}[\x20/-][0-9]{3}"),
    ("phone", r"(?<![0-9+(])\(0[0-9]{1,4}\)[\x20/-]?[0-9]{2,4}(?:[\x20-]?[0-9]{2,4}){1,3}(?![0-9])", r"\(0[0-9]{1,4}\)"),
]

#: Words before a span that speak for a kind, and words that speak against all right before it.
CONTEXT = {"email": "mail|contact|write to|reach me|send", "ip": "\\bip\\b|ipv6|address|\\bhost|server|\\bping\\b|connect", "card": "card|visa|master|amex|credit|payment|charge", "phone": "phone|\\btel\\b|\\bcall|mobile|\\bfax|whatsapp|\\bdial|\\bsms\\b|\\btext me"}
ALIKE = "\\b(?:parts?|orders?|items?|sku|invoice|serial|model|version|ver|isbn|issn|ref|case|ticket|build|release|batch|page|no|nr|number|lot|id|at|from|since|until|on|between|time|mac)[\\s.:#]*$|[#$=/]$"
#: Last parts of domain names that are no common words.
ENDING = "(?i)(?<![a-z0-9-])(?:com|org|net|edu|gov|int|info|biz|io|dev|app|co|uk|de|fr|es|nl|eu|ca|au|jp|cn|br|ru|ch|se|dk|pl|cz|pt|gr|fi|ie|nz|kr|mx|za|tv|example|test)$"
REACH = 24
#: What is no name before "at": verbs and other words that "at" follows in prose.
PROSE = "(?i)^(?:[a-z]+(?:ed|ing)|looks?|meets?|met|am|is|are|was|were|be|been|here|there|stays?|lives?|works?|shops?|buys?|bought|sells?|sold|seen?|saw|found|stops?|starts?|ends?|sits?|sat|stands?|stood|sleeps?|slept|ate|eats?|left|home|back|held|kept|pointed|aims?|smiles?|laughs?|all|not|only|even|just|up|down|out|that|this|it|us|them|him|her)[\\s\\[({]"
#: More digits right before or behind a span, a space or a mark between.
RUN_BEFORE, RUN_AFTER = "[0-9][\\s./-]$", "^[\\s./-][0-9]"

# Sentences labelled by hand: kind, text, whether the further candidate in it is personal data.
EXAMPLES = [
    ("email", "write to ann.lee at example dot com today", True),
    ("email", "contact: jo_smith [at] mail [dot] org", True),
    ("email", "e-mail bob99 (at) site (dot) de", True),
    ("email", "my mail is kim at lists dot debian dot org", True),
    ("email", "ask joe at shop dot net about it", True),
    ("email", "reach me: dee[at]host[dot]io", True),
    ("email", "ella.ray (at) uni (dot) edu", True),
    ("email", "we meet at noon dot nobody is late", False),
    ("email", "look at this dot and then at that one", False),
    ("email", "he arrived at nine.then he left", False),
    ("email", "put the pin at point dot four", False),
    ("email", "they send parcels at night dot every week", False),
    ("email", "stand (at) the.door and wait", False),
    ("email", "please contact us at length.thanks", False),
    ("email", "look at google.com for it", False),
    ("email", "we bought it at amazon.de", False),
    ("email", "send a postcard, look at shop.org first", False),
    ("email", "it is seen at github.io daily", False),
    ("email", "looked at home dot com was not there", False),
    ("email", "we stayed at hotel dot com for a week", False),
    ("email", "she works at acme dot org now", False),
    ("email", "a sale held at store dot net", False),
    ("email", "they were at booking dot com", False),
    ("email", "PING zed AT mailbox DOT org", True),
    ("email", "tom_b (at) firm (dot) co (dot) uk", True),
    ("email", "support{at}site{dot}de", True),
    ("email", "for help: kay.o [at] dept.uni.edu", True),
    ("email", "x99 at post dot ch", True),
    ("ip", "server 2001:db8::8a2e:370:7334 is down", True),
    ("ip", "connect to fe80::1ff:fe23:4567:890a now", True),
    ("ip", "address 2001:0db8:85a3:0000:0000:8a2e:0370:7334", True),
    ("ip", "blocked 203[.]0[.]113[.]7 since May", True),
    ("ip", "host 10(.)1(.)2(.)3 replied", True),
    ("ip", "the scan of 2a00:1450:4001:82b::200e", True),
    ("ip", "dns 2606:4700:4700::1111 answers", True),
    ("ip", "seen from 198[.]51[.]100[.]23", True),
    ("ip", "route fd12:3456:789a:1::1 via eth0", True),
    ("ip", "c2 at 192[dot]0[dot]2[dot]44", True),
    ("ip", "start 08:15:00 end 09:45:10", False),
    ("ip", "mix 1:2:3 by weight", False),
    ("ip", "psalm 119:105 and 23:4", False),
    ("ip", "bssid a4:5e:60:c2:11:0f", False),
    ("ip", "the train leaves at 10:22:33", False),
    ("ip", "a ratio of 3:4", False),
    ("ip", "chapter 3:16 says so", False),
    ("ip", "interface mac 00:1a:2b:3c:4d:5e", False),
    ("ip", "we saw 00:1b:44:11:3a:b7 on the bus", False),
    ("ip", "between 09:30 they slept", False),
    ("ip", "lap time 1:02:33", False),
    ("ip", "score 12:10:11:15", False),
    ("card", "card 4111.1111.1111.1111 was charged", True),
    ("card", "visa 4012_8888_8888_1881", True),
    ("card", "paid with 5555/5555/5555/4444 yesterday", True),
    ("card", "4111 1111 1111 1111 12 27", True),
    ("card", "amex 3782.8224.6310.005 expires", True),
    ("card", "charged to 6011_1111_1111_1117", True),
    ("card", "mastercard 5105/1051/0510/5100", True),
    ("card", "lot 4111.2222.3333.4444 of cloth", False),
    ("card", "dates 2019/2020/2021/2022", False),
    ("card", "iban part 3704.0044.0532.0130", False),
    ("card", "codes 1111 2222 3333 4445 66", False),
    ("card", "part 4000.1234.5678.9012 in stock", False),
    ("card", "order 1234/5678/9012/3456", False),
    ("card", "the years 2001-2002-2003-2004 were good", False),
    ("card", "serial 7777_1111_2222_3333", False),
    ("card", "numbers 1000 2000 3000 4001 in a row", False),
    ("phone", "phone 437-555-0689", True),
    ("phone", "call (437) 555-0689 after six", True),
    ("phone", "mobile: 437.555.0689", True),
    ("phone", "tel 0044 20 7946 0958", True),
    ("phone", "fax 030 123 4567", True),
    ("phone", "(212) 555-0147 is the desk", True),
    ("phone", "his number, (415) 555 0132, was wrong", True),
    ("phone", "dial 0049 89 636 48018", True),
    ("phone", "tel (020) 7946 0958", True),
    ("phone", "office (089) 636-48018", True),
    ("phone", "her cell is 646.555.0199", True),
    ("phone", "ring (030) 901820 at nine", True),
    ("phone", "text 312 555 0187 please", True),
    ("phone", "from abroad 0033 1 70 18 99 00", True),
    ("phone", "0171/5550123 until five", True),
    ("phone", "DE89 3704 0044 0532 0130 00", False),
    ("phone", "iban GB29 0012 3456 7890 1234 56", False),
    ("phone", "code 12 0049 1234 5678 90", False),
    ("phone", "values 5 030 123 4567 8", False),
    ("phone", "9 100 200 3000 7 8", False),
    ("phone", "the series 1 007 123 4567", False),
    ("phone", "part 123-456-7890", False),
    ("phone", "order 437-555-0689 has shipped", False),
    ("phone", "isbn 978-030-4064", False),
    ("phone", "a sum of 100 200 3000 units", False),
    ("phone", "build 001 2024 1015 33", False),
    ("phone", "serial 555.123.4567", False),
    ("phone", "item 030 555 1234", False),
    ("phone", "between 007-123-4567 and more", False),
    ("phone", "rows 123 456 7890 of the table", False),
]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    odd = F.expr("0")
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 - F.when(F.ascii(c) >= 53, 9).otherwise(0))),
        odd,
        lambda a, x: a + x,
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return F.regexp_like(m, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    d = _digits(m)
    if kind == "card":
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    return F.length(d).between(10, 15)


#: Whole numbers of a candidate that the trees may ask for.
FEATURES = ("len", "digits", "luhn", "groups", "lead", "sign", "ending", "prose", "near", "alike", "left", "right", "run")
SPAN = "array<struct<k:int,start:int,end:int,base:boolean,fails:boolean," + ",".join(f"{f}:int" for f in FEATURES) + ",more:int>>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body and its lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(values: Column, add: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """For each number of an array what add() makes of all before it, from 0 on.

    Arrays grow by copies, so the scan goes by blocks and then over the blocks' ends; n
    numbers cost about n * block, not n * n.
    """
    zero = F.array(F.lit(0))
    grow = lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x)))

    def whole(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(block))
        parts = F.transform(starts, lambda s: F.aggregate(F.slice(v, s + 1, F.lit(block)), zero, grow))
        return _bound(parts, lambda ps: _bound(F.aggregate(ps, zero, lambda acc, p: grow(acc, F.element_at(p, -1))), lambda ends: joined(ps, ends)))

    def joined(ps: Column, ends: Column) -> Column:
        return F.flatten(F.transform(ps, lambda p, i: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: add(F.get(ends, i), x))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(_bound(values, whole))


def _spans(text: Column, kind: str, pattern: str, need: str, more: int) -> Column:
    """The matches of a pattern as candidates with place and features.

    The pieces between the matches and the matches themselves, laid end to end, give each
    match its place in characters.
    """
    k = KINDS.index(kind)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    has_letter = F.lit("(?i)[a-f]|::|[\\[(]")
    one = lambda cond, v=1: F.when(cond, v).otherwise(0)

    def candidate(x: Column, at: Column) -> Column:
        g, m, after = x.getField("g"), x.getField("m"), x.getField("n")
        start = at + F.length(g)
        before = F.lower(F.right(g, F.lit(REACH)))
        d = F.length(_digits(m))
        valid = _valid(kind, m)
        parts = {
            "len": F.least(F.length(m), F.lit(40)),
            "digits": F.least(d, F.lit(20)),
            "luhn": F.when(d.between(13, 19), one(luhn(_digits(m)))).otherwise(-1),
            # Groups of digits; of an address in words, its dots in words.
            "groups": F.least(F.regexp_count(m, F.lit({"ip": "[0-9A-Fa-f]+", "email": "(?i)dot(?![a-z0-9])"}.get(kind, "[0-9]+"))), F.lit(9)),
            "lead": F.least(F.length(F.regexp_extract(m, "[0-9]+", 0)), F.lit(6)),
            # Brackets about parts, or what only such a thing has.
            "sign": one(F.regexp_like(m, F.lit("[@\\[({]"))) if kind == "email" else one(F.regexp_like(m, has_letter)) if kind == "ip" else one(F.regexp_like(m, F.lit("[+(]|^00"))),
            "ending": one(F.regexp_like(m, F.lit(ENDING))) if kind == "email" else F.lit(0),
            "prose": one(F.regexp_like(m, F.lit(PROSE))) if kind == "email" and more else F.lit(0),
            "near": F.when(F.regexp_like(before, F.lit(CONTEXT[kind])), 2).when(F.regexp_like(before, F.lit("|".join(CONTEXT.values()))), 1).otherwise(0),
            "alike": one(F.regexp_like(before, F.lit(ALIKE))),
            "left": one(F.regexp_like(g, F.lit("[A-Za-z0-9]$"))),
            "right": one(F.regexp_like(F.coalesce(after, F.lit("")), F.lit("^[A-Za-z0-9]"))),
            "run": one(F.regexp_like(g, F.lit(RUN_BEFORE)) | F.regexp_like(F.coalesce(after, F.lit("")), F.lit(RUN_AFTER))),
        }
        base = F.lit(False) if more else valid
        # A candidate that speaks against itself: it fails its check, follows a word that numbers things, or ends in no domain.
        fails = (~valid if not more else F.lit(False)) | ((parts["alike"] == 1) & (parts["near"] != 2)) | ((parts["luhn"] == 0) if kind == "card" else (parts["ending"] == 0) if kind == "email" and more else F.lit(False))
        return F.struct(F.lit(k).alias("k"), start.alias("start"), (start + F.length(m)).alias("end"), base.alias("base"), (fails & ~base).alias("fails"), *[parts[f].cast("int").alias(f) for f in FEATURES], F.lit(more).alias("more"))

    zipped = F.filter(F.arrays_zip(gaps.alias("g"), hits.alias("m"), F.slice(gaps, 2, F.size(gaps)).alias("n")), lambda x: x.getField("m").isNotNull())
    lengths = lambda z: scanned(F.transform(z, lambda x: F.length(x.getField("g")) + F.length(x.getField("m"))), lambda a, b: a + b)
    found = _bound(zipped, lambda z: _bound(lengths(z), lambda ends: F.transform(z, lambda x, i: candidate(x, F.get(ends, i)))))
    has = F.contains(text, F.lit(need)) if need == "@" else F.regexp_like(text, F.lit(need))
    return F.when(has, found.cast(SPAN)).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, all candidates of the row's text; a row per row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    found = [_spans(F.col("text"), kind, BASE[kind], NEEDS[kind], 0) for kind in KINDS]
    found += [_spans(F.col("text"), kind, pattern, need, i + 1) for i, (kind, pattern, need) in enumerate(MORE)]
    return rows.select("doc_id", F.concat(*found).alias("spans"))


def examples(spark: SparkSession) -> list[tuple[int, tuple[int, ...], bool]]:
    """Kind, features and label of the further candidates in EXAMPLES, by the same generators."""
    rows = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(EXAMPLES)], "doc_id int, text string")
    out = []
    for r in candidates(rows).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*").orderBy("doc_id", "start", "more").collect():
        kind, _, label = EXAMPLES[r.doc_id]
        if r.k == KINDS.index(kind) and r.more:
            out.append((r.k, tuple(r[f] for f in FEATURES), label))
    return out


class Trees:
    """Boosted trees of depth 2 under logistic loss, on weighted rows of small whole numbers."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, ridge: float = 1.0) -> None:
        self.rounds, self.rate, self.ridge = rounds, rate, ridge
        self.base, self.trees = 0.0, []

    def _split(self, rows, g, h):
        """Feature and bound that divide the rows best; None if none does."""
        gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
        whole = gs * gs / (hs + self.ridge)
        best = (1e-6, None)
        for f in range(len(self.x[0]) if self.x else 0):
            by: dict[int, list[float]] = {}
            for i in rows:
                s = by.setdefault(self.x[i][f], [0.0, 0.0])
                s[0] += g[i]
                s[1] += h[i]
            a = b = 0.0
            for v in sorted(by)[:-1]:
                a, b = a + by[v][0], b + by[v][1]
                gain = a * a / (b + self.ridge) + (gs - a) ** 2 / (hs - b + self.ridge) - whole
                if gain > best[0]:
                    best = (gain, (f, v))
        return best[1]

    def _leaf(self, rows, g, h) -> float:
        return self.rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + self.ridge)

    def _grow(self, rows, g, h, depth: int):
        cut = self._split(rows, g, h) if depth else None
        if not cut:
            return self._leaf(rows, g, h)
        f, v = cut
        low, high = [i for i in rows if self.x[i][f] <= v], [i for i in rows if self.x[i][f] > v]
        return (f, v, self._grow(low, g, h, depth - 1), self._grow(high, g, h, depth - 1))

    def fit(self, x: list[tuple[int, ...]], good: list[float], bad: list[float]) -> Trees:
        """x: feature rows; good, bad: how many candidates of each row are personal data, or not."""
        self.x = x
        n = [a + b for a, b in zip(good, bad)]
        p0 = (sum(good) + 1) / (sum(n) + 2)
        self.base = math.log(p0 / (1 - p0))
        z = [self.base] * len(x)
        for _ in range(self.rounds if x else 0):
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z]
            g = [a - k * q for a, k, q in zip(good, n, p)]
            h = [k * q * (1 - q) for k, q in zip(n, p)]
            tree = self._grow(list(range(len(x))), g, h, 2)
            self.trees.append(tree)
            z = [v + self.value(tree, r) for v, r in zip(z, x)]
        return self

    def value(self, tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def margin(self, row) -> float:
        return self.base + sum(self.value(t, row) for t in self.trees)

    def column(self, field) -> Column:
        """The same sum as an expression; field(i) is the column of feature i."""

        def expr(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(field(tree[0]) <= tree[1], expr(tree[2])).otherwise(expr(tree[3]))

        # Trees of one rule often come again; each is stated once.
        total: dict[str, list] = {}
        for t in self.trees:
            total.setdefault(repr(t), [t, 0])[1] += 1
        out = F.lit(self.base)
        for t, k in total.values():
            out = out + expr(t) * float(k)
        return out


def calibrated(margins: list[tuple[float, float, float]], precision: float) -> float:
    """Lowest margin from which on, over all candidates above, at least `precision` are personal data; infinite if none is."""
    best, a, n = math.inf, 0.0, 0.0
    rows = sorted(margins, reverse=True)
    for i, (z, good, bad) in enumerate(rows):
        a, n = a + good, n + good + bad
        if (i + 1 == len(rows) or rows[i + 1][0] < z) and n and a / n >= precision:
            best = z
    return best


#: Parts into which rows and sentences are dealt; each is judged by trees that have not seen it.
FOLDS = 4


def unseen_margins(seen: list, shown: list[tuple[int, tuple[int, ...], bool]], k: int) -> list[tuple[float, float, float]]:
    """Margin, good and bad of each row of a kind, by trees fitted without its fold: corpus rows by their features, sentences in turn."""
    fold = lambda r: zlib.crc32(repr([r[f] for f in FEATURES]).encode()) % FOLDS
    own, out = [s for s in shown if s[0] == k], []
    turns = {label: 0 for label in (True, False)}
    parts: list[list] = [[] for _ in range(FOLDS)]
    for s in own:
        parts[turns[s[2]] % FOLDS].append(s)
        turns[s[2]] += 1
    for f in range(FOLDS):
        rest = taught([r for r in seen if fold(r) != f], [s for g in range(FOLDS) if g != f for s in parts[g]], k)
        trees = Trees().fit(*map(list, zip(*rest, strict=True))) if rest else Trees()
        out += [(trees.margin(x), a, b) for x, a, b in taught([r for r in seen if fold(r) == f], parts[f], k)]
    return out


def _coded(spans: Column) -> Column:
    """kind:start:end, by start and then by kind, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s.getField("start").alias("a"), s.getField("k").alias("k"), s.getField("end").alias("b"))))
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(name, s.getField("k")), s.getField("a").cast("string"), s.getField("b").cast("string"))), ",")


def taught(seen: list, shown: list[tuple[int, tuple[int, ...], bool]], k: int, weight: float = 100.0, each: float = 10.0) -> list[tuple[tuple[int, ...], float, float]]:
    """Feature rows of a kind with the weight of what speaks for and against them.

    seen has rows of FEATURES, k, good and bad. Each side of the corpus weighs `weight` in
    all, however many candidates it has, and each example `each`.
    """
    sums: dict[tuple[int, ...], list[float]] = {}
    total = [sum(r[side] for r in seen if r["k"] == k) for side in ("good", "bad")]
    for r in seen:
        if r["k"] == k:
            row = sums.setdefault(tuple(r[f] for f in FEATURES), [0.0, 0.0])
            for i, side in enumerate(("good", "bad")):
                row[i] += weight * r[side] / total[i] if total[i] else 0.0
    for kind, x, label in shown:
        if kind == k:
            sums.setdefault(x, [0.0, 0.0])[0 if label else 1] += each
    return [(x, a, b) for x, (a, b) in sorted(sums.items()) if a + b]


def _apart(rows: DataFrame) -> DataFrame:
    """base and more (arrays) with added: those of more that overlap neither a base span nor one of more with an earlier start."""
    later = lambda a, b: F.greatest(a, b)

    def after_ends(spans: Column, own: Callable[[Column], Column]) -> Column:
        """Of each span the highest end of the spans before it for which own() holds."""
        return scanned(F.transform(spans, lambda s: F.when(own(s), s.getField("end")).otherwise(0)), later)

    order = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s.getField("start").alias("start"), s.getField("more").alias("more"), s.getField("end").alias("end"), s.getField("k").alias("k"), s.getField("base").alias("base"))))
    # Sorted by start: a base span overlaps a later one if it ends behind its start, and an earlier one if it starts before its end.
    far = 1 << 30

    def free(spans: Column) -> Column:
        starts = F.reverse(scanned(F.reverse(F.transform(spans, lambda s: F.when(s.getField("base"), far - s.getField("start")).otherwise(0))), later))
        return _bound(after_ends(spans, lambda s: s.getField("base")), lambda ends: _bound(starts, lambda nexts: F.filter(spans, lambda s, i: ~s.getField("base") & (F.get(ends, i) <= s.getField("start")) & (far - F.get(nexts, i) >= s.getField("end")))))

    def first(spans: Column) -> Column:
        return _bound(after_ends(spans, lambda s: F.lit(True)), lambda ends: F.filter(spans, lambda s, i: F.get(ends, i) <= s.getField("start")))

    added = _bound(order(F.concat("base", "more")), lambda spans: _bound(free(spans), first))
    return rows.withColumn("added", F.when(F.size("more") == 0, F.array()).otherwise(added))


def teaching(rows: DataFrame) -> DataFrame:
    """k, FEATURES, good and bad of all combinations of features that teach."""
    each = rows.select(F.explode("spans").alias("s")).groupBy("s.k", *[f"s.{f}" for f in FEATURES]).agg(F.count_if("s.base").alias("good"), F.count_if("s.fails").alias("bad")).where("good + bad > 0")
    return checkpointed(each)


def _commonest(each: DataFrame, k: int, most: int) -> list[dict]:
    return [r.asDict() for r in each.where(F.col("k") == k).orderBy(F.desc(F.col("good") + F.col("bad")), *FEATURES).limit(most).collect()]


def teaching_rows(rows: DataFrame, most: int) -> list[dict]:
    """Of each kind the `most` commonest rows of teaching(), of equals the smaller ones."""
    each = teaching(rows)
    return [r for k in range(len(KINDS)) for r in _commonest(each, k, most)]


#: Weights and gradients are summed in whole numbers of this part, so that the order of rows does not matter.
UNIT = 1 << 36


def _dealt(each: DataFrame, shown: list, kinds: list[int]) -> DataFrame:
    """key, k, x, z, good, bad, ug, ub: every row and sentence of the kinds for each of FOLDS + 1 models.

    Model `m` of a kind has the key k * (FOLDS + 1) + m; the last one learns from all, the
    others from what is not in their fold (good, bad), by which they are judged (ug, ub).
    The weights are those of taught().
    """
    spark, models = each.sparkSession, FOLDS + 1
    named = F.concat(F.lit("["), F.concat_ws(", ", *[F.col(f).cast("string") for f in FEATURES]), F.lit("]"))
    rows = each.where(F.col("k").isin(kinds)).select("k", F.array(*FEATURES).alias("x"), "good", "bad", (F.crc32(named.cast("binary")) % FOLDS).cast("int").alias("fold"))
    sums = {(r.k, r.fold): (r.a, r.b) for r in rows.groupBy("k", "fold").agg(F.sum("good").alias("a"), F.sum("bad").alias("b")).collect()}
    totals = []
    for k in kinds:
        for m in range(models):
            own, rest = sums.get((k, m), (0, 0)), [v for (j, f), v in sums.items() if j == k and f != m]
            totals.append((k, m, *(sum(v[i] for v in rest) for i in (0, 1)), *own))
    totals = F.broadcast(spark.createDataFrame(totals, "k int, m int, ta long, tb long, oa long, ob long"))
    part = lambda c, t, on: F.when(on & (F.col(t) > 0), 100.0 * F.col(c) / F.col(t)).otherwise(0.0)
    held = F.col("fold") == F.col("m")
    key = (F.col("k") * models + F.col("m")).alias("key")
    out = rows.join(totals, "k").select(key, "k", "x", part("good", "ta", ~held).alias("good"), part("bad", "tb", ~held).alias("bad"), part("good", "oa", held).alias("ug"), part("bad", "ob", held).alias("ub"))
    more = []
    for k in kinds:
        turns = {True: 0, False: 0}
        for _, x, label in (s for s in shown if s[0] == k):
            w = (10.0, 0.0) if label else (0.0, 10.0)
            more += [(k * models + m, k, list(x), *((0.0, 0.0, *w) if turns[label] % FOLDS == m else (*w, 0.0, 0.0))) for m in range(models)]
            turns[label] += 1
    shown_rows = spark.createDataFrame(more, "key int, k int, x array<int>, good double, bad double, ug double, ub double")
    return out.select("key", "k", "x", "good", "bad", "ug", "ub").unionByName(shown_rows)


def _best(by: dict[int, list[tuple[int, float, float]]], ridge: float):
    """As Trees._split(), from the sums of each feature's values: (feature, bound) or None."""
    best = (1e-6, None)
    for f in sorted(by):
        gs, hs = sum(g for _, g, _ in by[f]), sum(h for *_, h in by[f])
        a = b = 0.0
        for v, g, h in sorted(by[f])[:-1]:
            a, b = a + g, b + h
            gain = a * a / (b + ridge) + (gs - a) ** 2 / (hs - b + ridge) - gs * gs / (hs + ridge)
            if gain > best[0]:
                best = (gain, (f, v))
    return best[1]


def far_models(each: DataFrame, shown: list, kinds: list[int], precision: float) -> dict[int, tuple[Trees, float]]:
    """Trees and threshold of each of the kinds, as find() makes them, with the rows of features left where they are.

    A level of a tree needs the sums of gradients by model, branch, feature and value only,
    which are few whatever the number of rows; all trees of a round grow at once.
    """
    models = FOLDS + 1
    w = checkpointed(_dealt(each, shown, kinds))
    trees = {k * models + m: Trees() for k in kinds for m in range(models)}
    for r in w.groupBy("key").agg(F.sum(F.round(F.col("good") * UNIT).cast("long")).alias("a"), F.sum(F.round(F.col("bad") * UNIT).cast("long")).alias("b")).collect():
        p0 = (r.a / UNIT + 1) / ((r.a + r.b) / UNIT + 2)
        trees[r.key].base = math.log(p0 / (1 - p0))
    chosen = lambda of, other: F.coalesce(*[F.when(F.col("key") == key, c) for key, c in of.items()], other) if of else other
    w = w.withColumn("z", chosen({key: F.lit(t.base) for key, t in trees.items()}, F.lit(0.0)))
    n, p = F.col("good") + F.col("bad"), 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z")))))
    whole = lambda c: F.round(c * UNIT).cast("long")

    def sums(rows: DataFrame, branch: Column) -> dict:
        """By key and branch and feature: value, and sums of gradients."""
        told = rows.where(n > 0).select("key", branch.alias("branch"), whole(F.col("good") - n * p).alias("g"), whole(n * p * (1 - p)).alias("h"), F.posexplode("x").alias("f", "v"))
        out: dict = {}
        for r in told.groupBy("key", "branch", "f", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out.setdefault((r.key, r.branch), {}).setdefault(r.f, []).append((r.v, r.g / UNIT, r.h / UNIT))
        return out

    def leaf(t: Trees, by: dict) -> float:
        one = next(iter(by.values()))
        return t.rate * sum(g for _, g, _ in one) / (sum(h for *_, h in one) + t.ridge)

    def value(tree) -> Column:
        return F.when(F.col("x")[tree[0]] <= tree[1], value(tree[2])).otherwise(value(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

    for _ in range(Trees().rounds):
        top = sums(w, F.lit(0))
        cuts = {key: _best(by, trees[key].ridge) for (key, _), by in top.items()}
        low = sums(w, chosen({key: F.when(F.col("x")[c[0]] <= c[1], 1).otherwise(2) for key, c in cuts.items() if c}, F.lit(0)))
        grown = {}
        for (key, _), by in top.items():
            t = trees[key]

            def branch(i, t=t, key=key):
                under = low[key, i]
                c = _best(under, t.ridge)
                if not c:
                    return leaf(t, under)
                side = [{c[0]: [r for r in under[c[0]] if (r[0] <= c[1]) == left]} for left in (True, False)]
                return (*c, leaf(t, side[0]), leaf(t, side[1]))

            grown[key] = (*cuts[key], branch(1), branch(2)) if cuts[key] else leaf(t, by)
            t.trees.append(grown[key])
        w = checkpointed(w.withColumn("z", F.col("z") + chosen({key: value(t) for key, t in grown.items()}, F.lit(0.0))))

    # The threshold as calibrated() has it: sums from the top, by bins of the margin and then within them.
    judged = w.where("ug + ub > 0").groupBy("k", "z").agg(F.sum(whole(F.col("ug"))).alias("a"), F.sum(whole(F.col("ub"))).alias("b")).withColumn("bin", F.floor(F.col("z") * 50))
    bins = judged.groupBy("k", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    above, at = [], {k: (0, 0) for k in kinds}
    for r in sorted(bins, key=lambda r: (r.k, -r.bin)):
        above.append((r.k, r.bin, *at[r.k]))
        at[r.k] = (at[r.k][0] + r.a, at[r.k][1] + r.b)
    bounds = {}
    if above:
        told = judged.join(F.broadcast(each.sparkSession.createDataFrame(above, "k int, bin long, a0 long, b0 long")), ["k", "bin"])
        run = Window.partitionBy("k", "bin").orderBy(F.desc("z")).rowsBetween(Window.unboundedPreceding, 0)
        a, b = F.col("a0") + F.sum("a").over(run), F.col("b0") + F.sum("b").over(run)
        bounds = {r.k: r.z for r in told.select("k", "z", (a / (a + b) >= precision).alias("good")).where("good").groupBy("k").agg(F.min("z").alias("z")).collect()}
    out = {}
    known = w.where(F.col("key") % models == FOLDS).where(n > 0)
    for k in kinds:
        bound = bounds.get(k, math.inf)
        if bound < math.inf:
            below = known.where((F.col("k") == k) & (F.col("z") < bound)).agg(F.max("z")).first()[0]
            bound = (bound + below) / 2 if below is not None else bound
        out[k] = trees[k * models + FOLDS], bound
    return out


def find(docs: DataFrame, precision: float = 0.95, most: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, n_added, spans (coded text), a row per row of docs.

    Counts and base_spans are by the base rules; spans are these and the further candidates
    that the trees accept and that overlap neither a base span nor an accepted one with an
    earlier start. Null and empty texts have no spans. Repeated rows give repeated results,
    null ids are carried along, other columns play no part; an empty table gives an empty
    result. `precision` is that of the threshold over rows and sentences in folds that the
    trees have not seen, by weight. All rows of features teach: those of a kind that has at
    most `most` in the driver, those of others where they are, by far_models().
    The time grows in proportion to a text and its matches. Texts are read once: the
    candidates are written to the checkpoint folder.
    """
    rows = checkpointed(candidates(docs, id_col, text_col))
    each = teaching(rows)
    shown = examples(docs.sparkSession)
    crowded = sorted(r.k for r in each.groupBy("k").count().where(F.col("count") > most).collect())
    far = far_models(each, shown, crowded, precision) if crowded else {}
    models = []
    for k in range(len(KINDS)):
        if k in far:
            models.append(far[k])
            continue
        seen = _commonest(each, k, most)
        known = taught(seen, shown, k)
        trees = Trees().fit(*map(list, zip(*known, strict=True))) if known else Trees()
        bound = calibrated(unseen_margins(seen, shown, k), precision)
        # Halfway to the next lower row, as other combinations lie between the ones that taught.
        below = max((z for x, *_ in known if (z := trees.margin(x)) < bound), default=bound)
        models.append((trees, (bound + below) / 2 if bound < math.inf else bound))

    def accepted(s: Column) -> Column:
        out = F.lit(False)
        for k, (trees, bound) in enumerate(models):
            if bound < math.inf:
                margin = trees.column(lambda i: s.getField(FEATURES[i]))
                out = out | ((s.getField("k") == k) & (margin >= bound - 1e-9))
        return ~s.getField("base") & (s.getField("more") > 0) & out

    rows = _apart(rows.select("doc_id", F.filter("spans", lambda s: s.getField("base")).alias("base"), F.filter("spans", accepted).alias("more")))
    count = lambda k: F.size(F.filter("base", lambda s: s.getField("k") == k)).cast("long")
    every = F.concat(*[F.transform(c, lambda s: F.struct(*[s.getField(f).alias(f) for f in ("k", "start", "end")])) for c in ("base", "added")])
    return rows.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], _coded(F.col("base")).alias("base_spans"), F.size("added").cast("long").alias("n_added"), _coded(every).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """find() with the base spans as a SHA-256 digest, and the number of all spans."""
    every = sum((F.col(f"n_{k}") for k in KINDS), F.col("n_added"))
    return find(docs).select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added", every.alias("n_spans"))
