"""Toxicity: a linear-chain CRF marks toxic words; its marginals give spans and document scores.

Labels are of documents. Labelled tokens are made of them: a word's forms (itself, its
beginnings) that occur in toxic documents far more often than chance allows become the
lexicon, and a toxic document's words with such a form are its toxic tokens. The CRF learns
from these tokens with hashed forms of the word as features and scores words that it never
saw by their parts. The fit takes a bounded sample of labelled rows; scoring takes all
rows, whole texts, in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import slices

TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
WORD = re.compile(r"[^\W\d_]+")
SLOTS = 1 << 18
#: A sequence ends with a sentence or line, or after so many words.
CHAIN = 48


def forms(word: str) -> list[str]:
    n = len(word)
    return ["w" + word] + [f"p{word[:k]}" for k in range(3, 9) if n > k]


#: Hashed features of a word: itself, five beginnings, two endings, its length (in UTF-8 bytes).
WIDTH = 9


def features(words: Iterable[str]):
    """A row of WIDTH feature numbers for each word."""
    import numpy as np

    crc = zlib.crc32
    flat: list[int] = []
    for w in words:
        b = w.encode("utf-8", "surrogatepass")
        flat += (crc(b, 1), crc(b[:3], 3), crc(b[:4], 4), crc(b[:5], 5), crc(b[:6], 6), crc(b[:8], 9), crc(b[-3:], 7), crc(b[-4:], 8), min(len(b), 20))
    return np.array(flat, dtype=np.int64).reshape(-1, WIDTH) % SLOTS


def tokens_of(text: str) -> list[str]:
    """Lower-cased words and stops of a text, as many words as WORD finds in the text itself."""
    low = text.lower()
    if len(low) == len(text):
        return TOKEN.findall(low)
    # A character became two, which may part a word; words are found first, then lower-cased.
    return [w.lower() for w in TOKEN.findall(text)]


def chains(text: str) -> list[list[str]]:
    """Lower-cased words of a text by sequence."""
    out: list[list[str]] = [[]]
    for w in tokens_of(text):
        if w in ".!?\n":
            if out[-1]:
                out.append([])
        else:
            if len(out[-1]) == CHAIN:
                out.append([])
            out[-1].append(w)
    return out if out[-1] else out[:-1]


def padded(lengths):
    """Index of each token in a matrix of sequences by CHAIN, row by row."""
    import numpy as np

    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows, np.arange(int(np.sum(lengths))) - starts[rows]


def marginal_logits(emit, lengths, trans):
    """Log odds of state 1 for each token, by forward-backward over all sequences at once.

    emit: log odds by the token alone, sequence after sequence; trans[i][j]: weight of going
    from state i to state j. Also returned: forward odds, and backward odds with the token's
    own (both padded), which the gradient needs.
    """
    import numpy as np

    rows, cols = padded(lengths)
    n, width = len(lengths), int(max(lengths, default=0))
    e = np.zeros((n, width))
    e[rows, cols] = emit
    inside = np.arange(width)[None, :] < np.asarray(lengths)[:, None]
    t = trans
    fwd, bwd = np.zeros((n, width)), np.zeros((n, width))
    add = np.logaddexp
    for k in range(width):
        fwd[:, k] = e[:, k] + (add(t[0][1], fwd[:, k - 1] + t[1][1]) - add(t[0][0], fwd[:, k - 1] + t[1][0]) if k else 0.0)
    for k in range(width - 2, -1, -1):
        nxt = e[:, k + 1] + bwd[:, k + 1]
        bwd[:, k] = np.where(inside[:, k + 1], add(t[1][0], t[1][1] + nxt) - add(t[0][0], t[0][1] + nxt), 0.0)
    return (fwd + bwd)[rows, cols], fwd, e + bwd, inside


def lexicon(docs: list[tuple[set[str], int]]) -> set[str]:
    """Forms that toxic documents (1) hold far beyond chance: by the likelihood ratio, against the number of forms tried.

    Copies of a document would count as chance that came true many times, so one of them
    is counted: documents with the same three smallest hashes of long words are copies.
    """
    import math
    from collections import Counter

    seen: set[tuple] = set()
    count = [Counter(), Counter()]
    n = [0, 0]
    for words, y in docs:
        long = [w for w in words if len(w) > 5] or list(words)
        keys = [(s, *sorted(zlib.crc32((s + w).encode("utf-8", "surrogatepass")) for w in long)[:3]) for s in "ab"]
        if any(k in seen for k in keys):
            continue
        seen.update(keys)
        n[y] += 1
        count[y].update({f for w in words for f in forms(w)})
    if not all(n):
        return set()
    p = n[1] / sum(n)
    # A form of fewer than four documents can't pass, so it doesn't count as tried.
    tries = math.log(sum(a + count[0][f] >= 4 for f, a in count[1].items()) + 1) + 1
    out, families = set(), set()
    for f, a in count[1].items():
        b = count[0][f]
        q = (a + 0.01) / (a + b + 0.02)
        if a >= 4 and q > 0.5 and a * math.log(q / p) + b * math.log((1 - q) / (1 - p)) > tries:
            if q > 0.9:
                out.add(f)
            if len(f) > 4:
                families.add(f)
    # A beginning that many toxic words share is proof enough for the rarer ones among them.
    for f, a in count[1].items():
        if f[0] == "w" and a >= 3 and a > 3 * count[0][f] and any(x in families for x in forms(f[1:])[1:]):
            out.add(f)
    return out


@dataclass(frozen=True)
class Crf:
    weights: object  # one for each hashed feature
    bias: float
    trans: list[list[float]]
    calibration: tuple[float, float, float, float]

    def emissions(self, words: list[str]) -> list[float]:
        return (self.bias + self.weights[features(words)].sum(axis=1)).tolist()

    def score(self, top, total, n_words):
        """Probability that a document is toxic; see evidence()."""
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(evidence(top, total, n_words) @ np.array(self.calibration), -30, 30)))


def evidence(top, total, n_words):
    """Of each document a one, the highest token log odds, the logarithm of its expected toxic words, and, if there are any, of its length: a long text meets a toxic word's like by chance."""
    import numpy as np

    total = np.asarray(total, dtype=float)
    return np.column_stack([np.ones(len(total)), np.clip(top, -8, 8), np.log1p(total), np.where(total > 0, np.log1p(n_words), 0.0)])


def fit_crf(texts: list[tuple[str, int]], most: int = 20_000, epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Crf:
    """Labelled tokens from labelled texts, then the CRF by Adagrad, then the document score by logistic regression.

    The CRF takes at most `most` sequences with a toxic token and as many without, chosen at random.
    """
    import numpy as np

    docs = [(chains(t or ""), y) for t, y in texts]
    lex = lexicon([({w for c in d for w in c}, y) for d, y in docs])
    is_toxic: dict[str, bool] = {}
    rng = np.random.default_rng(seed)
    marked, clean = [], []
    for d, y in docs:
        for c in d:
            tags = [0] * len(c)
            if y:
                for i, w in enumerate(c):
                    if w not in is_toxic:
                        is_toxic[w] = any(f in lex for f in forms(w))
                    tags[i] = int(is_toxic[w])
            if any(tags):
                marked.append((c, tags))
            elif not y:
                clean.append((c, tags))
    pick = rng.permutation(len(clean))[: max(2000, 2 * len(marked))]
    if len(marked) > most:
        marked = [marked[i] for i in np.random.default_rng(seed + 1).permutation(len(marked))[:most]]
    data = marked + [clean[i] for i in pick[:most]]
    number: dict[str, int] = {}
    coded = [(np.array([number.setdefault(x, len(number)) for x in c]), np.array(tags, dtype=float)) for c, tags in data]
    table = features(number)
    w = np.zeros(SLOTS)
    g2 = np.full(SLOTS, 1e-6)
    small = np.array([-2.0, 0.0, 0.0, 0.0, 0.0])  # bias and transitions
    s2 = np.full(5, 1e-6)
    for _ in range(epochs if marked else 0):
        order = rng.permutation(len(coded))
        for at in range(0, len(order), 512):
            part = [coded[i] for i in order[at : at + 512]]
            lengths = [len(c) for c, _ in part]
            y = np.concatenate([tags for _, tags in part])
            flat = table[np.concatenate([c for c, _ in part])]
            emit = small[0] + w[flat].sum(axis=1)
            trans = small[1:].reshape(2, 2)
            logit, fwd, back, inside = marginal_logits(emit, lengths, trans)
            err = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y
            slots, place = np.unique(flat.ravel(), return_inverse=True)
            grad = np.bincount(place, np.repeat(err, WIDTH), len(slots)) / len(part) + decay * w[slots]
            # Pairwise marginals against the pairs seen.
            both = inside[:, 1:]
            joint = np.stack([i * fwd[:, :-1] + trans[i][j] + j * back[:, 1:] for i in (0, 1) for j in (0, 1)])
            joint = np.exp(joint - joint.max(axis=0))
            joint = joint / joint.sum(axis=0) * both
            rows, cols = padded(lengths)
            tags = np.zeros(inside.shape)
            tags[rows, cols] = y
            seen = [(((tags[:, :-1] == i) & (tags[:, 1:] == j)) & both).sum() for i in (0, 1) for j in (0, 1)]
            sgrad = np.concatenate(([err.sum()], joint.sum(axis=(1, 2)) - seen)) / len(part) + decay * small
            g2[slots] += grad**2
            s2 += sgrad**2
            w[slots] -= rate * grad / np.sqrt(g2[slots])
            small -= rate * sgrad / np.sqrt(s2)
    crf = Crf(w, float(small[0]), small[1:].reshape(2, 2).tolist(), (0.0, 0.0, 0.0, 0.0))
    scorer = Scorer(crf)
    blocks = [[t for t, _ in texts[i : i + 50]] for i in range(0, len(texts), 50)]
    x = np.array([r[:3] for b in blocks for r in scorer.documents(b)]).reshape(-1, 3)
    y = np.array([y for _, y in texts], dtype=float)
    z = evidence(*x.T)
    beta = np.zeros(z.shape[1])
    for _ in range(30 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(beta))
        beta -= np.linalg.solve(hess, z.T @ (p - y) + 0.05 * beta)
    return Crf(w, crf.bias, crf.trans, tuple(map(float, beta)))


class Scorer:
    """Applies a CRF to texts; words' emissions are kept between texts, at most `kept` of them."""

    def __init__(self, crf: Crf, kept: int = 300_000) -> None:
        self.crf, self.kept, self.known = crf, kept, {}

    def documents(self, texts: list[str | None]) -> Iterator[tuple[float, float, int, list[tuple[int, int]]]]:
        """Of each text the highest log odds, the expected number of toxic words, the number of words and stops, and the spans of toxic words."""
        import numpy as np

        known = self.known
        if len(known) > self.kept:
            known.clear()
        end = float("nan")
        known.update({x: end for x in (".", "!", "?", "\n")})
        tokens: list[str] = []
        counts = []
        for t in texts:
            words = tokens_of(t) if t else []
            tokens += words
            counts.append(len(words))
        fresh = list(set(tokens) - known.keys())
        known.update(zip(fresh, self.crf.emissions(fresh)))
        v = np.fromiter(map(known.__getitem__, tokens), float, len(tokens))
        doc = np.repeat(np.arange(len(texts)), counts)
        stop = np.isnan(v)
        # A sequence ends at a stop or with the document; long ones are cut by length.
        run = np.cumsum(stop)
        keep = ~stop
        v, doc, run = v[keep], doc[keep], run[keep]
        top, total = np.full(len(texts), -8.0), np.zeros(len(texts))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        if len(v):
            new = np.concatenate(([True], (np.diff(run) != 0) | (np.diff(doc) != 0)))
            first = np.flatnonzero(new)
            place = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
            new |= place % CHAIN == 0
            first = np.flatnonzero(new)
            lengths = np.diff(np.append(first, len(v)))
            logit = np.empty(len(v))
            # Sequences of like length together keep the matrices full.
            for lo, hi in ((1, 4), (5, 12), (13, 24), (25, CHAIN)):
                pick = np.flatnonzero((lengths >= lo) & (lengths <= hi))
                if len(pick):
                    size = lengths[pick]
                    rows, cols = padded(size)
                    at = first[pick][rows] + cols
                    logit[at] = marginal_logits(v[at], size, self.crf.trans)[0]
            np.maximum.at(top, doc, logit)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            total = np.bincount(doc, np.where(p > 0.5, p, 0.0), len(texts))
            for d in np.unique(doc[p > 0.5]):
                flags = p[doc == d] > 0.5
                spans[d] = [m.span() for m, f in zip(WORD.finditer(texts[d]), flags) if f]
        return zip(top.tolist(), total.tolist(), counts, spans)


def sample(docs: DataFrame, labels: DataFrame, per_class: int, longest: int = 100_000) -> list[tuple[str, int]]:
    """Texts and labels of at most per_class labelled rows of each class, those with the smallest hashes of their ids.

    Texts of more than `longest` characters do not teach. Where ids repeat among the documents,
    four times as many rows at most teach, those with the smallest hashes of id and text.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    few = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(per_class)
        few = part if few is None else few.unionByName(part)
    # The join's small side is bounded by per_class, whatever the corpus holds.
    found = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= longest).join(F.broadcast(few), "doc_id")
    found = found.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "y", "text").limit(4 * per_class).collect()
    return [(r.text or "", r.y) for r in sorted(found, key=lambda r: (r.doc_id, r.y, r.text or ""))]


def score(docs: DataFrame, labels: DataFrame, least: float = 0.7, per_class: int = 1500, longest: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_toxic, spans for every row of docs; learns from the rows of `labels` (doc_id, toxic) alone.

    spans are first character and end of each word with a marginal above one half, comma-
    joined as start:end. Null and empty texts have no words and get the score of a text
    without a toxic word. Rows with a null id or label teach nothing; repeated rows are
    scored repeatedly; other columns play no part. Without labels of both classes all
    documents get the same score. An empty table gives an empty result. per_class and
    longest bound the labelled rows that the fit takes; see sample() and fit_crf().
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit_crf(sample(rows, labels, per_class, longest)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for b in slices(batches, "text"):
            top, total, n, spans = map(list, zip(*scorer.documents(b.column("text").to_pylist())))
            s = scorer.crf.score(np.array(top), np.array(total), np.array(n))
            cols = [pa.array(s), pa.array((s >= least).astype("int32")), pa.array([len(x) for x in spans], pa.int64()), pa.array([",".join(f"{i}:{j}" for i, j in x) for x in spans], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "score", "predicted", "n_toxic", "spans"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int, n_toxic long, spans string")
