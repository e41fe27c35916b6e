"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Documents are counted by their pattern
of votes, which are at most 3 ** rules rows whatever the corpus holds; expectation-
maximisation on these counts estimates how often each rule votes what on good and on bad
documents. A document is kept where the posterior probability of being good is high
enough, instead of where all rules pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import checkpointed, words_of

HAS_WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct, n_doubled, n_stops, n_letters; a row per row of docs.

    Repeated three-word windows are found inside the row: each window's hash and place are
    packed into one number, the numbers sorted, and neighbours with equal hashes compared
    word for word. A text in which different windows share a hash has its windows sorted by
    their words instead. Nothing is shuffled, and a text of n words costs n log n. Of a
    window's hash at most hash_bits bits count; fewer change no result, they only send more
    texts the second way.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), words_of(F.col(text_col)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(HAS_WORD)))
    bits = "cast(ceil(log2(greatest(size(words), 2))) as int)"
    # Positions 0 to n - 3; the packed number keeps the low bits for the place.
    packed = F.expr(f"""CASE WHEN size(words) < 3 THEN array() ELSE sort_array(transform(slice(words, 1, size(words) - 2),
        (w, i) -> shiftleft(xxhash64(w, get(words, i + 1), get(words, i + 2)) & {(1 << hash_bits) - 1 if hash_bits < 64 else -1}L, bits) | i)) END""")
    rows = rows.withColumn("bits", F.expr(bits)).withColumn("packed", packed)
    place = lambda o: f"cast(get(packed, i {o} 1) & mask as int)"
    hashes = lambda o: f"shiftrightunsigned(x ^ coalesce(get(packed, i {o} 1), ~x), bits) = 0"
    words = lambda o: " AND ".join(f"get(words, cast(x & mask as int) + {k}) = get(words, {place(o)} + {k})" for k in range(3))
    same = lambda o: f"({hashes(o)} AND {words(o)})"
    rows = rows.withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))
    # Where different windows share a hash, equal ones need not be neighbours.
    by_words = """sort_array(transform(slice(words, 1, size(words) - 2), (w, i) -> struct(w AS a, get(words, i + 1) AS b, get(words, i + 2) AS c, cast(i as long) AS i)))"""
    equal = lambda o: f"coalesce(x.a = get(s, i {o} 1).a AND x.b = get(s, i {o} 1).b AND x.c = get(s, i {o} 1).c, false)"
    sorted_ = f"sort_array(flatten(transform(array({by_words}), s -> transform(filter(s, (x, i) -> {equal('-')} OR {equal('+')}), x -> x.i))))"
    rows = rows.withColumn("at", F.expr(f"""CASE WHEN exists(transform(packed, (x, i) -> {hashes('-')} AND NOT ({words('-')})), x -> x) THEN {sorted_}
        ELSE sort_array(transform(filter(packed, (x, i) -> {same('-')} OR {same('+')}), x -> x & mask)) END"""))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(at, (p, i) -> least(3L, coalesce(get(at, i + 1), p + 3) - p)), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.expr("filter(words, (w, i) -> w = get(words, i - 1))")).cast("long").alias("n_doubled"),
        F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("n_stops"),
        F.length(F.regexp_replace("text", "\\P{L}+", "")).cast("long").alias("n_letters"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[Column, Column]]:
    """Of each rule, when it votes bad and when good. Where neither holds it abstains.

    To pass a check for one fault says nothing about the others, so most rules only vote
    bad or abstain; the last two also know good signs.
    """
    never = F.lit(False)
    mean, n = _ratio("word_chars", "n_words"), F.col("n_words")
    repeats, stops = _ratio("n_repeat_words", "n_words"), _ratio("n_stops", "n_words")
    variety = _ratio("n_distinct", "n_words") * F.sqrt(n)
    return {
        "symbols_per_word": (_ratio("n_symbols", "n_words") > 0.2, never),
        "symbols_per_character": (_ratio("n_symbols", "word_chars") > 0.05, never),
        "letters": (_ratio("n_letters", "word_chars") < 0.8, never),
        "word_length": ((mean < 3) | (mean > 12), never),
        "duplicate_lines": (_ratio("n_dup_lines", "n_lines") > 0.3, never),
        "repeated_windows": (repeats > 0.3, never),
        "doubled_words": (_ratio("n_doubled", "n_words") > 0.2, never),
        "variety": (variety < 3, variety > 6),
        "sentences": (stops < 0.005, (stops > 0.02) & (stops < 0.5)),
    }


def fit_rules(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, prior: float = 0.9) -> tuple[float, list[dict[int, float]]]:
    """Log odds of good before any vote, and for each rule what each of its votes adds.

    patterns has vote patterns and how many documents have each. The start, at which rules
    vote bad on half of the bad documents and on few good ones, tells bad from good; counts
    of one half keep every probability above zero. Without documents the start is returned.
    """
    m = len(patterns[0][0]) if patterns else 0
    good = [{1: 0.28, 0: 0.7, -1: 0.02} for _ in range(m)]
    bad = [{1: 0.1, 0: 0.4, -1: 0.5} for _ in range(m)]
    total = sum(n for _, n in patterns)

    def weights() -> list[dict[int, float]]:
        # A vote for good must not count against a document, nor one for bad in its favour.
        raw = [{v: math.log(g[v] / b[v]) for v in (-1, 0, 1)} for g, b in zip(good, bad)]
        return [{v: max(0.0, x) if v > 0 else min(0.0, x) if v < 0 else x for v, x in r.items()} for r in raw]

    for _ in range(rounds):
        w, base = weights(), math.log(prior / (1 - prior))
        sums = [[{v: 0.5 for v in (-1, 0, 1)} for _ in range(m)] for _ in range(2)]
        goods = 0.0
        for votes, n in patterns:
            z = base + sum(w[j][v] for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
            goods += n * p
            for j, v in enumerate(votes):
                sums[0][j][v] += n * p
                sums[1][j][v] += n * (1 - p)
        for j in range(m):
            for side, target in zip(sums, (good, bad)):
                t = sum(side[j].values())
                target[j] = {v: x / t for v, x in side[j].items()}
        now = min(0.99, max(0.01, (goods + 0.5) / (total + 1)))
        if abs(now - prior) < 1e-9:
            break
        prior = now
    return math.log(prior / (1 - prior)), weights()


def judge(docs: DataFrame, least: float = 0.5, min_words: int = 50, max_repeat: float = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics of text_statistics(), base_failed, posterior (double) and kept (boolean), a row per row of docs.

    base_failed: fewer than min_words words, or more than max_repeat % of them in repeated
    windows. kept: not base_failed and posterior >= least. Null, empty and blank texts have
    no words and fail. Repeated rows give repeated results, null ids are carried along, other
    columns play no part, an empty table gives an empty result. The statistics are written to
    the checkpoint folder once, so that texts are read once.
    """
    stats = checkpointed(text_statistics(docs, id_col, text_col))
    votes = {k: F.when(bad, -1).when(good, 1).otherwise(0) for k, (bad, good) in rules().items()}
    counted = stats.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).count().collect()
    base, weight = fit_rules(sorted((tuple(r[k] for k in votes), r["count"]) for r in counted))
    z = F.lit(base)
    for (_, v), w in zip(votes.items(), weight):
        z = z + F.when(v == -1, w[-1]).when(v == 1, w[1]).otherwise(w[0])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    posterior = 1 / (1 + F.exp(-z))
    return stats.select("*", failed.alias("base_failed"), posterior.alias("posterior"), (~failed & (posterior >= least)).alias("kept"))
