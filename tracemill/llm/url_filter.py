"""URL filter: rules by host and path, and for what no rule fits a ratio of two character models.

Smoothed variable-order Markov models of the allowed and of the blocked URLs are counted
from the rows that rules judge. The log-likelihood difference of a URL, by its length, is
held against a threshold that is calibrated on hosts the models have not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import checkpointed, slices

#: Characters of the longest context, and contexts that the models keep: all. A caller may ask for a number of the commonest, shorter first.
ORDER, MAX_CONTEXTS = 5, None
#: Ratios are summed in whole numbers of this part.
SCALE = 1 << 36
#: A context that occurs less often gives way to its shorter one.
LEAST = 2
#: Before the first character, behind the last, and for all but printable ASCII, so that a context has at most 96 followers.
START, END, OTHER = "\x02", "\x03", "\x7f"
#: The characters that can follow.
ALPHABET = 96
#: Hosts of one of so many folds calibrate and are not counted.
FOLDS = 5
#: Scores are binned by thousandths, ten either way.
BIN, BINS = 0.001, 10_000
#: Distinct runs of characters that a task keeps with their counts before it sends them.
KEPT = 200_000


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the beginning of a path."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
)


def host_of(url: Column) -> Column:
    """What stands behind the first `://`, up to a slash, question mark or hash, with A-Z in lower case; empty without one."""
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands behind the host, up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[Rule] = RULES) -> Column:
    """struct(text, allow) of the longest rule that fits, or null. The rules are an expression, so some hundreds at most."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.allow).alias("allow"))).otherwise(out)
    return out


def plain(url: Column) -> Column:
    """What the models read: host and path, with all but printable ASCII as one character."""
    return F.regexp_replace(F.concat(host_of(url), path_of(url)), "[^\\x21-\\x7E]", OTHER)


def grams(text: str, order: int = ORDER) -> Iterator[str]:
    """Each character, and the end, behind its context."""
    padded = START * order + text + END
    return (padded[i : i + order + 1] for i in range(len(text) + 1))


def counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, allowed, blocked: how often each character follows each longest context. rows has text and allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def told() -> pa.RecordBatch:
            names = list(seen[0] | seen[1])
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in seen)], ["gram", "allowed", "blocked"])
            for c in seen:
                c.clear()
            return out

        for b in batches:
            for text, allow in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for g in grams(text.as_py(), order):
                    seen[0 if allow else 1][g] += 1
                    if len(seen[0]) + len(seen[1]) > KEPT:
                        yield told()
        yield told()

    found = rows.select("text", "allow").mapInArrow(run, "gram string, allowed long, blocked long")
    return found.groupBy("gram").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))


def contexts(found: DataFrame, order: int = ORDER, most: int | None = MAX_CONTEXTS, least: int = LEAST) -> DataFrame:
    """context, na, da, nb, db, followers: the contexts of the models, those of all lengths that occur `least` times, with their occurrences and distinct followers in each model.

    Shorter contexts' counts are sums of longer ones', so the URLs are gone through once. A
    context occurs no oftener than its end, so what a kept one backs off to is kept as well,
    also where a caller asks for the `most` commonest only.
    """
    each = found.select(F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k"), "gram", "allowed", "blocked")
    rows = each.groupBy(F.expr(f"substring(gram, {order + 1} - k, k)").alias("context"), F.right("gram", F.lit(1)).alias("next")).agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    # A context has 97 followers at most, so its list is bounded.
    per = rows.groupBy("context").agg(F.sum("a").alias("na"), F.count_if(F.col("a") > 0).alias("da"), F.sum("b").alias("nb"), F.count_if(F.col("b") > 0).alias("db"), F.collect_list(F.struct("next", "a", "b")).alias("followers"))
    kept = per.where(F.col("na") + F.col("nb") >= least)
    return kept if most is None else kept.orderBy(F.desc(F.col("na") + F.col("nb")), F.length("context"), "context").limit(most)


def text_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """id, gram, n: the runs of each text with their counts. rows has id (long) and text, not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = [], [], []

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["id", "gram", "n"])
            for x in out:
                x.clear()
            return batch

        for b in slices(batches, "text"):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = Counter(grams(text, order))
                out[0].extend([i] * len(found))
                out[1].extend(found)
                out[2].extend(found.values())
                if len(out[0]) > KEPT // 4:
                    yield told()
        yield told()

    return rows.select("id", "text").mapInArrow(run, "id long, gram string, n long")


def ratios(asked: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """gram and ratio, in units of 1 / SCALE, of each of the grams asked that the models know anything of.

    Two variable-order models over one set of contexts: log of the allowed one's probability
    less the blocked one's. A probability is Witten and Bell's interpolation, from the
    shortest context to the longest that the model has; below the shortest all characters
    are alike. Contexts of at most one character, 98 of them, go to all tasks; the others
    meet the grams by a join.
    """
    each = asked.select("gram", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")).withColumn("context", F.expr(f"substring(gram, {order + 1} - k, k)"))
    short = each.where("k <= 1").join(F.broadcast(model.where("length(context) <= 1")), "context")
    met = short.unionByName(each.where("k > 1").join(model.where("length(context) > 1"), "context"))
    mine = F.get(F.filter("followers", lambda f: f["next"] == F.right("gram", F.lit(1))), F.lit(0))
    one = lambda c: F.coalesce(mine[c], F.lit(0)).cast("double")
    entry = F.struct("k", *[F.struct(F.col(f"n{c}").cast("double").alias("n"), F.col(f"d{c}").cast("double").alias("d"), one(c).alias("f")).alias(c) for c in "ab"])
    chains = met.select("gram", entry.alias("e")).groupBy("gram").agg(F.array_sort(F.collect_list("e")).alias("chain"))

    def log(which: str) -> Column:
        # What a context backs off to has occurred wherever it has, so the chain has no gap.
        step = lambda p, e: F.when(e[which]["n"] > 0, (e[which]["f"] + e[which]["d"] * p) / (e[which]["n"] + e[which]["d"])).otherwise(p)
        return F.log(F.aggregate("chain", F.lit(1 / ALPHABET), step))

    return chains.select("gram", F.round((log("a") - log("b")) * SCALE).cast("long").alias("ratio"))


def scores(rows: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """id and score of the texts: the ratios' sum for each character, the end counted. rows has id and text, neither null nor empty."""
    each = checkpointed(text_grams(rows, order))
    known = ratios(each.select("gram").distinct(), model, order)
    total = each.join(known, "gram").groupBy("id").agg(F.sum(F.col("n") * F.col("ratio")).alias("total"))
    # Sums of whole numbers, so that the order of rows does not matter.
    return rows.join(total, "id").select("id", (F.col("total") / F.lit(SCALE) / (F.length("text") + 1)).alias("score"))


def threshold(bins: list[tuple[int, bool, int]]) -> float:
    """Where the shares of allowed and blocked rows told apart sum to most; of equals the one nearest to 0. 0 without both kinds."""
    n = Counter()
    for _, allow, k in bins:
        n[allow] += k
    if not n[True] or not n[False]:
        return 0.0
    by = Counter()
    for at, allow, k in bins:
        by[at] += k * n[not allow] * (1 if allow else -1)
    # With the threshold at the lowest bin all rows are allowed; each step up blocks a bin's rows. All whole numbers.
    best, gained, last = (0, 0, 0), 0, None
    for at in sorted(by):
        if last is not None:
            # Between two filled bins every place is alike.
            near = min(max(0, last + 1), at)
            best = max(best, (gained, -abs(near), near))
        gained, last = gained - by[at], at
    return best[2] * BIN


def fold_of(host: Column) -> Column:
    return F.crc32(host.cast("binary")) % FOLDS


def judge(pages: DataFrame, rules: Iterable[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER, most: int | None = MAX_CONTEXTS) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold of each row.

    The longest rule that fits gives the verdict; the score is null then. Other URLs are
    allowed if their score reaches the threshold. A null URL, or one without `://`, has an
    empty host and path and the score 0, and so have all where rules allow none or block
    none. Hosts of fold 0 of 5, by crc32, calibrate the threshold and are not counted; the
    threshold is 0 if they hold one kind only. Rows are judged one by one, repeated ones
    alike; an empty table gives no rows. Columns beside id and URL take no part.

    All rows that rules judge are counted, each task's before they are sent, and all contexts
    that occur twice make up the models, unless a caller asks for the `most` commonest. The
    models stay a table, which the distinct runs of the URLs' characters are joined with; the
    driver holds the bins only. A URL costs its length, however long it is.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), plain(url).alias("text"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "text", F.col("rule.text").alias("rule"), F.col("rule.allow").alias("allow"))
    rows = checkpointed(rows.withColumn("held", fold_of(F.col("host")) == 0).withColumn("id", F.monotonically_increasing_id()))
    taught = rows.where("rule is not null and not held")
    model = checkpointed(contexts(checkpointed(counts(taught, order)), order, most))
    both = model.agg(F.coalesce(F.max("na"), F.lit(0)).alias("a"), F.coalesce(F.max("nb"), F.lit(0)).alias("b")).first()
    if both.a and both.b:
        asked = rows.where("(rule is null or held) and text <> ''").select("id", "text")
        found = checkpointed(scores(asked, model, order))
        rows = rows.join(found, "id", "left")
    else:
        rows = rows.withColumn("score", F.lit(None).cast("double"))
    # A text without characters, or of which the models know nothing, has the score 0.
    rows = rows.withColumn("score", F.when(F.col("rule").isNull() | F.col("held"), F.coalesce("score", F.lit(0.0))))
    bin_ = F.greatest(F.least(F.floor(F.col("score") / BIN), F.lit(BINS)), F.lit(-BINS))
    least = 0.0
    if both.a and both.b:
        held = rows.where("held and rule is not null").groupBy(bin_.cast("int").alias("at"), "allow").agg(F.count("*").alias("n"))
        least = threshold([tuple(r) for r in held.collect()])
    # In whole bins, as the threshold was sought.
    allowed = F.coalesce(F.col("allow"), F.floor(F.col("score") / BIN) * BIN >= F.lit(least - BIN / 2))
    return rows.select("page_id", "host", "path", "rule", F.when(allowed, "allow").otherwise("block").alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"), F.lit(least).alias("threshold"))


def allowed_pages(pages: DataFrame, rules: Iterable[Rule] = RULES, url_col: str = "url", order: int = ORDER, most: int | None = MAX_CONTEXTS) -> DataFrame:
    """The rows of pages whose URL is allowed, with all their columns. Rows are judged by URL, so repeated ones stay or go together."""
    name = "__url"
    while name in pages.columns:
        name = f"_{name}"
    urls = pages.select(F.col(f"`{url_col}`").alias("url"))
    found = judge(urls, rules, id_col="url", order=order, most=most)
    good = found.where("verdict = 'allow'").select(F.coalesce("page_id", F.lit("")).alias(name)).distinct()
    return pages.withColumn(name, F.coalesce(F.col(f"`{url_col}`"), F.lit(""))).join(good, name, "left_semi").drop(name)
