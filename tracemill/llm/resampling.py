"""Resampling towards a target distribution: hashed features, weights from one array, an exact distributed draw.

Documents and the target are counted into 10,000 buckets of words and pairs of words. A
document's weight is the mean of its features' gains, looked up in one array, and a Gumbel
variable from its id makes a draw without replacement of its top scores. The k-th key is
found by radix selection: one count for each 16 bits of the composite key of score and id.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import CRC_TABLE_SQL, checkpointed, crc_sql, row_key, slices

N_BUCKETS = 10_000
#: Bits of a digit of the selection: a round's counts are 65,536 rows at most.
BITS = 16
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: A-Z to lower case, other ASCII but letters and digits to a space; bytes from 128 on stay, so that characters stay whole.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(raw: bytes, n_buckets: int = N_BUCKETS, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and buckets of the words and pairs of each piece of a text, in turn. A piece ends between words; a pair over its end goes with the next piece."""
    plain, at, last, crc = raw.translate(LETTERS), 0, None, zlib.crc32
    while at < len(plain):
        end = plain.find(b" ", at + piece)
        end = len(plain) if end < 0 else end
        found = plain[at:end].split()
        at = end
        if not found:
            continue
        ones = list(map(crc, found))
        before = ones[:-1] if last is None else [last, *ones[:-1]]
        # The checksum of a pair goes on from that of its first word.
        twos = map(crc, [b" " + w for w in (found[1:] if last is None else found)], before)
        last = ones[-1]
        yield len(found), np.fromiter((*ones, *twos), dtype=np.int64) % n_buckets


def bucket_counts(docs: DataFrame, text_col: str = "text", n_buckets: int = N_BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task adds up its own before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, dtype=np.int64)
        for b in batches:
            for raw in b.column(0):
                for _, found in features(raw.as_py() or b"", n_buckets):
                    total += np.bincount(found, minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("binary").alias("raw")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(n_buckets, dtype=np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1,000 times the log ratio of each bucket's smoothed share of the target and of the corpus, floored."""
    n, s_all, t_all = len(corpus), float(corpus.sum()) + len(corpus), float(target.sum()) + len(corpus)
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * s_all / ((float(corpus[b]) + 1) * t_all))) for b in range(n)], dtype=np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """1,000 times a Gumbel variable, floored, from the first 32 bits of sha256 of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = N_BUCKETS) -> DataFrame:
    """id, k1 and k2 (of the text), n_words, n_features, weight, score of each row. Two passes over the texts: counts of all, then weights."""
    table = gains(bucket_counts(docs, text_col, n_buckets), bucket_counts(target, text_col, n_buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "raw"):
            out = []
            for i, raw in zip(b.column(0).to_pylist(), b.column(3)):
                n_words = n = total = 0
                for k, found in features(raw.as_py() or b"", n_buckets):
                    n_words, n, total = n_words + k, n + len(found), total + int(table[found].sum())
                weight = total // n if n else 0
                out.append((n_words, n, weight, weight + noise(seed, i)))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], ["id", "k1", "k2", "n_words", "n_features", "weight", "score"])

    keys = row_key(id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), keys[2].alias("k1"), keys[3].alias("k2"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    return rows.mapInArrow(run, "id long, k1 long, k2 long, n_words long, n_features long, weight long, score long")


def _digit(key: Column, at: int) -> Column:
    """The at-th digit of a long, from the left, as an unsigned number that keeps the order of signed ones."""
    digit = F.shiftrightunsigned(key, 64 - BITS * (at + 1)).bitwiseAND(F.lit((1 << BITS) - 1))
    return digit.bitwiseXOR(F.lit(1 << (BITS - 1))) if at == 0 else digit


def _digits(value: int) -> list[int]:
    value += 1 << 63
    return [value >> (64 - BITS * (k + 1)) & ((1 << BITS) - 1) for k in range(64 // BITS)]


def smallest(rows: DataFrame, keys: list[Column], k: int, ranges: list[tuple[int, int]]) -> Column:
    """A condition that holds for the k rows with the smallest keys (columns of longs that no two rows share), by radix selection.

    ranges has the least and largest value of each key: digits that all rows share take no
    round. Every round counts one digit of the rows that are still in question, up to 65,536
    counts, and ends the selection where a digit's rows are taken to the last.
    """
    known: list[tuple[Column, int]] = []
    for key, (low, high) in zip(keys, ranges, strict=True):
        a, b = _digits(low), _digits(high)
        same = next((j for j in range(len(a)) if a[j] != b[j]), len(a))
        for at in range(same, len(a)):
            digit, rest = _digit(key, at), rows
            for column, value in known:
                rest = rest.where(column == value)
            found = rest.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()
            for d, n in sorted(found):
                if k <= n:
                    break
                k -= n
            known.append((digit, d))
            if k == n:
                break
        else:
            continue
        break
    inside = F.lit(True)
    for column, value in reversed(known):
        inside = (column < value) | ((column == value) & inside)
    return inside


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank (1, 2, 3 ...) by `order`: a range sort, and for each partition the number of rows before it."""
    at = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    spot = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = at.select("*", F.spark_partition_id().alias("part"), spot.alias("spot"))
    before, starts = 0, []
    for r in at.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r.part, before))
        before += r.n
    offsets = rows.sparkSession.createDataFrame(starts, "part int, before long")  # a row for each partition
    return at.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("spot") + 1).drop("part", "spot", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = N_BUCKETS) -> DataFrame:
    """id, k1, k2, n_words, n_features, weight, score, rank of every row of docs; rank is null for those that are not drawn.

    `percent` of the rows with at least `least_words` words are drawn, rounded down: those
    with the highest scores, ties to the smaller id, null ids last, then by the text's hash;
    equal rows are drawn one by one. A null or empty text has no features, weight 0 and is
    never drawn (unless least_words is 0). Null ids share one random number. An empty target
    or table is counted as no features. Other columns take no part, whatever their names; a
    text is cut by pieces of a megabyte, however long it is.

    Only numbers of each row are written before the draw, only drawn rows are sorted, and the
    driver holds the counts of 10,000 buckets, of a digit, or of the partitions.
    """
    rows = checkpointed(scored(docs, target, seed, id_col, text_col, n_buckets)).withColumn("salt", F.monotonically_increasing_id())
    fit = rows.where(F.col("n_words") >= least_words)
    null_id, id_ = F.col("id").isNull().cast("long"), F.coalesce("id", F.lit(0)).cast("long")
    keys = [-F.col("score"), null_id, id_, F.col("k1"), F.col("k2"), F.col("salt")]
    found = fit.agg(F.count("*"), *[f(k) for k in keys for f in (F.min, F.max)]).first()
    k = percent * found[0] // 100
    if not k:
        return rows.drop("salt").withColumn("rank", F.lit(None).cast("long"))
    drawn = (F.col("n_words") >= least_words) & smallest(fit, keys, k, [(found[1 + 2 * j], found[2 + 2 * j]) for j in range(len(keys))])
    best = ranked(rows.where(drawn), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("k1"), F.col("k2"), F.col("salt")])
    return best.unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))).drop("salt")


def drawn_documents(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that resample() draws, with all their columns. Of rows equal in id and text all stay if one is drawn."""
    best = resample(docs, target, percent, least_words, seed, id_col, text_col).where("rank is not null")
    names = ["__id", "__k1", "__k2"]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    keys = row_key(id_col, text_col)
    mine = docs.select("*", F.col(f"`{id_col}`").cast("long").alias(names[0]), keys[2].alias(names[1]), keys[3].alias(names[2]))
    best = best.select("id", "k1", "k2").distinct()
    same = mine[names[0]].eqNullSafe(best["id"]) & (mine[names[1]] == best["k1"]) & (mine[names[2]] == best["k2"])
    return mine.join(best, same, "left_semi").drop(*names)


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FEATURES_SQL = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f"

ORACLE_SQL = f"""
WITH ct AS (SELECT {CRC_TABLE_SQL} AS tb),
dw AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
fe AS (SELECT doc_id, {_FEATURES_SQL} FROM dw),
be AS (SELECT {_FEATURES_SQL} FROM (SELECT {_WORDS_SQL} AS w FROM benchmark)),
bk AS (SELECT f, {crc_sql("f", "tb")} % 10000 AS b FROM (SELECT DISTINCT f FROM fe UNION SELECT f FROM be), ct),
sc AS (SELECT b, count(*) AS s FROM fe JOIN bk USING (f) GROUP BY b), tc AS (SELECT b, count(*) AS t FROM be JOIN bk USING (f) GROUP BY b),
nn AS (SELECT (SELECT count(*) FROM fe) + 10000.0::DOUBLE AS sa, (SELECT count(*) FROM be) + 10000.0::DOUBLE AS ta),
ga AS (SELECT sc.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * sa / ((s + 1)::DOUBLE * ta))) AS g FROM sc LEFT JOIN tc ON sc.b = tc.b, nn),
we AS (SELECT doc_id, count(*) AS n, floor(sum(g) / count(*)) AS w FROM fe JOIN bk USING (f) JOIN ga USING (b) GROUP BY doc_id),
al AS (SELECT dw.doc_id, len(dw.w) AS words, coalesce(n, 0) AS n_features, CAST(coalesce(we.w, 0) AS BIGINT) AS weight,
  CAST(coalesce(we.w, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || dw.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM dw LEFT JOIN we ON dw.doc_id = we.doc_id),
ra AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS c FROM al WHERE words >= 20)
SELECT al.doc_id, n_features, weight, score, CASE WHEN r <= 25 * c // 100 THEN r END AS rank FROM al LEFT JOIN ra ON al.doc_id = ra.doc_id
"""
