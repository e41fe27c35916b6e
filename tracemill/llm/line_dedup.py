"""Line dedup by overlapping three-line windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import KEY, checkpointed, free_prefix, row_key

WINDOW = 3


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """Key columns, h1, h2 and pos: a row for each run of `width` lines that has a word, hashed to 128 bits."""
    rows = docs.select(*row_key(id_col, text_col), _lines(text_col).alias("lines")).where(F.size("lines") >= width)
    # The line numbers in hashed order stay inside the row; only hashes and places are exploded.
    hashed = rows.select(*KEY, F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")).alias("w"))).alias("hs"))
    one = F.posexplode(F.expr(f"transform(sequence(1, size(hs) - {width - 1}), i -> struct({', '.join(f'hs[i + {k - 1}] as l{k}' for k in range(width))}))")).alias("pos", "v")
    parts = lambda f: [F.col(f"v.l{k}.{f}") for k in range(width)]
    some = F.lit(False)
    for c in parts("w"):
        some = some | c
    return hashed.select(*KEY, one).where(some).select(*KEY, "pos", F.xxhash64(*parts("a")).alias("h1"), F.xxhash64(F.lit(1), *parts("b")).alias("h2"))


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """Key columns and drop (array of int): the lines that a later occurrence of a window covers."""
    w = checkpointed(windows(docs, id_col, text_col, width))
    place = F.struct(*KEY, "pos")
    first = w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    later = w.join(first, ["h1", "h2"]).where(place > F.col("first"))
    # Repeated rows give a place twice.
    at = later.groupBy(*KEY).agg(F.collect_set("pos").alias("at"))
    return at.select(*KEY, F.expr(f"array_sort(array_distinct(flatten(transform(at, p -> sequence(p, p + {width - 1})))))").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, removed_col: str | None = None) -> DataFrame:
    """docs with later occurrences of repeated three-line windows cut from the text.

    Windows are compared over all documents. The first occurrence, by id and then by place,
    stays whole; every line of a later one goes, and overlapping windows go together. Texts
    of fewer than three lines, and windows of blank lines alone, are left as they are. A
    later copy of a whole text becomes empty; its row stays. A null text stays null. Null ids
    come last in the order. Rows equal in id and text count as one document and are changed
    alike. All columns of docs are kept, whatever their names; `removed_col` adds the number
    of lines cut. An empty table gives an empty result.
    """
    p = free_prefix(docs)
    cut = covered(docs, id_col, text_col, width).select(*[F.col(k).alias(p + k) for k in KEY], F.col("drop").alias(f"{p}drop"))
    keys = [c.alias(f"{p}r{i}") for i, c in enumerate(row_key(id_col, text_col))]
    rows = docs.select("*", *keys).join(cut, F.expr(" and ".join(f"{p}r{i} = {p}d{i}" for i in range(4))), "left")
    lines, drop = _lines(text_col), F.col(f"{p}drop")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    text = F.when(drop.isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = rows.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *([F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(removed_col)] if removed_col else []))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines_removed, n_chars_left, text_sha256 of the deduplicated texts; a null text has the digest of an empty one."""
    clean = dedup_lines(docs.select("doc_id", "text"), removed_col="n_lines_removed")
    text = F.coalesce("text", F.lit(""))
    return clean.select("doc_id", "n_lines_removed", F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"))


ORACLE_SQL = """
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, text, unnest(range(1, len(lines) - 1)) AS p, lines FROM l WHERE len(lines) >= 3),
x AS (SELECT doc_id, text, p, array_to_string(lines[p:p + 2], chr(10)) AS win FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS nth FROM x WHERE regexp_matches(win, '[^ \\x09-\\x0D]')),
gone AS (SELECT doc_id, unnest([p, p + 1, p + 2]) AS i FROM k WHERE nth > 1),
cut AS (SELECT DISTINCT doc_id, i FROM gone),
rows AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM l),
kept AS (SELECT r.doc_id, count(c.i) AS n, string_agg(r.line, chr(10) ORDER BY r.i) FILTER (WHERE c.i IS NULL) AS text
  FROM rows r LEFT JOIN cut c ON r.doc_id = c.doc_id AND r.i = c.i GROUP BY r.doc_id)
SELECT doc_id, n AS n_lines_removed, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars_left, sha256(coalesce(text, '')) AS text_sha256 FROM kept
"""
