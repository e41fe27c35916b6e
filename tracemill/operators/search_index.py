"""The index of ranked text search: postings by token, in immutable segments.

A stored index is a folder of segments and numbered manifests. A segment has its postings
and its part of the dictionary sorted by token in ranges of about equal size, so a common
token fills many files and tasks, with a sparse table of each file's first and last token.
A refresh adds a segment of the new and changed documents, the ids of those that went, and
counts to add and subtract; nothing that is stored is written again until segments are
merged. What a query's tokens need is read from the files whose range holds them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import manifests
from tracemill.parallel import spread

#: Version of the stored form (an index of another version is built anew), segments before they are merged, and rows of a file.
VERSION, MOST_SEGMENTS, FILE_ROWS = 3, 8, 4_000_000
#: Rows of the sparse keys that a driver holds; larger tables of keys are asked by a job.
HELD_KEYS = 20_000
POSTINGS = ["field", "token", "doc", "tf", "dl", "first"]


def stem(token: Column) -> Column:
    """`ies` to `y`, or else the first of `ing`, `ed`, `s` goes, if three letters stay."""
    n = F.length(token)
    cut = lambda k: F.left(token, n - k)
    out = F.when(token.endswith("ies") & (n >= 6), F.concat(cut(3), F.lit("y")))
    for s in ("ing", "ed", "s"):
        out = out.when(token.endswith(s) & (n >= len(s) + 3), cut(len(s)))
    return out.otherwise(token)


def idf(docs: Column, n: Column) -> Column:
    return F.ln(docs - n + 0.5) - F.ln(n + 0.5)


@dataclass
class Index:
    """postings(field, token, doc, tf, dl, first), lengths(field, doc, dl), vocabulary(field, token, n, idf), fields(field, docs, avgdl, mean_idf).

    dl, the document's length, stands beside each posting, so that no query reads the
    lengths; first marks one posting of each document and field.
    """

    postings: DataFrame
    lengths: DataFrame
    vocabulary: DataFrame
    fields: DataFrame

    def write(self, path: str) -> Stored:
        """The index as one segment in a new folder."""
        return _stored(self.postings, path)

    def of(self, tokens: list[str]) -> tuple[DataFrame, DataFrame]:
        """Postings and vocabulary of some tokens."""
        keep = F.col("token").isin(*tokens) if tokens else F.lit(False)
        return self.postings.where(keep), self.vocabulary.where(keep)

    def completions(self, beginning: str, most: int) -> list[str]:
        """The first tokens with a beginning."""
        return [r.token for r in self.vocabulary.where(F.col("token").startswith(beginning)).select("token").distinct().orderBy("token").limit(most).collect()]

    def persist(self) -> Index:
        """Holds what queries read, for an index that is not stored; release() lets it go."""
        self.postings, self.vocabulary, self.fields = self.postings.persist(), self.vocabulary.persist(), self.fields.persist()
        return self

    def release(self) -> None:
        for df in (self.postings, self.vocabulary, self.fields):
            df.unpersist()

    def with_doc(self, kind: str) -> Index:
        """The same index with ids of another type."""
        cast = lambda df: df.withColumn("doc", F.col("doc").cast(kind))
        return Index(cast(self.postings), cast(self.lengths), self.vocabulary, self.fields)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Stored:
        """A stored index as it is now; one of another version is refused."""
        _, content = manifests.latest(spark, path)
        if content.get("version") != VERSION:
            raise ValueError(f"index of version {content.get('version')}, not {VERSION}; build it anew")
        return Stored.open(spark, path, content)


@dataclass
class Stored(Index):
    """An index in a folder, as of one manifest: its segments, oldest first, and their keys if they are few."""

    path: str = ""
    segments: list[dict] = field(default_factory=list)
    keys: list | None = None
    kind: str = ""

    @staticmethod
    def open(spark: SparkSession, path: str, content: dict, kind: str = "") -> Stored:
        segments = content["segments"]
        fields = _fields(spark, path, segments)
        out = Stored(None, None, None, fields, path, segments, None, kind)
        # The files are few beside their rows; where they are not, each query asks for its own.
        found = out._key_table(spark).limit(HELD_KEYS + 1).collect()
        out.keys = found if len(found) <= HELD_KEYS else None
        out.postings = out._live(spark, lambda s: spark.read.parquet(f"{path}/{s['name']}/postings"))
        out.lengths = out.postings.where("first").select("field", "doc", "dl")
        out.vocabulary = _vocabulary([spark.read.parquet(f"{path}/{s['name']}/dictionary") for s in segments], fields)
        return out

    def _key_table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(*[f"{self.path}/{s['name']}/keys" for s in self.segments])

    def _live(self, spark: SparkSession, rows_of) -> DataFrame:
        """Each segment's rows without the documents that later segments took away."""
        out = []
        for k, s in enumerate(self.segments):
            rows = rows_of(s)
            gone = [spark.read.parquet(f"{self.path}/{t['name']}/gone") for t in self.segments[k + 1 :] if t["gone"]]
            if gone:
                rows = rows.join(reduce(DataFrame.unionByName, gone).distinct(), "doc", "left_anti")
            out.append(rows.select(*POSTINGS))
        rows = reduce(DataFrame.unionByName, out)
        return rows.withColumn("doc", F.col("doc").cast(self.kind)) if self.kind else rows

    def with_doc(self, kind: str) -> Stored:
        return Stored(self.postings.withColumn("doc", F.col("doc").cast(kind)), self.lengths.withColumn("doc", F.col("doc").cast(kind)), self.vocabulary, self.fields, self.path, self.segments, self.keys, kind)

    def _files(self, table: str, ranges: list[tuple[str, str]]) -> dict[str, list[str]]:
        """By segment, the files of a table that can hold tokens of any of the ranges."""
        spark = self.fields.sparkSession
        if self.keys is None:
            hit = reduce(lambda a, b: a | b, [(F.col("low") <= b) & (F.col("high") >= a) for a, b in ranges], F.lit(False))
            rows = self._key_table(spark).where((F.col("part") == table) & hit).collect()
        else:
            rows = [r for r in self.keys if r.part == table and any(r.low.encode() <= b.encode() and r.high.encode() >= a.encode() for a, b in ranges)]
        out: dict[str, list[str]] = {}
        for r in rows:
            out.setdefault(r.segment, []).append(f"{self.path}/{r.segment}/{table}/{r.file}")
        return out

    def _some(self, table: str, ranges: list[tuple[str, str]]):
        """How to read what a segment's files hold for some ranges of tokens."""
        spark, files = self.fields.sparkSession, self._files(table, ranges)

        def read(segment: dict) -> DataFrame:
            found = files.get(segment["name"])
            return spark.read.parquet(*sorted(found)) if found else spark.read.parquet(f"{self.path}/{segment['name']}/{table}").limit(0)

        return read

    def of(self, tokens: list[str]) -> tuple[DataFrame, DataFrame]:
        spark, keep = self.fields.sparkSession, F.col("token").isin(*tokens) if tokens else F.lit(False)
        ranges = [(t, t) for t in tokens]
        read = self._some("postings", ranges)
        postings = self._live(spark, lambda s: read(s).where(keep))
        words = self._some("dictionary", ranges)
        return postings, _vocabulary([words(s).where(keep) for s in self.segments], self.fields)

    def completions(self, beginning: str, most: int) -> list[str]:
        words = self._some("dictionary", [(beginning, beginning + "\U0010ffff")])
        found = _vocabulary([words(s).where(F.col("token").startswith(beginning)) for s in self.segments], self.fields)
        return [r.token for r in found.select("token").distinct().orderBy("token").limit(most).collect()]


def _cut(docs: DataFrame, doc: str, fields: list[str], words) -> DataFrame:
    """field, doc, t: the words of each field of each document; an empty one counts as a token of its own."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), words(F.col(f)).alias("t")) for f in fields])).alias("e")
    return spread(docs.select(doc, *fields)).select(F.col(doc).alias("doc"), each).select("e.field", "doc", F.when(F.size("e.t") == 0, F.array(F.lit(""))).otherwise(F.col("e.t")).alias("t"))


def _postings(rows: DataFrame) -> DataFrame:
    """Words are stemmed after they are exploded, in generated code. The posting of a text's first word stands for the text."""
    words = rows.select("field", "doc", F.size("t").alias("dl"), F.posexplode("t").alias("at", "word"))
    return words.groupBy("field", stem(F.col("word")).alias("token"), "doc", "dl").agg(F.count("*").alias("tf"), (F.min("at") == 0).alias("first")).select(*POSTINGS)


def _vocabulary(parts: list[DataFrame], fields: DataFrame) -> DataFrame:
    """field, token, n, idf of dictionaries whose counts add up; fields has a row for each field."""
    rows = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy("field", "token").agg(F.sum("n").alias("n")).where("n > 0")
    return rows.join(F.broadcast(fields.select("field", "docs")), "field").select("field", "token", "n", idf(F.col("docs"), F.col("n")).alias("idf"))


def _statistics(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and fields. A field that is empty in all documents is left out."""
    some = postings.where("token <> ''").select("field").distinct()
    per_field = postings.where("first").groupBy("field").agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl")).join(F.broadcast(some), "field", "left_semi")  # a row for each field
    vocabulary = _vocabulary([postings.groupBy("field", "token").agg(F.count("*").alias("n"))], per_field)
    return vocabulary, per_field.join(vocabulary.groupBy("field").agg(F.avg("idf").alias("mean_idf")), "field")


def build(docs: DataFrame, doc: str, fields: list[str], words) -> Index:
    postings = _postings(_cut(docs, doc, fields, words))
    return Index(postings, postings.where("first").select("field", "doc", "dl"), *_statistics(postings))


# --- segments --------------------------------------------------------------------------------


def _ranges(rows: DataFrame, path: str, *order: str) -> DataFrame:
    """Rows by ranges of `order`, the token first: a token that fills several files is cut by what follows."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return rows.sparkSession.read.parquet(path)


def _write_keys(spark: SparkSession, path: str, name: str) -> None:
    """segment, part, file, low, high: the first and the last token of each file."""
    each = [spark.read.parquet(f"{path}/{name}/{part}").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("token").alias("low"), F.max("token").alias("high")).select(F.lit(name).alias("segment"), F.lit(part).alias("part"), "file", "low", "high") for part in ("postings", "dictionary")]
    each[0].unionByName(each[1]).coalesce(1).write.parquet(f"{path}/{name}/keys")


def _spread(dictionary: DataFrame, n: str, sign: int) -> DataFrame:
    """field, n, blank, tokens: how many tokens occur in n documents, which is all that the mean of their idf needs."""
    return dictionary.where(F.col(n) > 0).groupBy("field", F.col(n).alias("n"), (F.col("token") == "").alias("blank")).agg((F.count("*") * sign).alias("tokens"))


def _counts(postings: DataFrame, sign: int) -> DataFrame:
    return postings.where("first").groupBy("field").agg((F.count("*") * sign).alias("docs"), (F.sum("dl") * sign).alias("words"))


def _fields(spark: SparkSession, path: str, segments: list[dict]) -> DataFrame:
    """field, docs, avgdl, mean_idf from the segments' counts: a row for each field, held by the driver."""
    of = lambda what: spark.read.parquet(*[f"{path}/{s['name']}/{what}" for s in segments])
    docs = of("counts").groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).where("docs > 0")
    rows = of("spread").groupBy("field", "n", "blank").agg(F.sum("tokens").alias("tokens")).where("tokens > 0").join(docs, "field")
    per = rows.groupBy("field", "docs", "words").agg((F.sum(F.col("tokens") * idf(F.col("docs"), F.col("n"))) / F.sum("tokens")).alias("mean_idf"), F.bool_or(~F.col("blank")).alias("some"))
    found = per.where("some").select("field", "docs", (F.col("words") / F.col("docs")).alias("avgdl"), "mean_idf").collect()
    return spark.createDataFrame(found, "field string, docs long, avgdl double, mean_idf double")


def _name() -> str:
    return f"segment-{uuid.uuid4().hex}"


def _write_segment(postings: DataFrame, path: str, name: str) -> None:
    """A segment of its own postings alone."""
    at, spark = f"{path}/{name}", postings.sparkSession
    written = _ranges(postings.select(*POSTINGS), f"{at}/postings", "token", "doc")
    dictionary = _ranges(written.groupBy("field", "token").agg(F.count("*").alias("n")), f"{at}/dictionary", "token", "field")
    _counts(written, 1).coalesce(1).write.parquet(f"{at}/counts")
    _spread(dictionary, "n", 1).coalesce(1).write.parquet(f"{at}/spread")
    _write_keys(spark, path, name)


def _stored(postings: DataFrame, path: str) -> Stored:
    spark, name = postings.sparkSession, _name()
    _write_segment(postings, path, name)
    manifests.commit(spark, path, lambda _: {"version": VERSION, "segments": [{"name": name, "gone": False}]})
    return Index.read(spark, path)


def stored(docs: DataFrame, doc: str, fields: list[str], path: str, words) -> Stored:
    return _stored(_postings(_cut(docs, doc, fields, words)), path)


def refresh(index: Index, docs: DataFrame, diff: DataFrame, doc: str, fields: list[str], words, path: str | None = None) -> Index:
    gone = diff.where("kind in ('changed', 'removed')").select(F.col(doc).alias("doc")).distinct()
    come = docs.join(diff.where("kind in ('changed', 'new')").select(doc), doc, "left_semi")
    fresh = _postings(_cut(come, doc, fields, words))
    if path is not None or not isinstance(index, Stored):
        return _stored(index.postings.join(gone, "doc", "left_anti").select(*POSTINGS).unionByName(fresh), path)
    spark, name = docs.sparkSession, _name()
    at = f"{index.path}/{name}"
    gone.write.parquet(f"{at}/gone")
    gone = spark.read.parquet(f"{at}/gone")
    new = _ranges(fresh, f"{at}/postings", "token", "doc")
    # What went is found by its ids in one pass over the postings; only its counts are written.
    index.postings.join(gone, "doc", "left_semi").groupBy("field", "token").agg(F.count("*").alias("n"), F.count_if("first").alias("docs"), F.sum(F.when(F.col("first"), F.col("dl"))).alias("words")).write.parquet(f"{at}/lost")
    lost = spark.read.parquet(f"{at}/lost")
    delta = new.groupBy("field", "token").agg(F.count("*").alias("n")).unionByName(lost.select("field", "token", (-F.col("n")).alias("n")))
    delta = _ranges(delta.groupBy("field", "token").agg(F.sum("n").alias("n")).where("n <> 0"), f"{at}/dictionary", "token", "field")
    old = reduce(DataFrame.unionByName, [spark.read.parquet(f"{index.path}/{s['name']}/dictionary") for s in index.segments]).groupBy("field", "token").agg(F.sum("n").alias("old"))
    both = delta.join(old, ["field", "token"], "left").select("field", "token", F.coalesce("old", F.lit(0)).alias("old"), (F.coalesce("old", F.lit(0)) + F.col("n")).alias("now"))
    _spread(both, "old", -1).unionByName(_spread(both, "now", 1)).coalesce(1).write.parquet(f"{at}/spread")
    minus = lost.groupBy("field").agg((-F.sum("docs")).alias("docs"), (-F.coalesce(F.sum("words"), F.lit(0))).alias("words"))
    _counts(new, 1).unionByName(minus).coalesce(1).write.parquet(f"{at}/counts")
    _write_keys(spark, index.path, name)
    known = [s["name"] for s in index.segments]

    def add(content: dict) -> dict:
        if [s["name"] for s in content["segments"]] != known:
            raise RuntimeError(f"{index.path} was refreshed meanwhile")
        return content | {"segments": [*content["segments"], {"name": name, "gone": True}]}

    manifests.commit(spark, index.path, add)
    out = Index.read(spark, index.path)
    return merged(out) if len(out.segments) > MOST_SEGMENTS else out


def merged(index: Stored) -> Stored:
    """The index with all its segments as one, without what went; the texts are not cut again. Older segments stay until vacuum()."""
    spark, name, known = index.fields.sparkSession, _name(), [s["name"] for s in index.segments]
    _write_segment(index.postings, index.path, name)

    def put(content: dict) -> dict:
        # Segments that came meanwhile stay as they are: what they take away, and subtract, holds for the merged one as well.
        now = [s["name"] for s in content["segments"]]
        if now[: len(known)] != known:
            raise RuntimeError(f"{index.path} was merged meanwhile")
        return content | {"segments": [{"name": name, "gone": False}, *content["segments"][len(known) :]]}

    manifests.commit(spark, index.path, put)
    return Index.read(spark, index.path)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes segments that the newest manifest doesn't name; not while an older state is read or written."""
    named = {s["name"] for s in manifests.latest(spark, path)[1]["segments"]}
    _, fs, place = manifests._fs(spark, path)
    gone = [s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith("segment-") and s.getPath().getName() not in named]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
