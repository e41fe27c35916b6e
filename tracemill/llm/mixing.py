"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Golden-ratio points are mapped through the sources' cumulative targets, so that any
stretch of the schedule holds each source in its share. Slots are ranked per source, and
the r-th slot of a source takes the r-th block of its shuffled word stream; a stream that
is used up starts again. Sources of many blocks share one schedule. What discrepancy and
rounding do to a source grows with the block over the target, so sources with smaller
targets have smaller blocks, and those with equal blocks share a schedule of their own: a
golden-ratio lattice, which gives each source the very number of slots that its target asks.
All that grows with the corpus or with the number of sources is a Spark table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.llm.common import checkpointed, free_prefix

#: 2**32 over the golden ratio; i * GOLDEN mod 2**32 visits every 32-bit point once.
GOLDEN, TURN = 2654435769, 1 << 32
WEIGHTS = (5, 2, 1)
#: A source shares the schedule of whole blocks if its target is at least this many times the block's square.
LARGE = 4


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source, for a short list of sources; targets_of() does the same for a table.

    Sources in code point order, null last, have the weights in turn and share `share`
    times all words by weight. A source stops at `most` times its own words; what is over
    is shared again by weight among the others until none is above.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    cap = {s: most * n for s, n in ordered}
    target, open_, left = {}, [s for s, _ in ordered], share * sum(n for _, n in ordered)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, spot: spot is the document's place in the shuffle; copies with the same id and text share it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaces = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    id_ = F.col(id_col).cast("long")
    return docs.select(id_.alias("doc_id"), F.col(source_col).cast("string").alias("source"), spaces.alias("size"), F.xxhash64(F.lit(8), id_, F.xxhash64(text)).alias("spot"))


def _ordered(sums: DataFrame) -> DataFrame:
    """sid, source, n of each source, numbered from 0 by code point with null last; part is a range of sources that a task can hold."""
    per = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last())
    per = checkpointed(per.withColumn("at", F.monotonically_increasing_id()))
    per = per.select("source", "n", F.shiftright("at", 33).alias("part"), F.expr("at & 8589934591").alias("at"))
    sizes = per.groupBy("part").agg(F.count("*").alias("k"))
    before = sizes.select("part", (F.sum("k").over(W.orderBy("part")) - F.col("k")).alias("before"))  # a row for each range
    return per.join(before, "part").select((F.col("before") + F.col("at")).alias("sid"), "source", "n", "part")


def targets_of(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """sources (sid, n) with target (double), by the rule of source_targets().

    A round adds up, over the table, what is left for the sources below their caps; sums are
    of whole numbers, so reruns agree to the last bit. The level rises until no source is above.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights)).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", most * F.col("n"))
    level: tuple[float, float] | None = None
    while True:
        over = F.lit(False) if level is None else F.lit(level[0]) * F.col("weight") / level[1] > F.col("cap")
        r = rows.agg(F.sum("n"), F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        now = (share * (r[0] or 0) - (r[1] or 0), r[2] or 0.0)
        if not now[1] or (level is not None and now == level):
            break
        level = now
    open_ = F.lit(level[0]) * F.col("weight") / level[1] if level else F.lit(0.0)
    return rows.withColumn("target", F.least(open_, F.col("cap").cast("double"))).drop("weight", "cap")


def _prefix(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds `<value>_before`: the sum over the sources before, by ranges of sources first, so that no task has to hold all."""
    sums = rows.groupBy(*by, "part").agg(F.sum(value).alias("k"))
    first = W.partitionBy(*by).orderBy("part")
    sums = sums.select(*by, "part", (F.sum("k").over(first) - F.col("k")).alias("k"))
    inside = F.sum(value).over(W.partitionBy(*by, "part").orderBy("sid").rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    return rows.withColumn("inside", inside).join(sums, [*by, "part"]).withColumn(f"{value}_before", F.col("k") + F.col("inside")).drop("k", "inside")


def schedule(large: DataFrame, block: int, run: int = 1 << 16) -> DataFrame:
    """slot, sid, rank (from 0): which source each slot holds and how many slots of it stand before.

    large has sid, part and target in words. A slot's golden-ratio point finds its source
    through cells of the unit interval, each of which knows the sources that it meets.
    Ranks are counted in runs of slots first, so that the largest source's slots are not
    numbered by one task.
    """
    spark = large.sparkSession
    n, total, last = large.agg(F.count("*"), F.sum("target"), F.max("sid")).first()
    slots, cells = round((total or 0.0) / block), 1 << max(4, (4 * n).bit_length())
    ends = _prefix(large, "target").withColumn("lo", F.col("target_before") / (total or 1.0))
    ends = ends.withColumn("hi", F.when(F.col("sid") == last, 1.0).otherwise((F.col("target_before") + F.col("target")) / (total or 1.0)))
    meets = ends.select("sid", "lo", "hi", F.explode(F.expr(f"sequence(cast(floor(lo * {cells}) as int), cast(floor(hi * {cells}) as int))")).alias("cell"))
    point = (F.col("slot") % TURN) * GOLDEN % TURN / float(TURN)
    s = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * cells).cast("int"))
    s = s.join(meets, [s["cell"] == meets["cell"], F.col("point") >= F.col("lo"), F.col("point") < F.col("hi")]).select("slot", "sid", F.floor(F.col("slot") / run).alias("run"))
    sums = s.groupBy("sid", "run").agg(F.count("*").alias("n"))
    before = sums.select("sid", "run", (F.sum("n").over(W.partitionBy("sid").orderBy("run")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("sid", "run").orderBy("slot")) - 1
    return s.withColumn("inside", inside).join(before, ["sid", "run"]).select("slot", "sid", (F.col("before") + F.col("inside")).alias("rank"))


def lattice(small: DataFrame) -> DataFrame:
    """level, slot, sid, rank as in schedule(), for sources (sid, part, level, slots) that get the very number of slots named.

    The N slots of a level are visited in steps of N over the golden ratio, which meets
    every one of the N places once; a source owns as many neighbouring places as it has slots.
    """
    spark = small.sparkSession
    counts = small.groupBy("level").agg(F.sum("slots").alias("n")).where("n > 0").collect()  # a row for each power of two below the block
    steps = []
    for r in counts:
        step = max(1, round(r.n * (math.sqrt(5) - 1) / 2))
        while math.gcd(step, r.n) > 1:
            step += 1
        steps.append((r.level, r.n, pow(step, -1, r.n) if r.n > 1 else 0))
    steps_ = F.broadcast(spark.createDataFrame(steps, "level int, many long, back long"))
    places = _prefix(small.where("slots > 0"), "slots", "level").join(steps_, "level")
    places = places.select("level", "sid", "many", "back", F.explode(F.expr("sequence(slots_before, slots_before + slots - 1)")).alias("place"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    slot = ((wide("place") * wide("back")) % wide("many")).cast("long").alias("slot")
    return places.select("level", "sid", slot).withColumn("rank", (F.row_number().over(W.partitionBy("sid").orderBy("slot")) - 1).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block: int = 128, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, spot, size, source_size, target, taken: a row per row of docs.

    size counts words (null and empty texts: 0), taken the words that the mix takes of the
    document, repeats counted, at most `most` times its size. A source without words has
    target 0. A source whose target is under LARGE * block ** 2 takes it to within half of
    its own block, which is at most the 64th part of the target, or to the word; a larger one
    to within what the schedule's discrepancy and its last, short block leave: some blocks.
    The shuffle depends on id and text alone, so reruns agree; repeated rows are taken each
    by itself, and those equal in id and text stand side by side. Null ids and a null source
    are values like any other. Other columns play no part. An empty table gives an empty result.
    """
    sized = checkpointed(_sized(docs, id_col, text_col, source_col))
    # Prefix sums in two levels, so that no source has to fit in one task.
    buckets = max(16, sized.count() // 20_000)
    rows = sized.withColumn("bucket", F.pmod(F.shiftrightunsigned(F.col("spot"), 33), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    info = checkpointed(targets_of(_ordered(sums), weights, share, most))
    large = F.col("target") >= LARGE * block * block
    level = F.when(large, F.lit(block)).otherwise(F.greatest(F.lit(1), F.least(F.lit(block), F.pow(F.lit(2.0), F.floor(F.log2(F.sqrt("target") / 8))).cast("int"))))
    info = info.withColumn("large", large).withColumn("level", F.when(F.col("target") > 0, level).otherwise(F.lit(1)))
    info = info.withColumn("blocks", F.ceil(F.col("n") / F.col("level")))
    rounds, rest = F.floor(F.col("target") / F.col("n")), F.expr("target - floor(target / n) * n")
    info = checkpointed(info.withColumn("slots", F.when(F.col("large") | (F.col("n") == 0), 0).otherwise(rounds * F.col("blocks") + F.floor(rest / F.col("level") + 0.5)).cast("long")))

    known = info.select(F.col("source").alias("s"), "sid", F.col("n").alias("source_size"), "target", "level")
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n")
    before = before.join(known, F.expr("source <=> s")).drop("source").withColumnRenamed("bucket", "k")
    inside = W.partitionBy("source", "bucket").orderBy("spot", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside)).join(before, F.expr("source <=> s and bucket = k"))
    rows = rows.withColumn("stop", F.col("before") + F.col("inside")).drop("s", "k", "before", "inside", "bucket")

    # A source's last block is short if its words are no multiple of the block; slots past
    # `most` rounds, which rounding may give, take nothing.
    slots = schedule(info.where("large"), block).select("sid", "rank").unionByName(lattice(info.where("not large")).select("sid", "rank"))
    times = slots.join(info.select("sid", "blocks"), "sid").where("blocks > 0")
    times = times.where(F.col("rank") < most * F.col("blocks")).groupBy("sid", (F.col("rank") % F.col("blocks")).alias("nth")).agg(F.count("*").alias("times"))
    pieces = rows.where("size > 0").select("sid", "level", "stop", "size", F.explode(F.expr("sequence(cast(floor((stop - size) / level) as bigint), cast(floor((stop - 1) / level) as bigint))")).alias("nth"))
    overlap = F.least(F.col("stop"), (F.col("nth") + 1) * F.col("level")) - F.greatest(F.col("stop") - F.col("size"), F.col("nth") * F.col("level"))
    taken = pieces.join(times, ["sid", "nth"]).groupBy("sid", "stop").agg(F.sum(F.col("times") * overlap).alias("taken"))
    # Rows without words share their stop with another row; they take nothing.
    full = rows.join(taken, ["sid", "stop"], "left").withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return full.select("doc_id", "source", "spot", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block: int = 128, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs in the mix, each as often as its taken words make up its size, to the nearest whole number.

    A document is cut by the mix only where a source's last block ends; there the rounding
    decides. Documents without words (null, empty and blank texts) are not in the mix. Null
    ids and a null source are values like any other; of rows equal in id, source and text each
    is repeated as often as the one of which the mix takes most. An empty table gives an empty
    result. Columns are those of docs, whatever their names.
    """
    m = mix(docs, block=block, id_col=id_col, text_col=text_col, source_col=source_col)
    times = m.where("size > 0").groupBy("doc_id", "source", "spot").agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias("times")).where("times > 0")
    p = free_prefix(docs)
    times = times.select(F.col("doc_id").alias(f"{p}id"), F.col("source").alias(f"{p}source"), F.col("spot").alias(f"{p}spot"), F.col("times").alias(f"{p}times"))
    spot = F.xxhash64(F.lit(8), F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.withColumn(f"{p}key", spot).join(times, F.expr(f"{p}key = {p}spot and `{id_col}` <=> {p}id and `{source_col}` <=> {p}source"))
    return rows.withColumn(f"{p}copy", F.explode(F.expr(f"sequence(1, {p}times)"))).select(*[F.col(f"`{c}`") for c in docs.columns])
