"""Exact top-k search by inner product through a pivot-distance index.

Every vector is keyed by its nearest pivot and by the ring in which its distance to that
pivot lies. Pivots and ring bounds are fitted on a bounded sample; every row is indexed,
and exact statistics of each ring (counts, distances, lengths) come from all rows. With

    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2   and   |q - x| >= | |q - p| - |x - p| |

a ring's statistics bound the score of all its vectors from above; q.p + |q| |x - p| bounds
it too. Each query visits its rings in the order of their bounds: first the best few, which
give a k-th best score, then those whose bound still reaches that score. There are at most
pivots * rings rings, whatever the corpus holds, so their statistics can be shared with all
tasks; a crowded ring is dealt over blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.llm.common import checkpointed


def quantised(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of long): floor(scale * x) of each component x as double.

    Rows without an id, without a vector, with an empty one, or with a null or non-finite
    component are left out.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x")).where("vec_id is not null and size(x) > 0")
    rows = rows.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def fit_pivots(sample: list[list[int]], pivots: int, rings: int, rounds: int = 6):
    """Pivots of each dimension by a few k-means steps from evenly chosen rows, and of each pivot the ring bounds by quantiles.

    Pivots are any vectors; a bad choice costs time and never results.
    """
    import numpy as np

    out = {}
    by: dict[int, list[list[int]]] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    for dim, rows in sorted(by.items()):
        x = np.unique(np.array(rows, dtype=float), axis=0)
        k = max(1, min(pivots, len(x) // 8))
        p = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(rounds):
            near = nearest(x, p)[0]
            p = np.array([x[near == i].mean(axis=0) if (near == i).any() else p[i] for i in range(k)])
        near, dist = nearest(x, p)
        cuts = [np.unique(np.quantile(dist[near == i], np.linspace(0, 1, rings + 1)[1:-1])) if (near == i).any() else np.array([]) for i in range(k)]
        out[dim] = (p, cuts)
    return out


def nearest(x, p):
    """Nearest row of p for each row of x, and the distance."""
    import numpy as np

    d = np.square(x).sum(1)[:, None] - 2 * x @ p.T + np.square(p).sum(1)[None, :]
    i = d.argmin(axis=1)
    return i, np.sqrt(np.square(x - p[i]).sum(axis=1))


def products(q, x):
    """Integer inner products of all rows of q with all rows of x, exact; what a long can't hold becomes the nearest that it can."""
    import numpy as np

    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    if most < 2**62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def top_pairs(scores, ids, k: int, own):
    """Of each row of scores the columns with the k highest, ties to smaller ids; own[i] is left out of row i."""
    import numpy as np

    out = []
    for row, me in zip(scores, own):
        keep = np.flatnonzero(ids != me)
        s = row[keep]
        if len(keep) > k:
            bound = np.partition(s, len(s) - k)[len(s) - k]
            keep, s = keep[s >= bound], s[s >= bound]
        order = np.lexsort((ids[keep], -s))[:k]
        out.append((ids[keep[order]], s[order]))
    return out


def _index(rows: DataFrame, model) -> DataFrame:
    """vec_id, v, dim, pivot, ring, dist, norm2 of every row. A dimension that the sample lacks has the origin as its pivot."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                n, flat = b.num_rows, b.column("v").flatten().to_numpy()
                dims = np.asarray(b.column("v").value_lengths(), dtype=np.int64)
                starts = np.cumsum(dims) - dims
                pivot, ring, dist, norm = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
                for d in np.unique(dims):
                    rows_ = np.flatnonzero(dims == d)
                    x = flat[starts[rows_][:, None] + np.arange(d)].astype(float)
                    p, cuts = shared.value.get(int(d), (np.zeros((1, d)), [np.array([])]))
                    near, far = nearest(x, p)
                    pivot[rows_], dist[rows_], norm[rows_] = near, far, np.square(x).sum(axis=1)
                    ring[rows_] = [int(np.searchsorted(cuts[i], f, side="left")) for i, f in zip(near, far)]
                cols = [b.column("vec_id"), b.column("v"), *map(pa.array, (dims.astype(np.int32), pivot, ring, dist, norm))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "dim", "pivot", "ring", "dist", "norm2"])

    return rows.mapInArrow(run, "vec_id long, v array<long>, dim int, pivot int, ring int, dist double, norm2 double")


def bounds(q, dim: int, rings, model):
    """Upper bounds of the scores of each ring's vectors for one query, with a margin for rounding.

    rings: pivot, lowest and highest distance, highest squared length, as arrays.
    """
    import numpy as np

    pivot, low, high, norm2 = rings
    p = model[dim][0] if dim in model else np.zeros((1, dim))
    qq = float(q @ q)
    d = np.sqrt(np.square(p - q).sum(axis=1))[pivot]
    gap = np.maximum(0.0, np.maximum(low - d, d - high))
    by_triangle = (qq + norm2 - gap * gap) / 2
    by_length = (p @ q)[pivot] + np.sqrt(qq) * high
    best = np.minimum(by_triangle, by_length)
    return best + 1e-6 * (np.abs(best) + qq + norm2) + 1e-3


def _visits(queries: DataFrame, stats, model, first: int, second: bool) -> DataFrame:
    """query_id, q, dim, pivot, ring: the rings that each query visits.

    First round: the `first` rings of highest bound. Second round: the other rings whose
    bound reaches the query's threshold (queries.least; null where fewer than k are found).
    """
    shared = queries.sparkSession.sparkContext.broadcast((stats, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        stats, model = shared.value
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            least = b.column("least").to_pylist()
            for qid, v, t in zip(b.column("query_id").to_pylist(), b.column("q").to_pylist(), least):
                dim = len(v)
                if dim not in stats:
                    continue
                pivot, ring, low, high, norm2 = stats[dim]
                up = bounds(np.array(v, dtype=float), dim, (pivot, low, high, norm2), model)
                order = np.lexsort((np.arange(len(up)), -up))
                go = order[:first] if not second else order[first:][up[order[first:]] >= (t if t is not None else -np.inf)]
                for i in go.tolist():
                    for col, x in zip(out, (qid, v, dim, int(pivot[i]), int(ring[i]))):
                        col.append(x)
            types = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["query_id", "q", "dim", "pivot", "ring"])

    return queries.mapInArrow(run, "query_id long, q array<long>, dim int, pivot int, ring int")


def _search(visits: DataFrame, index: DataFrame, rows: dict[tuple[int, int, int], int], k: int, block: int) -> DataFrame:
    """query_id, vec_id, score: of each block visited its k best for each query that visits it.

    rows has the number of vectors of each ring. A ring's vectors are dealt over blocks and
    its visitors over parts, both of bounded size; each part meets each block.
    """
    import pandas as pd

    cells = ["dim", "pivot", "ring"]
    visits = checkpointed(visits)
    seen = visits.groupBy(*cells).count().collect()  # a row for each ring at most
    spark = visits.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(r.dim, r.pivot, r.ring, -(-rows[r.dim, r.pivot, r.ring] // block), -(-r["count"] // block)) for r in seen], "dim int, pivot int, ring int, blocks int, parts int"))
    part = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part")
    asked = visits.join(sizes, cells).select(*cells, "query_id", "q", part, F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    own = F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int").alias("block")
    blocks = index.join(sizes, cells).select(*cells, "vec_id", "v", own, F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        out: list[list] = [[], [], []]
        if len(left) and len(right):
            x, ids = np.stack(right["v"].to_list()).astype(np.int64), right["vec_id"].to_numpy()
            for at in range(0, len(left), 256):
                own = left["query_id"].to_numpy()[at : at + 256]
                s = products(np.stack(left["q"].to_list()[at : at + 256]).astype(np.int64), x)
                for qid, (i, v) in zip(own, top_pairs(s, ids, k, own)):
                    out[0] += [qid] * len(i)
                    out[1] += i.tolist()
                    out[2] += v.tolist()
        return pd.DataFrame({"query_id": np.array(out[0], dtype="int64"), "vec_id": np.array(out[1], dtype="int64"), "score": np.array(out[2], dtype="int64")})

    keys = [*cells, "block", "part"]
    return asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int = 32, rings: int = 8, sample: int = 4096, first: int = 4, block: int = 4096, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` its k best among all other rows.

    Exact: a ring is passed over only if its bound is below the query's k-th best score.
    Ties go to the smaller id; fewer candidates than k give fewer rows. Rows that share a
    query's id are not candidates of it; a query id that occurs in several rows counts once,
    with the smallest of its vectors; other repeated rows are candidates each by itself.
    Vectors are compared with those of the same length only. Which rows take no part is
    stated at quantised(). Other columns play no part; an empty table gives an empty result.
    sample bounds the rows that pivots are fitted on, pivots * rings (for each vector
    length in the sample) the statistics that are shared with all tasks.
    """
    import numpy as np

    rows = quantised(vectors, scale, id_col, vector_col)
    fitted = [r.v for r in rows.orderBy(F.xxhash64(F.lit(2), "vec_id"), "vec_id").limit(sample).select("v").collect()]
    model = fit_pivots(fitted, pivots, rings)
    index = checkpointed(_index(rows, model))
    cells = ["dim", "pivot", "ring"]
    per = index.groupBy(*cells).agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm2").alias("norm2"), F.count("*").alias("n")).orderBy(*cells).collect()
    stats = {d: tuple(np.array(c) for c in zip(*[(r.pivot, r.ring, r.low, r.high, r.norm2) for r in per if r.dim == d])) for d in {r.dim for r in per}}
    rows_of = {(r.dim, r.pivot, r.ring): r.n for r in per}

    queries = index.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    queries = checkpointed(queries.withColumn("least", F.lit(None).cast("double")))
    one = checkpointed(_search(_visits(queries, stats, model, first, False), index, rows_of, k, block))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
    two = _search(_visits(queries.drop("least").join(kth, "query_id", "left"), stats, model, first, True), index, rows_of, k, block)
    return one.unionByName(two).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
