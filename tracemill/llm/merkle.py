"""A Merkle tree over a dataset as supersteps on RDDs, with a membership proof checked for every row.

Leaves stand in order of their id below a subroot for each source, and the subroots in order
of the source below the root. A vertex of the graph is a block of 729 neighbouring nodes, so
that six levels of a tree need one exchange of messages. Upward, a block that has all of its
nodes hashes them and sends one digest to its parent block; downward, a block sends each
child block the siblings on that child's path. Leaves check their copies with what arrives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import CRC_TABLE_SQL, checkpointed, crc_sql

#: Nodes that make one of the next level, levels in a block, and nodes in a block.
FAN, DEPTH = 3, 6
BLOCK = FAN**DEPTH
#: Tree of the subroots; the trees of sources count from 0.
TOP = -1
#: Columns whose values a leaf's digest covers.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: What checked() returns.
SCHEMA = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def encoded(value: Column) -> Column:
    """A value so that it can't be mistaken for its neighbours: its length in bytes, a colon and itself; a dash for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Iterable[Column]) -> Column:
    """32 bytes: the digest of some values in their order."""
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in columns]).cast("binary"), 256))


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def folded(nodes: list[str], alone: bool) -> list[list[str]]:
    """The levels above some nodes of a block, the nodes first. A block that is alone in its tree ends at one node, another one after DEPTH levels."""
    levels = [nodes]
    while len(levels) <= DEPTH and not (alone and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([digest(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[int, list[str]]]:
    """Place in its run and the run's others, level by level, of a node at the bottom of a block."""
    out = []
    for level in levels[:-1]:
        first = at - at % FAN
        run = level[first : first + FAN]
        out.append((at - first, run[: at - first] + run[at - first + 1 :]))
        at //= FAN
    return out


def climbed(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a node and the siblings on its path give."""
    for place, others in path:
        node = digest([*others[:place], node, *others[place:]])
    return node


def _hexes(packed: bytes) -> list[str]:
    return [packed[k : k + 32].hex() for k in range(0, len(packed), 32)]


class Block:
    """Nodes in their order: how many their level has in all, the place of the first, and their digests.

    A block of leaves holds ids and the digests of the copies that differ; one of subroots the
    height of each source's own topmost block.
    """

    __slots__ = ("first", "n", "notes", "packed")

    def __init__(self, n: int, first: int, packed: bytes, notes: list):
        self.n, self.first, self.packed, self.notes = n, first, packed, notes

    def __reduce__(self):
        return Block, (self.n, self.first, self.packed, self.notes)

    @property
    def alone(self) -> bool:
        return self.n <= BLOCK

    def levels(self) -> list[list[str]]:
        return folded(_hexes(self.packed), self.alone)


def _joined(parts: Iterable[Block]) -> Block:
    """A block of its parts, which lie in several partitions or come from several children. At most BLOCK nodes."""
    parts = sorted(parts, key=lambda b: b.first)
    return Block(parts[0].n, parts[0].first, b"".join(b.packed for b in parts), [x for b in parts for x in b.notes])


def numbered(leaves: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int]], int, int]:
    """Leaves in tree order, where each partition of them begins, the number of sources, and of the largest's leaves.

    leaves has g (source), i (id), leaf, copy. A row with its number of leaves stands before
    each source's own, so that one sort gives every leaf its tree, place and the tree's size.
    The driver gets one row for each partition, as a sort's bounds do.
    """
    rows = leaves.withColumn("salt", F.monotonically_increasing_id())
    counts = rows.groupBy("g").agg(F.count("*").alias("n"))
    none = lambda kind: F.lit(None).cast(kind)
    heads = counts.select("g", F.lit(0).alias("kind"), "n", none("long").alias("i"), none("binary").alias("leaf"), none("binary").alias("copy"), F.lit(0).cast("long").alias("salt"))
    both = heads.unionByName(rows.select("g", F.lit(1).alias("kind"), none("long").alias("n"), "i", "leaf", "copy", "salt"))
    order = [F.col("g").asc_nulls_first(), F.col("kind"), F.col("i").asc_nulls_last(), F.col("leaf"), F.col("salt")]
    rows = checkpointed(both.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt"))
    spot = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    seen = rows.select(F.spark_partition_id().alias("p"), "kind", "n", spot.alias("spot"))
    head = F.when(F.col("kind") == 0, F.struct("spot", "n"))
    found = {r.p: r for r in seen.groupBy("p").agg(F.count("*").alias("rows"), F.count(head).alias("heads"), F.max(head).alias("last"), F.max("n").alias("most")).collect()}
    starts, tree, at, n, most = [], -1, 0, 0, 0
    for p in range(rows.rdd.getNumPartitions()):
        starts.append((tree, at, n))
        if r := found.get(p):
            tree, most = tree + r.heads, max(most, r.most or 0)
            at, n = (r.rows - 1 - r["last"].spot, r["last"].n) if r.heads else (at + r.rows, n)
    return rows, starts, tree + 1, most


def _cut(starts: list[tuple[int, int, int]]):
    """Turns a sorted partition into parts of blocks, keyed by tree and place."""

    def run(p: int, rows: Iterator) -> Iterator[tuple[tuple[int, int], Block]]:
        tree, at, n = starts[p]
        first, packed, notes = at, bytearray(), []
        for kind, size, i, node, copy in rows:
            if kind == 0 or at % BLOCK == 0:
                if packed:
                    yield (tree, first // BLOCK), Block(n, first, bytes(packed), notes)
                packed, notes = bytearray(), []
                if kind == 0:
                    tree, at, n = tree + 1, 0, size
                first = at
                if kind == 0:
                    continue
            packed += node
            notes.append((i, copy and bytes(copy)))
            at += 1
        if packed:
            yield (tree, first // BLOCK), Block(n, first, bytes(packed), notes)

    return run


def _up(level: int, goal: int):
    """The message of a block that has all its nodes: its digest, for its parent block, or, of a tree's only block, for the tree `goal`."""

    def run(item: tuple[tuple[int, int], Block]) -> tuple[tuple[int, int], Block]:
        (tree, b), block = item
        top = bytes.fromhex(block.levels()[-1][0])
        if block.alone:
            return (goal, tree // BLOCK), Block(-1, tree, top, [level])
        return (tree, b // BLOCK), Block(-(-block.n // BLOCK), b, top, [])

    return run


def _down(item: tuple[tuple[int, int], tuple[Block, tuple]]) -> Iterator[tuple[int, tuple[int, int], tuple]]:
    """Level, key and path for each child block. What a subroot's path holds beside the siblings is the subroot itself."""
    (tree, _), (block, (subroot, path)) = item
    levels = block.levels()
    for k, node in enumerate(levels[0]):
        own = siblings(levels, k) + path
        if tree == TOP and block.notes:
            yield block.notes[k], (block.first + k, 0), (node, own)
        else:
            yield -1, (tree, block.first + k), (subroot, own)


def _check(item: tuple[tuple[int, int], tuple[Block, tuple]]) -> Iterator[tuple]:
    """A row for each leaf of a block: id, leaf, subroot, digest of the siblings, and the root that its copy gives."""
    _, (block, (subroot, path)) = item
    levels = block.levels()
    for k, (node, (i, copy)) in enumerate(zip(levels[0], block.notes, strict=True)):
        own = siblings(levels, k) + path
        yield i, node, subroot, digest(x for _, others in own for x in others), climbed(copy.hex() if copy else node, own)


def _gathered(messages: RDD, parts: int) -> RDD:
    return messages.groupByKey(parts).mapValues(_joined)


def _with(blocks: RDD, paths: RDD, parts: int) -> RDD:
    return blocks.join(paths, parts)


def checked(docs: DataFrame, changed: dict[str, Column] | None = None, columns: Iterable[str] = COLUMNS, group: str = "source", id_col: str = "doc_id") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row's place in the tree, and whether its copy proves to be the row.

    changed gives, by column, the value of the copy that is checked; what it leaves out is the
    row's own. Leaves of a source stand by id (null last; equal ids by their digests), sources
    bytewise with null first; a source's only leaf is its subroot and the only subroot the
    root. Every null counts as a value of its own, apart from an empty text. Rows equal in all
    columns are leaves of their own with one digest. An empty table gives no rows. Columns
    that are not listed take no part, whatever their names.

    A text is read once and leaves 32 bytes (64 where its copy differs); what is sorted and
    sent are these. A block holds at most 729 nodes, so a source that holds a third of all
    rows is spread like any other. The two tables behind the supersteps are checkpoints, and
    a lost executor costs the exchanges since.
    """
    columns, spark = list(columns), docs.sparkSession
    own = leaf(F.col(f"`{c}`") for c in columns)
    copy = leaf((changed or {}).get(c, F.col(f"`{c}`")) for c in columns) if changed else F.lit(None).cast("binary")
    rows = docs.select(F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{id_col}`").cast("long").alias("i"), own.alias("leaf"), copy.alias("copy"))
    leaves = checkpointed(rows.select("g", "i", "leaf", F.when(F.col("copy") != F.col("leaf"), F.col("copy")).alias("copy")))
    ordered, starts, n_trees, most = numbered(leaves)
    if not n_trees:
        return spark.createDataFrame([], SCHEMA).select("doc_id", "leaf", "subroot", F.lit("").alias("root"), "proof_sha256", "folded_root", F.lit(True).alias("verified"))

    parts = len(starts)
    width = lambda level: max(1, parts // BLOCK**level)
    cut = ordered.select("kind", "n", "i", "leaf", "copy").rdd.mapPartitionsWithIndex(_cut(starts), preservesPartitioning=False)
    # Upward, the trees of sources; `done` has the subroots.
    blocks, done = [_gathered(cut, width(0))], []
    while True:
        level = len(blocks) - 1
        sent = blocks[-1].map(_up(level, TOP))
        done.append(sent.filter(lambda m: m[0][0] == TOP))
        if most <= BLOCK:
            break
        most = -(-most // BLOCK)
        blocks.append(_gathered(sent.filter(lambda m: m[0][0] != TOP), width(level + 1)))
    # Upward, the tree of subroots.
    sized = lambda n: lambda m: (m[0], Block(n, m[1].first, m[1].packed, m[1].notes))
    top = [_gathered(spark.sparkContext.union(done).map(sized(n_trees)), width(1))]
    left = n_trees
    while left > BLOCK:
        left = -(-left // BLOCK)
        top.append(_gathered(top[-1].map(_up(0, TOP)), width(len(top) + 1)))
    root = top[-1].map(lambda x: x[1].levels()[-1][0]).first()
    # Downward, first the tree of subroots, whose lowest blocks send to the topmost block of each source.
    paths = top[-1].mapValues(lambda _: ("", []))
    for k in reversed(range(len(top))):
        told = _with(top[k], paths, width(k + 1)).flatMap(_down)
        paths = told.map(lambda m: m[1:])
    subroots = told
    paths = None
    for level in reversed(range(len(blocks))):
        mine = subroots.filter(lambda m, level=level: m[0] == level).map(lambda m: m[1:])
        paths = mine if paths is None else paths.union(mine)
        both = _with(blocks[level], paths, width(level))
        paths = both.flatMap(_down).map(lambda m: m[1:])
    out = spark.createDataFrame(both.flatMap(_check), SCHEMA, verifySchema=False)
    return out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def without_newlines(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """The copy to be checked: of the rows whose id has an even crc32, the text without its newlines."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return {text_col: F.when(even, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))}


def _encoded_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR) END"


ORACLE_SQL = f"""
WITH RECURSIVE ct AS (SELECT {CRC_TABLE_SQL} AS tb),
d AS (SELECT doc_id, source, text, CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)", "tb")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other, lang, n_chars FROM documents, ct),
lf AS (SELECT doc_id, source, sha256({" || ".join(_encoded_sql(c) for c in COLUMNS)}) AS leaf,
  sha256({" || ".join(_encoded_sql("other" if c == "text" else c) for c in COLUMNS)}) AS other FROM d),
pl AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM lf),
up AS (SELECT t, 0 AS lv, i, leaf AS h FROM pl
  UNION ALL SELECT t, lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY t) AS c FROM up) WHERE c > 1 GROUP BY t, lv, i // 3),
sr AS (SELECT t, arg_max(h, lv) AS subroot, max(lv) AS lv FROM up GROUP BY t),
tp AS (SELECT 0 AS lv, t AS i, subroot AS h FROM sr
  UNION ALL SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM tp) WHERE c > 1 GROUP BY lv, i // 3),
ru AS (SELECT t, lv, i // 3 AS p, list(h ORDER BY i) AS hs FROM up GROUP BY 1, 2, 3),
rt AS (SELECT lv, i // 3 AS p, list(h ORDER BY i) AS hs FROM tp GROUP BY 1, 2),
w1 AS (SELECT doc_id, t, 0 AS lv, i, coalesce(other, leaf) AS h, '' AS pr FROM pl
  UNION ALL SELECT doc_id, w1.t, w1.lv + 1, i // 3, sha256(array_to_string(list_concat(hs[1:i % 3], [h], hs[i % 3 + 2:]), '')), pr || array_to_string(list_concat(hs[1:i % 3], hs[i % 3 + 2:]), '')
  FROM w1 JOIN sr ON w1.t = sr.t AND w1.lv < sr.lv JOIN ru ON ru.t = w1.t AND ru.lv = w1.lv AND ru.p = w1.i // 3),
w2 AS (SELECT doc_id, 0 AS lv, w1.t AS i, h, pr FROM w1 JOIN sr ON w1.t = sr.t AND w1.lv = sr.lv
  UNION ALL SELECT doc_id, w2.lv + 1, i // 3, sha256(array_to_string(list_concat(hs[1:i % 3], [h], hs[i % 3 + 2:]), '')), pr || array_to_string(list_concat(hs[1:i % 3], hs[i % 3 + 2:]), '')
  FROM w2 JOIN rt ON rt.lv = w2.lv AND rt.p = w2.i // 3 WHERE w2.lv < (SELECT max(lv) FROM tp)),
ro AS (SELECT arg_max(h, lv) AS root, max(lv) AS lv FROM tp)
SELECT pl.doc_id, leaf, subroot, root, sha256(pr) AS proof_sha256, w2.h AS folded_root, w2.h = root AS verified
FROM pl JOIN sr ON pl.t = sr.t JOIN w2 ON w2.doc_id = pl.doc_id JOIN ro ON w2.lv = ro.lv
"""
