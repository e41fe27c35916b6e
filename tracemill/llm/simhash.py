"""SimHash near-duplicates: 64-bit fingerprints linked through sharded BK-trees.

A fingerprint has 64 bits and links reach 3, so of four 16-bit blocks of two linked
fingerprints one at least is equal (pigeonhole). Each block value is a shard. A shard's
fingerprints are dealt over trees of about `tree_size` nodes; each tree is held by one
task, and every fingerprint of the shard is looked up in each of its trees. A tree thus
has a size that is bounded whatever the corpus holds, which a broadcast tree over all
fingerprints would not have. Exact copies collapse to one fingerprint beforehand.

Links by similarity (keep_one() with similar=True) ask for more differing bits than equal
blocks can promise: two texts that share 0.8 of their five-word shingles differ in about 10
bits. There a shard holds the texts that share a band of minima of their shingle hashes.
Bands of ROWS minima let a pair of similarity s through with probability
1 - (1 - s ** ROWS) ** BANDS; 5e-8 are missed at 0.8, fewer above. A shard's BK-trees are
followed within WIDE bits, and exact overlap of the shingles confirms what they give. The
first tree of a band holds two of its members only, in which all others are looked up; what
it leaves apart goes through trees of whole blocks. Every link comes from such a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import KEY, checkpointed, free_prefix, row_key, slices
from tracemill.llm.graph import connected_components

BITS, RADIUS, BLOCKS = 64, 3, 4
#: Links by similarity: share of common shingles as a fraction, bands and minima in each, and the trees' radius. At that share a bit differs with
#: probability 0.15, or 0.19 in sets of four and five shingles, so that fewer than one pair in 10 ** 9 exceeds the radius.
SHARE, BANDS, ROWS, WIDE = (4, 5), 32, 4, 34


def shingle_hashes(text: str | None, width: int):
    """XXH64 of each run of `width` words, A-Z lower-cased, repeats included; of all words where there are fewer, of none where there are none."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hash_of, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([hash_of(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    return np.fromiter((hash_of(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts))


def majority(h) -> int:
    """The number whose bits are those that over half of the hashes have."""
    import numpy as np

    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    return int(weights[ones * 2 > len(h)].sum(dtype=np.uint64))


def fingerprint_batch(texts: list[str | None], width: int = 3) -> list[int]:
    """Unsigned fingerprints: A-Z lower-cased, `width`-word shingles, repeats included.

    A text with fewer words has its whole word sequence as its one shingle; a text
    without words (null, empty) has fingerprint 0.
    """
    return [majority(shingle_hashes(t, width)) for t in texts]


def _fingerprinted(rows: DataFrame, width: int) -> DataFrame:
    """rows with the column `text` replaced by fp, its fingerprint's bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for b in slices(batches, "text", 2 << 20):
            fp = np.array(fingerprint_batch(b.column("text").to_pylist(), width), dtype=np.uint64).view(np.int64)
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(fp)], names=[*names, "fp"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(run, ", ".join([*kept, "fp bigint"]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id long and fp long (the fingerprint's bits as a signed number), a row per row of docs."""
    return _fingerprinted(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), width)


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = x
            self.children[x] = {}
            return
        at = self.root
        while d := (at ^ x).bit_count():
            edges = self.children[at]
            if d not in edges:
                edges[d] = x
                self.children[x] = {}
                return
            at = edges[d]

    def within(self, x: int, radius: int = RADIUS) -> Iterator[int]:
        todo = [] if self.root is None else [self.root]
        children = self.children
        while todo:
            at = todo.pop()
            d = (at ^ x).bit_count()
            if d <= radius:
                yield at
            if edges := children[at]:
                if len(edges) < 2 * radius + 1:
                    todo.extend(c for k, c in edges.items() if -radius <= k - d <= radius)
                else:
                    todo.extend(edges[k] for k in range(d - radius, d + radius + 1) if k in edges)


class _Groups:
    """Union-find over the fingerprints of one tree and of those looked up in it."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def tree_links(members: list[int], asked: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all pairs within the radius would, at most one for each that is asked.

    members make up the tree; asked are looked up in it.
    """
    tree, groups, out = BKTree(), _Groups(), []
    for x in members:
        tree.add(x)
    for x in asked:
        for y in tree.within(x, radius):
            if x != y and groups.join(x, y):
                out.append((x, y))
    return out


def shard_links(fps: DataFrame, tree_size: int = 2048, asked_size: int = 8192) -> DataFrame:
    """Links a, b (long) between the distinct values of fps.fp, enough of them to join all that lie within the radius.

    A shard of more than tree_size fingerprints is dealt over several trees by a hash, and
    each of its fingerprints is looked up in every tree of the shard. Lookups are dealt over
    parts of about asked_size, each of which has the tree to itself, so that no group is
    larger than the two sizes together however crowded a shard is.
    """
    block = F.expr("shiftrightunsigned(fp, CAST(16 * k AS INT)) & 65535")
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("k")).withColumn("shard", F.col("k") * 65536 + block)
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    spread = keyed.select("fp", "shard").join(sizes, "shard").withColumn("trees", F.ceil(F.col("n") / tree_size).cast("int")).withColumn("parts", F.ceil(F.col("n") / asked_size).cast("int"))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("parts")).cast("int"))
    places = F.expr("""concat(transform(sequence(0, trees - 1), t -> struct(t AS tree, part AS part, t = own AS member, true AS asked)),
        transform(filter(sequence(0, parts - 1), p -> p <> part), p -> struct(own AS tree, p AS part, true AS member, false AS asked)))""")
    asked = spread.select("shard", "fp", F.explode(places).alias("at")).select("shard", "at.tree", "at.part", "fp", "at.member", "at.asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        def links(key: np.ndarray, fp: np.ndarray, member: np.ndarray, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1
            found: list[tuple[int, int]] = []
            for f, m, q in zip(*(np.split(x, cuts) for x in (fp, member, asked))):
                found += tree_links(f[m].tolist(), f[q].tolist())
            a = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.column_stack([np.asarray(b.column(c), dtype=np.int64) for c in ("shard", "tree", "part")])
            now = [key, np.asarray(b.column("fp"), dtype=np.int64).view(np.uint64), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("member", "asked"))]
            held = [np.concatenate(x) for x in zip(held, now)] if held else now
            # The last group of a batch may go on in the next one.
            last = len(held[0]) - int(np.argmin((held[0] == held[0][-1]).all(axis=1)[::-1])) if (held[0] != held[0][-1]).any() else 0
            if last:
                yield from links(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held:
            yield from links(*held)

    dealt = asked.repartition("shard", "tree", "part").sortWithinPartitions("shard", "tree", "part")
    return dealt.mapInArrow(run, "a long, b long")


def _sketched(rows: DataFrame, width: int, sets: bool) -> DataFrame:
    """rows with `text` replaced by node (a hash of the set of shingles, 0 for none), fp, and hs: the sorted shingles, or the keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import xxhash

        r = np.random.default_rng(8)
        factor = r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        plus = r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
        for b in slices(batches, "text", 2 << 20):
            nodes, fps, lists = [], [], []
            for t in b.column("text").to_pylist():
                h = np.unique(shingle_hashes(t, width))
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), 7) if len(h) else 0)
                fps.append(majority(h))
                if sets or not len(h):
                    lists.append(h.view(np.int64))
                    continue
                least = np.min([(h[at : at + 512, None] * factor + plus).min(axis=0) for at in range(0, len(h), 512)], axis=0)
                keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
                lists.append(np.array(keys, np.uint64).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
            names = [n for n in b.schema.names if n != "text"]
            made = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *made, values], names=[*names, "node", "fp", "hs"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(run, ", ".join([*kept, "node bigint", "fp bigint", "hs array<bigint>"]))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b (a member and a node of its band's first tree) whose fingerprints lie within WIDE bits and whose sets share SHARE of their union or more."""
    p, q = SHARE
    x = sets.select(F.col("node").alias("a"), F.col("fp").alias("fa"), F.col("hs").alias("ha"))
    y = sets.select(F.col("node").alias("b"), F.col("fp").alias("fb"), F.col("hs").alias("hb"))
    both = pairs.join(x, "a").join(y, "b").where(f"bit_count(fa ^ fb) <= {WIDE}").where(f"{q} * least(size(ha), size(hb)) >= {p} * greatest(size(ha), size(hb))")
    return both.where(f"{p + q} * size(array_intersect(ha, hb)) >= {p} * (size(ha) + size(hb))").select("a", "b")


def overlaps(left: list, right: list):
    """How many values each set of `left` has in common with each of `right`; sets are arrays without repeats."""
    import numpy as np

    out = np.zeros((len(left), len(right)), np.float32)
    _, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = sum(map(len, left))
    both = np.zeros(int(place.max(initial=-1)) + 1, bool)
    both[place[:cut]] = True
    also = np.zeros_like(both)
    also[place[cut:]] = True
    column = np.cumsum(both & also) - 1

    def cells(sets: list, at):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        keep = (both & also)[at]
        row, col = row[keep], column[at[keep]]
        order = np.argsort(col, kind="stable")
        return row[order], col[order]

    (r1, c1), (r2, c2) = cells(left, place[:cut]), cells(right, place[cut:])
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        dense = []
        for n, r, c in ((len(left), r1, c1), (len(right), r2, c2)):
            i, j = np.searchsorted(c, (lo, lo + 4096))
            m = np.zeros((n, 4096), np.float32)
            m[r[i:j], c[i:j] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def similar_pairs(nodes: list[int], fps: list[int], sets: list, groups: _Groups, first: list[bool], one: bool) -> list[tuple[int, int]]:
    """Links between nodes that join what all pairs of SHARE or more would, beyond what `groups` has joined.

    The nodes with `first` make up a BK-tree; the others are looked up in it, or all if
    there is one block only (`one`).
    """
    p, q = SHARE
    tree, at = BKTree(), {}
    for i, f in enumerate(fps):
        if first[i]:
            tree.add(f)
            at.setdefault(f, []).append(i)
    found = []
    for j, f in enumerate(fps):
        if one or not first[j]:
            for g in tree.within(f, WIDE):
                for i in at[g]:
                    a, b = len(sets[i]), len(sets[j])
                    if (i < j or not one) and q * min(a, b) >= p * max(a, b) and groups.root(nodes[i]) != groups.root(nodes[j]):
                        found.append((i, j))
    if not found:
        return []
    left, right = sorted({i for i, _ in found}), sorted({j for _, j in found})
    row, col = {i: k for k, i in enumerate(left)}, {j: k for k, j in enumerate(right)}
    common = overlaps([sets[i] for i in left], [sets[j] for j in right])
    return [(nodes[i], nodes[j]) for i, j in found if (p + q) * common[row[i], col[j]] >= p * (len(sets[i]) + len(sets[j])) and groups.join(nodes[i], nodes[j])]


def dealt_blocks(shard: DataFrame, block: int, weight: int) -> DataFrame:
    """shard, lo, hi, own, node, root, fp, hs: the members of each shard once for every pair of blocks, lo and hi, in which they meet others.

    Only pairs of different components can join anything. The largest component of a shard
    is therefore looked up alone; the others, its strays, ask: their blocks meet each other
    and those of the largest, so a crowd of n members with s strays is dealt in about
    n * s / block rows, beside n.
    """
    comps = shard.groupBy("shard", "root").agg(F.count("*").alias("n"), F.sum(F.size("hs")).alias("w"))
    largest = comps.groupBy("shard").agg(F.max(F.struct("n", "root"))["root"].alias("largest"))
    parted = comps.join(largest, "shard").groupBy("shard", "largest").agg(*[F.sum(F.when(F.col("root") != F.col("largest"), F.col(c)).otherwise(0)).alias(f"s{c}") for c in "nw"], *[F.sum(F.when(F.col("root") == F.col("largest"), F.col(c)).otherwise(0)).alias(f"l{c}") for c in "nw"])
    blocks = lambda side: F.greatest(F.ceil(F.col(f"{side}n") / block), F.ceil(F.col(f"{side}w") / weight)).cast("int")
    sizes = parted.where("sn > 0").select("shard", "largest", blocks("s").alias("strays"), blocks("l").alias("rest"))
    turn = lambda n: F.pmod(F.xxhash64(F.lit(4), "node"), F.col(n)).cast("int")
    stray = F.col("root") != F.col("largest")
    dealt = shard.join(sizes, "shard").withColumn("own", F.when(stray, turn("strays")).otherwise(F.col("strays") + turn("rest")))
    dealt = dealt.select("*", F.explode(F.when(stray, F.expr("sequence(0, strays + rest - 1)")).otherwise(F.expr("sequence(0, strays - 1)"))).alias("other"))
    return dealt.select("shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "root", "fp", "hs")


def similar_links(one: DataFrame, rows: DataFrame, width: int, block: int = 512, weight: int = 1 << 19) -> DataFrame:
    """Links a, b between nodes that join what all pairs of SHARE or more would. one: node, least (its key), hs (its bands); rows: keys and text.

    Each member of a band is first looked up in a tree of two of its members (at most two
    distances, so an expression), which joins most of a crowd. Bands that still hold several components go through the trees, or, where bands of
    the same members overlap so much that this is less work, the members of all of them at
    once. Members are dealt over blocks of at most `block` texts and about `weight` shingles,
    and each task has two blocks; of the largest component only what strays ask for is looked
    up. A block holds one text at least: what a task needs for a very long text is that
    text's distinct shingles, eight bytes each, beside a block of others.
    """
    keyed = one.select("node", F.explode("hs").alias("band"))
    # Bands with the same members count once.
    same = keyed.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("n > 1")
    members = checkpointed(keyed.join(same.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band"), "band"))
    need = one.join(members.select("node").distinct(), "node", "left_semi").select("least.*")
    sets = checkpointed(_sketched(rows.join(need, KEY, "left_semi").dropDuplicates(KEY), width, True).select("node", "fp", "hs"))

    place = F.xxhash64(F.lit(3), "node")
    leaders = members.groupBy("band").agg(F.array_distinct(F.array(F.min_by("node", place), F.max_by("node", place))).alias("two"))
    tried = members.join(leaders, "band").select("node", F.explode("two").alias("other")).where("node <> other")
    found = checkpointed(_confirmed(tried.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), sets))

    roots = connected_components(found)
    placed = members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("head")).where("lo <> hi").select("band", "head")
    rest = checkpointed(placed.join(split, "band"))
    # Crowds: members that reach each other over shared bands.
    crowd = connected_components(rest.select(F.col("node").alias("a"), F.col("head").alias("b"))).select("node", F.col("root").alias("crowd"))
    by_band = rest.groupBy("band").agg(F.count("*").alias("n"), F.first("head").alias("node")).join(crowd, "node")
    by_crowd = by_band.groupBy("crowd").agg(F.sum(F.col("n") * F.col("n")).alias("cost")).join(crowd.groupBy("crowd").agg(F.count("*").alias("n")), "crowd")
    placed_in = crowd.join(by_crowd.select("crowd", (F.col("n") * F.col("n") <= F.col("cost")).alias("whole")), "crowd")
    shard = rest.join(placed_in, "node").select(F.when(F.col("whole"), F.xxhash64(F.lit("crowd"), "crowd")).otherwise(F.xxhash64(F.lit("band"), "band")).alias("shard"), "node", "root").distinct()

    dealt = dealt_blocks(checkpointed(shard.join(sets, "node")), block, weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for t in _runs(batches, ("shard", "lo", "hi")):
            lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            nodes, groups = t.column("node").to_pylist(), _Groups()
            for x, y in zip(nodes, t.column("root").to_pylist()):
                groups.join(x, y)
            fps = t.column("fp").to_numpy().view(np.uint64).tolist()
            hs = [x.values.to_numpy() for x in t.column("hs")]
            links = similar_pairs(nodes, fps, hs, groups, [x == lo for x in t.column("own").to_pylist()], lo == hi)
            ab = np.array(links, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    more = dealt.repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi", "node").mapInArrow(run, "a long, b long")
    return found.unionByName(more)


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys; batches are sorted by them."""
    import numpy as np
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.column_stack([np.asarray(b.column(k), dtype=np.int64) for k in keys])
        starts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1).tolist()]
        for i, j in zip(starts, [*starts[1:], b.num_rows]):
            now = tuple(key[i])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, tree_size: int = 2048) -> DataFrame:
    """doc_id, fp (long), fingerprint (16 hex digits) and component_id, a row per row of docs.

    component_id is the smallest doc_id whose fingerprint is reached over links of at most
    3 differing bits. Null, empty and blank texts have fingerprint 0 and are linked like
    any other. Repeated rows give repeated results; a null id is carried along, and a
    component that has null ids only has a null component_id. Other columns of docs,
    whatever their names, play no part; an empty table gives an empty result.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, width))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(shard_links(least.select("fp"), tree_size)).select(F.col("node").alias("fp"), "root")
    rooted = least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(of_root, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, tree_size: int = 2048, similar: bool = False) -> DataFrame:
    """One row of docs for each component of linked texts, that with the smallest id; all columns as they are.

    Links are those of near_duplicates(), or, if `similar`, those between texts that share
    SHARE of their distinct shingles or more; texts without words are then one component.
    Of rows that share that id the one with the smallest key of its text stays, and one of
    rows equal in both. A row with a null id stays only where its component has no other.
    Other cases are as in near_duplicates().
    """
    p = free_prefix(docs)
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    least = F.min(F.struct(*KEY)).alias("least")
    if similar:
        sketched = checkpointed(_sketched(rows, width, False))
        one = checkpointed(sketched.groupBy("node").agg(least, F.first("hs").alias("hs")))
        links = similar_links(one, rows, width)
    else:
        one = checkpointed(_fingerprinted(rows, width)).groupBy(F.col("fp").alias("node")).agg(least)
        links = shard_links(one.select(F.col("node").alias("fp")), tree_size)
    named = one.select("node", "least").join(connected_components(links), "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    heads = named.groupBy("root").agg(F.min("least").alias("head")).select(*[F.col(f"head.{k}").alias(f"{p}h{i}") for i, k in enumerate(KEY)])
    keys = [c.alias(f"{p}r{i}") for i, c in enumerate(row_key(id_col, text_col))]
    kept = docs.select("*", *keys).join(heads, F.expr(" and ".join(f"{p}r{i} = {p}h{i}" for i in range(4))), "left_semi")
    return kept.dropDuplicates([f"{p}r{i}" for i in range(4)]).select(*[F.col(f"`{c}`") for c in docs.columns])
