"""User names in texts replaced by hashes, for any number of names.

Names are a table. As many as a shard holds go through the texts as one Aho-Corasick automaton
that tells which names a text holds. More are joined: what stands in a text where a name may
stand is looked up in the table, if a filter of fixed size lets it pass, so the work grows with
the texts and with the names but not with their product. The text is then rewritten with its
own names only. That gives what one expression over all names would.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.durable import checkpointed

# Places where a path names a user.
HOMES = (r"[A-Za-z]:\\Users\\([^\\]+)\\", r"/mnt/[a-z]/Users/([^/]+)/", r"/(?:Users|home)/([^/]+)/", r"-(?:Users|home)-([^-]+)-")
BARE = 4
#: Names of an automaton; of more, none is made.
SHARD = 50_000
#: Where the paths that are rewritten name a user: what comes before, and the character behind.
PATHS = ((r"/(?:Users|home)/", "/"), (r"-(?:Users|home)-", "-"), (r"[A-Za-z]:\\Users\\", "\\"))
OPENING = [re.compile(p) for p, _ in PATHS]


def user_hash(name: str) -> str:
    return "user_" + hashlib.sha256(name.encode()).hexdigest()[:8]


def user_names(texts: DataFrame, column: str) -> DataFrame:
    """name: the distinct user names in the paths of all texts."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(p), F.lit(1)) for p in HOMES])
    return texts.select(F.explode(found).alias("name")).where("name <> '' and not name like '% %'").distinct()


def variants(name: str) -> list[str]:
    """Other spellings of a name written in camel case: its parts joined, and each long part."""
    # Fixed value: where a name in camel case is parted.
    parts = re.split(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", name)
    if len(parts) < 2:
        return []
    return list(dict.fromkeys([s.join(parts).lower() for s in (" ", "_", "-", "")] + [p.lower() for p in parts if len(p) >= BARE]))


def spellings(names: DataFrame) -> DataFrame:
    """key, owner: each spelling of a name and the last of the names that have it."""
    spelled = F.pandas_udf(lambda s: s.map(variants), "array<string>")
    return names.select("name", F.explode(spelled("name")).alias("key")).groupBy("key").agg(F.max("name").alias("owner"))


def fold(text: str) -> str:
    """A text in which characters that an expression takes for each other without regard to case are the same."""
    return text.upper().lower()


def in_paths(text: str, names: dict[str, str]) -> str:
    """Names in paths, of those at one place the longest; scanned for, as an expression of each text's own names would take longer to compile."""
    longest = sorted(names, key=len, reverse=True)
    for opening, (_, end) in zip(OPENING, PATHS, strict=True):
        out, done, m = [], 0, opening.search(text)
        while m:
            at = m.end()
            name = next((n for n in longest if text.startswith(n, at) and text.startswith(end, at + len(n))), None)
            if name is None:
                m = opening.search(text, m.start() + 1)
            else:
                out += [text[done:at], user_hash(name)]
                done = at + len(name)
                m = opening.search(text, done + 1)
        text = "".join([*out, text[done:]])
    return text


def edges(text: str) -> list[int]:
    """Where words begin and end."""
    return [m.start() for m in re.finditer(r"\b", text)]


def alone(text: str, names: dict[str, str]) -> str:
    at = edges(text)
    ends, longest = set(at), sorted({len(n) for n in names}, reverse=True)
    out, done = [], 0
    for i in at:
        if i >= done:
            for n in longest:
                if i + n in ends and text[i : i + n] in names:
                    out += [text[done:i], user_hash(text[i : i + n])]
                    done = i + n
                    break
    return "".join([*out, text[done:]])


def spelled(text: str, owners: dict[str, str]) -> str:
    if not owners:
        return text
    alt = "|".join(re.escape(v) for v in sorted(owners, key=len, reverse=True))
    return re.sub(alt, lambda m: user_hash(owners.get(m[0].lower()) or owners[next(v for v in owners if fold(v) == fold(m[0]))]), text, flags=re.IGNORECASE)


#: The automaton that a worker holds, by the id of its names.
_HELD: dict[int, object] = {}


def _automaton(shared, folded: bool):
    """The automaton of a shard, built once by each worker; the one before is let go."""
    import ahocorasick

    if shared.id not in _HELD:
        _HELD.clear()
        a = ahocorasick.Automaton()
        for key, owner in shared.rows.value:
            a.add_word(fold(key) if folded else key, (key, owner))
        a.make_automaton()
        _HELD[shared.id] = a
    return _HELD[shared.id]


class _Shared:
    """A shard's names on all executors."""

    def __init__(self, spark, rows: list[tuple[str, str]]):
        self.rows = spark.sparkContext.broadcast(rows)
        self.id = self.rows._jbroadcast.id()

    def __getstate__(self):
        return self.rows, self.id

    def __setstate__(self, state):
        self.rows, self.id = state


def _held(shared: _Shared, folded: bool, text: str | None) -> dict[str, str]:
    """The keys of a shard that a text holds, and their owners."""
    return dict(v for _, v in _automaton(shared, folded).iter(fold(text) if folded else text)) if text else {}


#: A multiplier and its inverse modulo 2**64, for hashes of all pieces of a text from sums over it.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 2**64)
#: Bits of a slice of the filter as a power of two, bits for a key, and slices at most (128 MB).
SLICE, BITS, SLICES = 20, 16, 1024
#: Characters of texts gone through at once, and of a spelling that are looked up.
CHARS, ANCHOR = 1 << 18, 32


def _powers(n: int, held: dict[int, tuple[np.ndarray, np.ndarray]] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of FACTOR and of its inverse, n of each at least; a worker keeps those of the usual number."""
    size = CHARS << max(0, (n // CHARS).bit_length())
    if size not in held:
        of = lambda f: np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, f, dtype=np.uint64))])
        made = of(FACTOR), of(INVERSE)
        if size > CHARS:
            return made
        held[size] = made
    return held[size]


class Pieces:
    """Hashes of pieces of a text, whatever their length, in constant time each."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        up, self.down = _powers(len(points) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(points * up[: len(points)])])

    def __call__(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(texts: list[str]) -> np.ndarray:
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return Pieces("".join(texts))(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if texts else np.zeros(0, dtype=np.uint64)


def bits_of(h: np.ndarray) -> Iterator[np.ndarray]:
    """The four bits of a hash in its slice."""
    least = np.uint64((1 << SLICE) - 1)
    for x in (h, mixed(h)):
        yield (x & least).astype(np.int64)
        yield (x >> np.uint64(SLICE) & least).astype(np.int64)


class Filter:
    """Lets all keys of a table pass and few other texts: a bitmap on all executors, and the keys' lengths.

    Its size is that of the keys, 16 bits each at least, up to SLICES; beyond it more texts pass that are none of the keys.
    """

    def __init__(self, table: DataFrame, column: str, count: int):
        spark = table.sparkSession
        slices = 1
        while slices < min(SLICES, -(-count * BITS >> SLICE)):
            slices *= 2
        self.shift = 64 - (slices.bit_length() - 1)

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(hashes(keys).view(np.int64)), pa.array([len(k) for k in keys], pa.int32())], ["h", "n"])

        def sliced(rows: pa.Table) -> pa.Table:
            h, bits = rows.column("h").to_numpy().view(np.uint64), np.zeros(1 << SLICE, dtype=bool)
            for at in bits_of(h):
                bits[at] = True
            return pa.table({"slice": rows.column("slice")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "lengths": pa.array([np.unique(rows.column("n").to_numpy()).tolist()], pa.list_(pa.int32()))})

        at = F.shiftrightunsigned("h", self.shift) if slices > 1 else F.lit(0).cast("long")
        rows = table.select(column).mapInArrow(hashed, "h long, n int").withColumn("slice", at)
        bits, lengths = np.zeros(slices << SLICE - 3, dtype=np.uint8), set()
        for r in rows.groupBy("slice").applyInArrow(sliced, "slice long, bits binary, lengths array<int>").toLocalIterator():
            bits[r.slice << SLICE - 3 : r.slice + 1 << SLICE - 3] = np.frombuffer(r.bits, dtype=np.uint8)
            lengths |= set(r.lengths)
        #: Sorted, as keys of a dict.
        self.lengths = dict.fromkeys(sorted(lengths))
        self.longest = max(lengths)
        self.bits = spark.sparkContext.broadcast(bits)

    def passing(self, h: np.ndarray) -> np.ndarray:
        """The places of the hashes that pass."""
        bits, at = self.bits.value, np.arange(len(h))
        for k in range(4):
            x = h[at]
            place = next(b for j, b in enumerate(bits_of(x)) if j == k)
            if self.shift < 64:
                place |= (x >> np.uint64(self.shift)).astype(np.int64) << SLICE
            at = at[bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1]
        return at


def path_pieces(text: str, keys: Filter) -> Iterator[str]:
    """What stands in a path in a user's place, up to each character that may end it."""
    for opening, (_, end) in zip(OPENING, PATHS, strict=True):
        m = opening.search(text)
        while m:
            start = m.end()
            at = text.find(end, start + 1)
            while 0 <= at <= start + keys.longest:
                if at - start in keys.lengths:
                    yield text[start:at]
                at = text.find(end, at + 1)
            m = opening.search(text, m.start() + 1)


def word_pieces(text: str, keys: Filter) -> Iterator[str]:
    """Pieces that begin and end where words do."""
    at = edges(text)
    ends = set(at)
    return (text[i : i + n] for i in at for n in keys.lengths if i + n in ends)


def _chosen(rows: Iterable[tuple[int, str]], pieces: Callable, keys: Filter) -> Iterator[tuple[int, str]]:
    """Row and piece of the pieces that pass the filter."""
    held, size = [], 0

    def passed() -> Iterator[tuple[int, str]]:
        return (held[k] for k in keys.passing(hashes([p for _, p in held])))

    for i, text in rows:
        for p in set(pieces(text, keys)):
            held.append((i, p))
            size += len(p)
        if size > CHARS:
            yield from passed()
            held, size = [], 0
    yield from passed()


def _anywhere(rows: Iterable[tuple[int, str]], keys: Filter) -> Iterator[tuple[int, str]]:
    """Row and piece of all pieces of folded texts that pass the filter."""
    held, size = [], 0

    def passed() -> Iterator[tuple[int, str]]:
        folded = [fold(t) for _, t in held]
        ends, all_, out = np.cumsum([len(t) for t in folded]), "".join(folded), set()
        of = Pieces(all_)
        for n in keys.lengths:
            if n <= len(all_):
                start = keys.passing(of(slice(0, len(all_) - n + 1), slice(n, None)))
                row = np.searchsorted(ends, start, side="right")
                inside = start + n <= ends[row]
                out.update((held[k][0], all_[at : at + n]) for k, at in zip(row[inside].tolist(), start[inside].tolist()))
        return iter(out)

    for i, text in rows:
        held.append((i, text))
        size += len(text)
        if size > CHARS:
            yield from passed()
            held, size = [], 0
    if held:
        yield from passed()


def _replaced(texts: DataFrame, column: str, table: DataFrame, rewrite: Callable[[str, dict[str, str]], str], shard: int, pieces: Callable | None = None) -> DataFrame:
    """texts with a column rewritten by those keys of a table that each of its texts holds.

    pieces(text, keys) gives what may be a key, where it may stand; without it a key may stand anywhere in the folded text.
    """
    count, folded = table.count(), pieces is None
    if not count:
        return texts
    if count <= shard:
        only = _Shared(texts.sparkSession, sorted((r.key, r.owner) for r in table.collect()))

        @F.pandas_udf("string")
        def at_once(s: pd.Series) -> pd.Series:
            return s.map(lambda t: rewrite(t, own) if (own := _held(only, folded, t)) else t)

        return texts.withColumn(column, at_once(F.col(f"`{column}`")))

    names = ["__row", "__own"]
    while set(names) & set(texts.columns):
        names = [f"_{n}" for n in names]
    row, own_ = names
    texts = checkpointed(texts).withColumn(row, F.monotonically_increasing_id())
    # Of a long spelling the beginning is looked up, so that few lengths are tried at each place of a text.
    anchor = F.pandas_udf(lambda s: s.map(lambda k: fold(k)[:ANCHOR]), "string")(F.col("key")) if folded else F.col("key")
    table = table.withColumn("anchor", anchor)
    keys = Filter(table, "anchor", count)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            found = list(_anywhere(rows, keys) if folded else _chosen(rows, pieces, keys))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())], ["i", "anchor"])

    maybe = texts.select(F.col(row).alias("i"), F.col(f"`{column}`").alias("t")).where("t <> ''").mapInArrow(find, "i long, anchor string")
    found = maybe.join(table, "anchor").groupBy(F.col("i").alias(row)).agg(F.flatten(F.collect_list(F.array("key", "owner"))).alias(own_))

    @F.arrow_udf("string")
    def by_own(texts: pa.Array, own: pa.Array) -> pa.Array:
        out = []
        for t, flat in zip(texts.to_pylist(), own.to_pylist(), strict=True):
            if flat:
                whole = fold(t) if folded else None
                t = rewrite(t, {k: o for k, o in zip(flat[::2], flat[1::2], strict=True) if whole is None or fold(k) in whole})
            out.append(t)
        return pa.array(out, pa.string())

    # Lists that are null cost Spark's Arrow writer the square of a batch.
    own = F.coalesce(own_, F.array().cast("array<string>"))
    return texts.join(found, row, "left").withColumn(column, by_own(F.col(f"`{column}`"), own)).drop(*names)


def hash_user_names(texts: DataFrame, column: str, shard: int = SHARD) -> DataFrame:
    """texts with user names replaced by hashes: in paths, then alone if four letters long, then their spellings in any case.

    Names are collected from all texts before any is replaced, so the result doesn't depend
    on the order of rows; it is the same for every size of a shard. A null text stays null.
    Up to `shard` names are handed to all executors; more stay a table that is joined, and
    the driver passes on a filter of 128 MB at most.
    """
    names = checkpointed(user_names(texts, column))
    same = names.select(F.col("name").alias("key"), F.col("name").alias("owner"))
    out = _replaced(texts, column, same, in_paths, shard, path_pieces)
    out = _replaced(out, column, same.where(F.length("key") >= BARE), alone, shard, word_pieces)
    return _replaced(out, column, checkpointed(spellings(names)), spelled, shard)
