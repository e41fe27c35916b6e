"""Byte-level BPE over Arrow batches with the tokenizers library, and its reverse.

The rank file holds byte strings; the tokenizers library wants a vocabulary of
characters and an ordered list of merges. Each byte becomes a character by the usual
byte table, and the merge that makes a token is found by running the merges on its own
bytes until two parts are left. That run is the only way in which the token can come
about inside a longer text, since no merge may cross its ends, so merging by this list
gives what merging by ranks gives.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import slices


@functools.cache
def byte_characters() -> tuple[str, ...]:
    """The character that stands for each byte: itself if printable, else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, free = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in table:
            table[b], free = chr(free), free + 1
    return tuple(table[b] for b in range(256))


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes the token; None if merging its bytes stops short of two."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if rank == 1 << 60:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def spell(data: bytes) -> str:
    table = byte_characters()
    return "".join(table[b] for b in data)


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    ordered = sorted((r, t) for t, r in ranks.items() if len(t) > 1)
    return [(spell(m[0]), spell(m[1])) for _, t in ordered if (m := last_merge(t, ranks))]


def build(ranks: dict[bytes, int], merges: list[tuple[str, str]], pattern: str):
    """A tokenizers.Tokenizer that splits by pattern and merges inside each match; whole matches in the vocabulary stay whole."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE(vocab={spell(b): r for b, r in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


def decode_ids(ids: list[int], pieces: dict[int, bytes]) -> bytes:
    """The bytes of ids in order. A character whose bytes lie in several tokens comes back whole once they are joined."""
    return b"".join(map(pieces.__getitem__, ids))


def chunks_of(text: str) -> list[str]:
    """Cuts a text before each space that a character other than white space follows.

    The split pattern always cuts there too, whatever stands around, so the chunks can be
    split and merged apart and give the ids of the whole text.
    """
    first, *rest = text.split(" ")
    out = [first]
    for part in rest:
        if part and not part[0].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return out if out[0] else out[1:]


#: A chunk of this form is one match of the split pattern, so that the model can take it at once.
ONE_MATCH = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Between letters, digits, marks and line feeds the pattern always cuts too. The apostrophe,
#: which may begin a match with the letters behind it, is no such mark.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r".,;:!?/+=_\-"
CUT = re.compile(rf"(?<=[{_LETTER}])(?=[0-9{_MARK}\n])|(?<=[0-9])(?=[{_LETTER}{_MARK}\n])|(?<=[{_MARK}])(?=[{_LETTER}0-9\n])|(?<=\n)(?=\S)")
#: The commonest chunk with one cut.
TAIL = re.compile(f"( ?[{_LETTER}]+)([.,;:!?])")
#: The pattern for which these cuts hold.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer chunks are not kept.
LONGEST = 64
#: Chunks of a text between two looks at how many are kept.
STRETCH = 50_000


def blank_run(token: bytes) -> bool:
    """Whether a token joins a line feed to white space before it, or to the end of a character that may be some."""
    before = token[:-1].lstrip(bytes(range(0x80, 0xC0)))
    return len(token) > 1 and token.endswith(b"\n") and (not before or before.decode(errors="replace").isspace())


def may_cut(ranks: dict[bytes, int], pattern: str) -> bool:
    """Whether texts may be encoded by chunks: the pattern is the one that the cuts were made for, and no token joins white space with a line feed.

    Behind the last line feed of some white space stands a cut, where the pattern parts that line feed from what is before it.
    """
    return pattern == CUT_PATTERN and not any(map(blank_run, ranks))


class Encoder:
    """Encodes texts by chunks; what a chunk gave is kept for its next occurrences.

    With another pattern, or a vocabulary that joins line feeds, each text is encoded whole.

    Kept chunks are short and in two generations of at most `kept` chunks each, but for one
    stretch of a text: the older one goes when the younger one is full, and what is used
    again moves to the younger one.
    """

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[str, str]], pattern: str, kept: int = 150_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.pieces, self.kept = build(ranks, merges, pattern), {r: b for b, r in ranks.items()}, kept
        self.spelled = dict(enumerate(byte_characters()))
        self.cuts = may_cut(ranks, pattern)
        #: Chunk: its ids as text, how many, and the bytes that they decode to.
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def learn(self, chunk: str) -> tuple[str, int, bytes]:
        found = self.older.get(chunk)
        if not found:
            parts = [chunk] if ONE_MATCH.fullmatch(chunk) else m.groups() if (m := TAIL.fullmatch(chunk)) else CUT.split(chunk)
            if len(parts) == 1:
                found = self.merge(chunk)
            else:
                got = [self.known.get(p) or self.older.get(p) or self.merge(p) for p in parts]
                found = (",".join([e[0] for e in got]), sum([e[1] for e in got]), b"".join([e[2] for e in got]))
        if len(chunk) <= LONGEST:
            self.known[chunk] = found
        return found

    def merge(self, part: str) -> tuple[str, int, bytes]:
        """What a part without a sure cut gives."""
        if ONE_MATCH.fullmatch(part):
            ids = [t.id for t in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.spelled))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        found = (",".join(map(str, ids)), len(ids), decode_ids(ids, self.pieces))
        if len(part) <= LONGEST:
            self.known[part] = found
        return found

    def whole(self, text: str) -> tuple[str, int, bytes]:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return ",".join(map(str, ids)), len(ids), decode_ids(ids, self.pieces)

    def entries(self, texts: list[str | None]) -> Iterator[list[tuple[str, int, bytes]]]:
        """What each text's chunks give, in order."""
        for text in texts:
            if not self.cuts:
                yield [self.whole(text)] if text else []
                continue
            chunks, out = chunks_of(text) if text else [], []
            for at in range(0, len(chunks), STRETCH):
                if len(self.known) > self.kept:
                    self.known, self.older = {}, self.known
                get, learn = self.known.get, self.learn
                out += [get(c) or learn(c) for c in chunks[at : at + STRETCH]]
            yield out


def token_spans(ids: list[int], pieces: dict[int, bytes]) -> tuple[list[int], list[int]]:
    """First character and end of each token. A token that holds part of a character spans that whole character."""
    import numpy as np

    lengths = np.array([len(pieces[i]) for i in ids], dtype=np.int64)
    data = np.frombuffer(decode_ids(ids, pieces), dtype=np.uint8)
    if not len(data):
        return [], []
    at = np.cumsum((data & 0xC0) != 0x80) - 1  # the character of each byte
    ends = np.cumsum(lengths)
    return at[ends - lengths].tolist(), (at[ends - 1] + 1).tolist()


def _shared(spark: SparkSession, vocabulary: str, pattern: str):
    """The rank file is read by the driver and sent once; its size is that of a vocabulary, whatever the corpus."""
    with open(vocabulary, "rb") as f:
        ranks = read_ranks(f.read())
    return spark.sparkContext.broadcast((ranks, merges_of(ranks), pattern))


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts, ends (arrays of int), a row per row of docs: ids and the characters that each id covers.

    Null and empty texts give empty arrays. Other columns play no part, repeated rows give
    repeated results, null ids are carried along, and an empty table gives an empty one.
    """
    shared = _shared(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        encoder = Encoder(*shared.value)
        for b in slices(batches, "text"):
            ids = [[int(i) for e in t for i in e[0].split(",")] for t in encoder.entries(b.column("text").to_pylist())]
            spans = [token_spans(x, encoder.pieces) for x in ids]
            cols = [pa.array(x, pa.list_(pa.int32())) for x in (ids, [s[0] for s in spans], [s[1] for s in spans])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str = "", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and data (binary): the bytes of each row's ids. Null ids give no bytes; an id outside the vocabulary is an error."""
    shared = _shared(encoded.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        pieces = {r: b for b, r in shared.value[0].items()}
        for b in batches:
            data = [decode_ids(x or [], pieces) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {dict(encoded.dtypes)[id_col]}, data binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded and its ids decoded again; digests of both.

    The first is over the decimal ids joined by commas, the second over the decoded bytes.
    Cases are as in encode(); an empty text has the digests of nothing.
    """
    shared = _shared(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        encoder, sha = Encoder(*shared.value), hashlib.sha256
        for b in slices(batches, "text"):
            n, ids, back = [], [], []
            for t in encoder.entries(b.column("text").to_pylist()):
                n.append(sum(e[1] for e in t))
                ids.append(sha(",".join([e[0] for e in t]).encode()).hexdigest())
                back.append(sha(b"".join([e[2] for e in t])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
