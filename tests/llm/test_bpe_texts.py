"""Byte-level BPE on texts of many lines, without spaces, and of one long word, against the rank library."""

import hashlib
import random

import pytest

from tracemill.llm import bpe, queries


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = queries.multi_vocabulary()
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9)))
    han = [chr(0x4E00 + k) for k in range(3000)]
    return [
        *("\n".join(word() for _ in range(n)) for n in (10, 300, 1_000, 100_000)),
        "\n".join(f"{word()},{r.randint(0, 999)}" for _ in range(5_000)),
        "".join(r.choice(han) for _ in range(400_000)),
        "".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(1_000_000)),
        "x" * 5_000_000,
        "\n" * 3000 + "a" + "\r\n" * 500 + "b\n\n",
    ]


def test_long_texts_have_the_ids_of_the_rank_library(spark, library):
    texts = hard_texts()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for x in bpe.round_trip(df, *queries.multi_vocabulary()).collect():
        ids = library.encode_ordinary(texts[x.doc_id])
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[x.doc_id].encode())), x.doc_id


def test_cuts_are_the_patterns(library):
    r = random.Random(5)
    with open(queries.multi_vocabulary()[0], "rb") as f:
        ranks = bpe.read_ranks(f.read())
    encoder = bpe.Encoder(ranks, bpe.merges_of(ranks), queries.multi_vocabulary()[1], kept=500)
    parts = ["a", "Z", "é", "ß", "日", "0", "9", "½", ".", ",", "!", "?", "'", "'s", "'ll", "-", "_", "/", "=", "+", "\n", "\n\n", "\t", " ", "\x1c", "\x85", " ", "#", "́"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert [int(i) for e in next(encoder.entries([t])) for i in e[0].split(",")] == library.encode_ordinary(t), repr(t)


def test_little_is_kept(library):
    r = random.Random(6)
    with open(queries.multi_vocabulary()[0], "rb") as f:
        ranks = bpe.read_ranks(f.read())
    encoder = bpe.Encoder(ranks, bpe.merges_of(ranks), queries.multi_vocabulary()[1], kept=1000)
    texts = ["".join(r.choice("日本語文字") for _ in range(5000)) for _ in range(50)] + [" ".join(str(r.random()) for _ in range(200_000))]
    list(encoder.entries(texts))
    assert all(len(c) <= bpe.LONGEST for c in encoder.known) and len(encoder.older) <= 1000 + 8 * bpe.STRETCH
