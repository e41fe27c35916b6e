"""Front matter in nested forms, and JSON values as text."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import text

CASES = {
    "maps": ("name: x\nmetadata:\n  author:\n    name: 'A: B'\n    url: http://a.b/c # home\n  version: 2\nlast: y", {"name": "x", "metadata.author.name": "A: B", "metadata.author.url": "http://a.b/c", "metadata.version": "2", "last": "y"}),
    "lists": ("tags:\n- a\n- 'b c'\nmore:\n  - x\n  - y # two\nflow: [p, \"q\"]\nnone: []", {"tags.0": "a", "tags.1": "b c", "more.0": "x", "more.1": "y", "flow.0": "p", "flow.1": "q"}),
    "list of maps": ("hooks:\n  - name: one\n    run: go\n    args:\n      - -v\n      - k: z\n  - name: two\nend: 1", {"hooks.0.name": "one", "hooks.0.run": "go", "hooks.0.args.0": "-v", "hooks.0.args.1.k": "z", "hooks.1.name": "two", "end": "1"}),
    "blocks": ("a: |\n  one\n    two\n\n  three: no key\nb: >-\n  one\n  two\n\n  three\nc:\n  d: |\n    # kept\n    x\ne: f", {"a": "one\n  two\n\nthree: no key", "b": "one two\nthree", "c.d": "# kept\nx", "e": "f"}),
    "plain over lines": ("description: first\n  second\n  third\nname: n", {"description": "first second third", "name": "n"}),
    "comments and repeats": ("# head\nname: a\n\n  # inner\nname: b\n\"quo ted\": c\nempty:\nhash: a#b", {"name": "b", "quo ted": "c", "hash": "a#b"}),
    "braces": ("m: {a: 1}\nx: y", {"m": "{a: 1}", "x": "y"}),
}


def test_front_matter_paths(spark):
    rows = [(k, f"---\n{m}\n---\nbody: no") for k, (m, _) in CASES.items()] + [("none", "text"), ("null", None), ("open", "---\na: b"), ("crlf", "---\r\na:\r\n  b: c\r\n---\r\n")]
    got = {r.k: r.v for r in spark.createDataFrame(rows, "k string, m string").select("k", text.front_matter_paths(F.col("m")).alias("v")).collect()}
    for k, (_, want) in CASES.items():
        assert got[k] == want, k
    assert got["none"] == got["null"] == got["open"] == {} and got["crlf"] == {"a.b": "c"}


def test_a_long_front_matter(spark):
    m = "---\nitems:\n" + "\n".join(f"  - id: {i}\n    to:\n      at: x{i}" for i in range(300)) + "\n---\n"
    v = spark.createDataFrame([(m,)], "m string").select(text.front_matter_paths(F.col("m")).alias("v")).first().v
    assert len(v) == 600 and v["items.299.to.at"] == "x299" and v["items.7.id"] == "7"
