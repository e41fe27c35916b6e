"""Queries over the session model on small inputs, beside their SQL."""

import pyspark.sql.functions as F

from tracemill import model
from tracemill.functions import tools
from tracemill.operators import sessions


def test_families_go_level_by_level_and_loops_have_no_root(spark):
    deep = [(f"d{i}", f"d{i - 1}" if i else None) for i in range(30)]
    rows = deep + [("a", None), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x"), ("lost", "nobody")]
    got = {(r.root, r.session_id): r.depth for r in model.family(spark.createDataFrame(rows, "session_id string, parent_id string")).collect()}
    assert {k: v for k, v in got.items() if k[0] == "a"} == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1}
    assert max(got.values()) == 20 and len(got) == 3 + 21
    assert model.family(spark.createDataFrame([], "session_id string, parent_id string")).count() == 0


def test_only_text_is_a_path(spark):
    rows = [('{"file_path": 3, "path": ["x"], "directory": "d"}', "d"), ('{"path": true}', None), ("not json", None), (None, None), ('{"path": "null"}', "null")]
    got = spark.createDataFrame(rows, "a string, want string").select("want", tools.path_of(F.col("a")).alias("p")).collect()
    assert [r.p for r in got] == [r.want for r in got]


def test_a_file_continues_the_session_that_it_opens_with(spark):
    lines = [("f", "s1", 0), ("f", "s1", 1), ("f", "s2", 2), ("f", "s3", 3), ("g", "s2", 0), ("h", None, 0), ("h", "s4", 1), ("h", "s2", 2)]
    got = {tuple(r) for r in sessions.continuations(spark.createDataFrame(lines, "file string, session_id string, pos long")).collect()}
    assert got == {("s2", "s1", None), ("s2", "s4", None), ("s1", None, "s2"), ("s4", None, "s2")}
