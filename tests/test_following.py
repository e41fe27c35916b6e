"""Logs that grow, shrink, move and go, followed between runs, give the tables of a full read."""

import json
import os
from collections import Counter

from pyspark.sql import functions as F

from tracemill import sources
from tracemill.streaming import following as Fo


def line(k, s="s", role="user"):
    return json.dumps({"type": role, "uuid": f"{s}-{k}", "sessionId": s, "timestamp": f"2024-05-01T10:00:{k % 60:02d}Z", "message": {"role": role, "content": f"text {k} é"}}) + "\n"


def tables(p):
    return {t: Counter(map(str, getattr(p, t).drop("pos", "created_at").collect())) for t in ("sessions", "steps", "calls", "results", "rejected")}


def same(spark, logs, store):
    got, want = tables(sources.read(spark, "claude", store)), tables(sources.read(spark, "claude", logs))
    assert got == want
    return got


def add(path, text, mode="a"):
    with open(path, mode) as f:
        f.write(text)


def test_runs_between_changes_equal_a_full_read(spark, tmp_path):
    logs, store = str(tmp_path / "logs (1) é dir"), str(tmp_path / "store")
    os.makedirs(f"{logs}/deep")
    a, b, c = f"{logs}/a.jsonl", f"{logs}/deep/b.jsonl", f"{logs}/c.jsonl"
    for f, s in ((a, "a"), (b, "b"), (c, "c")):
        add(f, "".join(line(k, s, ["user", "assistant"][k % 2]) for k in range(40)))
    add(a, "no json\n")
    Fo.follow(spark, logs, store, piece=700)
    assert sum(same(spark, logs, store)["steps"].values()) == 120
    first = Fo.last_batch(spark, store)
    # One grows, one is cut to fewer lines, one is renamed, one comes, and a half line waits.
    add(a, line(41, "a"))
    half = line(42, "a")
    add(a, half[:30])
    add(b, "".join(line(k, "b") for k in range(50, 55)), "w")
    os.rename(c, f"{logs}/moved.jsonl")
    add(f"{logs}/new.jsonl", line(1, "n"))
    Fo.follow(spark, logs, store, piece=700)
    lines = Fo.current_lines(spark, store)
    assert {r[0].rsplit("/", 1)[1]: r[1] for r in lines.groupBy("file").agg(F.count("*")).collect()} == {"a.jsonl": 42, "b.jsonl": 5, "moved.jsonl": 40, "new.jsonl": 1}
    assert {r.file.rsplit("/", 1)[1]: r.kind for r in Fo.touched(spark, store, first).collect()} == {"a.jsonl": "changed", "b.jsonl": "changed", "c.jsonl": "removed", "moved.jsonl": "changed", "new.jsonl": "changed"}
    # Only what was appended of a.jsonl came with the second run.
    second = spark.read.parquet(f"{store}/lines").where(f"batch_number > {first} and file like '%/a.jsonl'")
    assert second.count() == 1
    # The line is finished, a file goes, another is written over with as many bytes, one comes back.
    add(a, half[30:])
    os.remove(f"{logs}/new.jsonl")
    add(b, "".join(line(k, "B") for k in range(50, 55)), "w")
    add(c, line(9, "c2"))
    Fo.follow(spark, logs, store)
    same(spark, logs, store)
    assert Fo.current_lines(spark, store).where("line like '%text 42%'").count() == 1
    n = Fo.last_batch(spark, store)
    Fo.follow(spark, logs, store)
    assert Fo.last_batch(spark, store) == n or Fo.touched(spark, store, n).isEmpty()
    same(spark, logs, store)


def test_pieces_hold_every_line_once(tmp_path):
    f = str(tmp_path / "x.jsonl")
    text = "".join("é" * (k % 9) + f"{k}\r\n" for k in range(300)) + "half"
    add(f, text)
    end = Fo.end_of_lines(f)
    assert end == len(text.encode()) - 4
    want = text.split("\r\n")[:-1]
    for most in (1, 2, 7, 100, 10**6):
        parts = Fo.pieces({}, {f: [end, 0]}, most)
        got = sorted(x for p in parts for r in p.ranges for x in Fo.lines_of(*r))
        assert [t for _, t in got] == want
    assert Fo.end_of_lines(os.devnull) == 0 and list(Fo.lines_of(str(tmp_path / "gone"), 0, 9)) == []


def test_a_line_longer_than_what_is_read_at_a_time(tmp_path):
    f = str(tmp_path / "x.jsonl")
    add(f, "a\n" + "b" * (3 * Fo.BACK))
    assert Fo.end_of_lines(f) == 2
    add(f, "\n")
    assert Fo.end_of_lines(f) == 3 * Fo.BACK + 3


def test_stamps_tell_growth_from_change(tmp_path):
    f = str(tmp_path / "x")
    add(f, "one\ntwo\n")
    start = {f: [8, Fo.stamp(f, 8)]}
    add(f, "three\n")
    assert Fo.pieces(start, {f: [14, 0]}) == [Fo.Pieces([(f, 8, 14)], [])]
    add(f, "One\ntwo\nthree\n", "w")
    assert Fo.pieces(start, {f: [14, 0]}) == [Fo.Pieces([(f, 0, 14)], [(f, "reset")])]
    assert Fo.pieces(start, {}) == [Fo.Pieces([], [(f, "removed")])]
