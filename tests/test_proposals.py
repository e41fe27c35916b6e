"""New texts and edits by injected backends, and edits against a plain version."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import proposals


def plain_edits(text, edits):
    text, done, refused = text or "", 0, []
    for e in edits or []:
        old, new = e[0] or "", e[1] or ""
        if not old:
            text, done = text + new, done + 1
        elif sum(text.startswith(old, i) for i in range(len(text))) == 1:
            text, done = text.replace(old, new), done + 1
        else:
            refused.append((old, new))
    return text, done, refused


def test_edits_match_the_plain_rule(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("ab\n%é") for _ in range(n))
    rows = [(i, r.choice([None, "", word(8), word(30)]), r.choice([None, [], [(r.choice([None, "", word(1), word(2), word(3)]), r.choice([None, "", word(2)])) for _ in range(5)]])) for i in range(300)] + [(999, "aaa", [("aa", "b")])]
    df = spark.createDataFrame(rows, f"id int, text string, edits {proposals.EDITS}")
    got = {x.id: x.r for x in df.select("id", proposals.edited(F.col("text"), F.col("edits")).alias("r")).collect()}
    for i, text, edits in rows:
        assert (got[i].text, got[i].applied, [tuple(x) for x in got[i].refused]) == plain_edits(text, edits)


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [(f"s{i}", "p" if i < 3 else "q", dt.datetime(2025, 1, 1 + i)) for i in range(6)]
    contexts = [(f"s{i}" + ("_part2" if i == 4 else ""), f"[step_id=0] USER: text {i}" + (" fail" if i == 5 else "") + " " * 60) for i in range(6)]
    s = spark.createDataFrame(rows + [("s4_part2", "q", rows[4][2])], "session_id string, project string, created_at timestamp")
    return spark.createDataFrame(contexts, "session_id string, context string"), s


@pytest.fixture
def ideas():
    def propose(text):
        if "fail" in text:
            raise ValueError("no batch")
        n = sum(f"text {i}" in text for i in range(3))
        return json.dumps([{"name": "tidy", "confidence": 0.5 + n / 10, "rationale": f"r{n}", "session_ids": ["s1", "s4", "s9"]}, {"name": "lost", "confidence": 7, "session_ids": ["zz"]}, {"name": " "}, {"name": "bad", "confidence": 0.1, "session_ids": None}])

    return propose  # defined here, so that tasks get it by value


def test_new_texts(spark, sessions, ideas):
    def write(text):
        head, rest = text.split("\n\n", 1)
        if json.loads(head)["name"] == "bad":
            raise ValueError("no text")
        return "```\n" + json.loads(head)["name"] + ":" + ",".join(w for w in rest.split() if w.isdigit()) + "\n```"

    got = {r.name: r for r in proposals.create(*sessions, ideas, write, budget=60).collect()}
    assert got["tidy"].content == "tidy:1,4" and got["tidy"].ok and not got["bad"].ok and "no text" in got["bad"].error
    assert got["lost"].confidence == 1.0 and got["lost"].content.startswith("lost:0,1") and len(got) == 3
    top = proposals.create(*sessions, ideas, write, budget=60, most=1).collect()
    assert [r.name for r in top] == ["lost"]

    def never(text):
        raise ValueError("down")

    with pytest.raises(RuntimeError):
        proposals.create(*sessions, never, write)
    assert proposals.create(sessions[0].limit(0), sessions[1], never, write).count() == 0


def test_changed_texts(spark, sessions, ideas):
    def write(text):
        assert "Use tabs." in text or "other" in text
        return json.dumps([{"old": "tabs", "new": "spaces"}, {"old": "e", "new": ""}, {"old": "", "new": " End."}]) if "tidy" in text else "sorry"

    installed = spark.createDataFrame([("tidy", "Use tabs."), ("bad", "other"), ("unused", "x")], "name string, text string")
    got = {r.name: r for r in proposals.evolve(*sessions, installed, ideas, write, budget=60).collect()}
    assert set(got) == {"tidy", "bad"} and got["tidy"].text == "Use spaces. End." and got["tidy"].applied == 2
    assert [tuple(x) for x in got["tidy"].refused] == [("e", "")] and not got["bad"].ok and got["bad"].text == "other" and got["bad"].error
