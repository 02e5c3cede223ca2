import os
import time
from collections import Counter

import pytest

from tarnfield.operators import generators as G
from tarnfield.operators import responders as R
from tarnfield.sources import library as L
from tarnfield.sources import writer as W
from tarnfield.sources.responses import ResponseFolder

CALLS = "call_id string, request_hash string, provider string, prompt string"


def test_retries_wait_longer_each_time():
    waits, left = [], [R.Retryable("busy"), R.Retryable("busy", 7.0), R.Retryable("busy")]

    class Flaky(R.MockResponder):
        def respond(self, call):
            if left:
                raise left.pop(0)
            return super().respond(call)

    got = R.attempt(Flaky(), {"prompt": "a b"}, waits.append)
    assert got["ok"] and got["attempts"] == 4 and waits == [1.0, 7.0, 4.0]


def test_final_errors_are_recorded_once():
    class Broken(R.MockResponder):
        def respond(self, call):
            raise RuntimeError("bad key")

    got = R.attempt(Broken(), {"prompt": "a"}, lambda s: None)
    assert (got["ok"], got["attempts"], got["error"]) == (False, 1, "bad key")


def test_equal_requests_are_sent_once(spark):
    planned = spark.createDataFrame([("a", "h1", "p", "x y"), ("b", "h1", "p", "x y"), ("c", "h2", "p", "z"), ("d", "h3", "q", "w")], CALLS)
    done = spark.createDataFrame([("d", "h3")], "call_id string, request_hash string")
    got = {r.call_id: r.text for r in R.run(planned, done, R.MockResponder).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == got["b"] != got["c"]


def test_a_bad_call_stops_all(spark):
    planned = spark.createDataFrame([("a", "h1", "p", "x"), ("b", "h2", "p", "")], CALLS)
    with pytest.raises(ValueError, match="call b"):
        R.answered(planned, R.MockResponder)


def test_budget(spark):
    e = spark.createDataFrame([(1.5,), (2.0,)], "cost_high double")
    assert R.check_budget(e, 4.0) == 3.5
    for rows, limit in (([(1.5,), (2.0,)], 3.0), ([(1.0,), (None,)], 9.0)):
        with pytest.raises(ValueError):
            R.check_budget(spark.createDataFrame(rows, "cost_high double"), limit)


def test_tasks_are_seeded_and_distinct():
    for f in G.FAMILIES:
        a = G.build(f, 12, 3)
        assert a == G.build(f, 12, 3) and len({t.prompt for t in a}) == 12


def test_ledgers_and_puzzles_solve_again():
    for t in G.build("state_tracking", 10):
        north = int(t.prompt.split("North starts with ")[1].split(" ")[0])
        for move in t.prompt.split(". ")[1:-1]:
            n, way = int(move.split(" ")[0]), move.rstrip(".").rsplit(" ", 3)[-3:]
            north += n if way[-1] == "north" else -n
        assert str(north) == t.answer
    for t in G.build("puzzle", 5):
        people = sorted(t.answer.split(", "))
        clues = t.prompt.split("line. ")[1].split(". Who")[0].split(". ")

        def holds(order, clue):
            w = clue.split(" ")
            if "not" in w:
                return order.index(w[0]) != int(w[-1]) - 1
            gap = order.index(w[-1]) - order.index(w[0])
            return gap == 1 if "right" in w else gap > 0

        from itertools import permutations

        ok = [p for p in permutations(people) if all(holds(p, c) for c in clues)]
        assert [", ".join(p) for p in ok] == [t.answer]


def test_fact_grid(spark):
    g = G.fact_grid(spark, [100, 200], [0, 50, 100], 6)
    assert g.count() == 36 and g.select("code").distinct().count() == g.select("value").distinct().count() == 6


def test_written_documents_read_back(spark, tmp_path):
    d = spark.createDataFrame([("d1", 1, "T", "article", ["x"], "public", "current", None, None, None, None, "body é\n")], L.DOCUMENT)
    manifest = W.write_documents(d, f"file://{tmp_path}/lib")
    rows = manifest.collect()
    back = L.read_documents(spark, f"{tmp_path}/lib")
    assert L.library_problems(back, spark.createDataFrame(rows)).count() == 0
    assert back.first().body == "body é\n" and back.first().products == ["x"]


def test_passes_accumulate(spark):
    r = spark.createDataFrame([("r1", "2024-01-01", None), ("r1", "2024-01-03", "e")], "run_id string, recorded_utc string, error string")
    one = W.run_passes(r)
    two = W.run_passes(r.limit(0).union(spark.createDataFrame([("r2", "2024-02-01", None)], r.schema)), one)
    assert {(x.run_id, x.started, x.finished, x.calls, x.failures) for x in two.collect()} == {("r1", "2024-01-01", "2024-01-03", 2, 1), ("r2", "2024-02-01", "2024-02-01", 1, 0)}


def counting(folder, dies_at=None):
    """Makes a responder that notes each call it sends, and dies once at a given prompt. Workers get its class by value."""

    class Counting(R.MockResponder):
        def respond(self, call):
            with open(f"{folder}/sent", "a") as f:
                f.write(f"{call['request_hash']} {time.time()}\n")
            if call["prompt"] == dies_at and not os.path.exists(f"{folder}/died"):
                open(f"{folder}/died", "w").close()
                os._exit(1)
            if call["prompt"] == "p3":
                raise RuntimeError("refused")
            return super().respond(call)

    return Counting


def sent(tmp_path):
    return [line.split()[0] for line in (tmp_path / "sent").read_text().splitlines()]


def test_a_killed_task_sends_nothing_twice(spark, tmp_path):
    calls = [(f"c{i}", f"h{i % 12}", "p", f"p{i % 12}") for i in range(24)]
    planned = spark.createDataFrame(calls, "call_id string, request_hash string, provider string, prompt string")
    done = spark.createDataFrame([], R.RECORD)
    folder = ResponseFolder(f"file://{tmp_path}/responses", "run1")
    where = str(tmp_path)
    with pytest.raises(Exception, match="(?i)worker|python|exit"):
        R.run(planned, done, counting(where, "p7"), folder=folder).collect()
    before = sent(tmp_path)
    got = R.run(planned, done, counting(where, "p7"), folder=folder).collect()
    after = sent(tmp_path)
    assert sorted(r.call_id for r in got) == sorted(c for c, *_ in calls)
    assert {r.request_hash for r in got if not r.ok} == {"h3"}
    # only the request that was under way when the worker died went out again
    assert len(before) < 12 and Counter(after) == Counter({f"h{i}": 1 for i in range(12)}) + Counter(["h7"])
    again = R.run(planned, done, counting(where), folder=folder).collect()
    assert len(again) == 24 and sent(tmp_path) == after
    other = R.run(planned, done, counting(where), folder=ResponseFolder(folder.uri, "run2")).collect()
    assert len(other) == 24 and sent(tmp_path)[len(after) :] == ["h3"]  # a later run tries failures again


def test_lanes_keep_to_their_slots(spark, tmp_path):
    planned = spark.createDataFrame([(f"c{i:02}", f"h{i}", "p", f"q{i}") for i in range(12)], "call_id string, request_hash string, provider string, prompt string")
    where = str(tmp_path)
    R.answered(planned, counting(where), lanes=3, interval=0.1).collect()
    at = sorted(float(line.split()[1]) for line in (tmp_path / "sent").read_text().splitlines())
    assert at[-1] - at[0] > 0.1 * (12 - 3) * 0.9
    # no more than the lanes' share in any stretch of time
    assert all(at[i + 6] - at[i] > 0.25 for i in range(len(at) - 6))
