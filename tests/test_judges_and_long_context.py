import json

import pytest
from pyspark.sql import functions as F

from tarnfield.plans import condition as R
from tarnfield.plans import judging as J
from tarnfield.plans import longcontext as L
from tarnfield.plans import pipeline as P
from tarnfield.sources.itemlog import read_condition
from tarnfield.sources.responses import ResponseFolder

DOCS = [
    ("POL-1", "Rules", "  Lamps are red.\n", "public", "current"), ("A-1", "Boats", "Boats leave at nine.", "public", "current"), ("A-0", None, None, "public", "current"),
    ("A-2", "Keys", "The key is at the office.", "staff", "current"), ("A-3", "Old", "Lamps were green.", "public", "superseded"),
]
ITEMS = [
    (1, "fact", "public", True, "what colour are lamps", "red", ["red"], None), (2, "fact", "public", True, "when do boats leave", "nine", ["nine", "o'clock"], "user: hello"),
    (3, "none", "public", False, "who built the pier {library x}", None, None, ""), (4, "fact", "public", True, "when do boats sail", "nine", [], None),
]
VERDICT = "item_id string, verdict struct<declined:boolean,correct:boolean,faithful:boolean>"


def tables(spark):
    return (
        spark.createDataFrame(DOCS, "doc_key string, title string, text string, access string, status string"),
        spark.createDataFrame(ITEMS, "item_id long, type string, asker string, answerable boolean, question string, answer string, key_values array<string>, history string"),
    )


def reading():
    """Makes a model that answers from what it was given; within a function, as tasks can't import this module."""

    class Reader:
        def validate(self, call):
            if "{library" in call["prompt"].split("Question: ")[0]:
                raise ValueError("the library is not there")

        def respond(self, call):
            prompt = call["prompt"]
            if prompt.startswith("Decide"):
                told = "the whole library" in prompt and "Lamps" not in prompt.split("Question: ")[0]
                text = json.dumps({"declined": False, "correct": told and "sail" not in prompt, "faithful": True, "reason": "r"}) if "who built" not in prompt else "no object"
            else:
                text = "red" if "Lamps are red." in prompt and "colour" in prompt else "nine" if "at nine" in prompt and "boats" in prompt else "I can't tell"
            return {"text": text, "input_tokens": len(prompt), "output_tokens": 1}

    return Reader


def test_the_library_is_whole_and_in_order(spark):
    docs, _ = tables(spark)
    got = L.packed(docs.repartition(4), 200, F.col("doc_key").startswith("POL"))
    assert got.text == "[Document: Rules (POL-1)]\nLamps are red.\n\n[Document:  (A-0)]\n\n\n[Document: Boats (A-1)]\nBoats leave at nine." and got.documents == 3 and 0 < got.tokens < 200
    with pytest.raises(ValueError, match="tokens, a prompt may have 5"):
        L.packed(docs, 5)
    none = L.packed(docs.limit(0), 5)
    assert (none.text, none.tokens, none.documents) == ("", 0, 0) and none.mark != got.mark


def test_items_are_asked_with_the_whole_library(spark, tmp_path):
    docs, items = tables(spark)
    folder = ResponseFolder((tmp_path / "answers").as_uri(), "run")
    run = lambda d: L.run(d, items, "long", str(tmp_path), R.Model("p", "m"), reading(), 200, folder=folder, first=F.col("doc_key").startswith("POL")).first()
    told = run(docs)
    rows = {r["item_id"]: r for r in map(json.loads, (line for f in sorted((tmp_path / "long" / "log.jsonl").glob("part-*")) for line in f.read_text().splitlines()))}
    assert sorted(rows) == ["1", "2", "3", "4"] and (told["items"], told.answered, told.judged, told.documents) == (4, 4, 3, 3)
    assert rows["1"]["answer"]["text"] == "red" and rows["1"]["code_check"] is True and rows["1"]["verdict"]["correct"]
    assert rows["2"]["answer"]["text"] == "nine" and rows["2"]["code_check"] is False
    assert rows["3"]["verdict"] is None and rows["3"]["judge_error"] and rows["3"]["code_check"] is None
    assert rows["4"]["code_check"] is None and rows["4"]["verdict"]["correct"] is False
    assert told.input_tokens > 4 * 60  # the library was read with every item
    # a library that changed is asked about anew, though the answers of the first are in the folder
    run(docs.withColumn("text", F.replace("text", F.lit("nine"), F.lit("ten"))))
    log = spark.read.json(f"{tmp_path}/long/log.jsonl")
    assert log.where("item_id = '2'").first().answer.text == "I can't tell"
    assert {r.item_id for r in L.of_each_type(items, 1).collect()} == {1, 3}


def test_a_second_judge_reads_what_the_first_one_read(spark, tmp_path):
    _, items = tables(spark)
    docs = spark.createDataFrame([(i, k, t, x, a, s) for i, (k, t, x, a, s) in enumerate(DOCS) if x], "doc_id long, doc_key string, title string, text string, access string, status string")
    spans = spark.createDataFrame([(1, "evidence", 0, 2, 8)], "item_id long, kind string, doc_id long, start long, stop long")
    spec = P.Spec(P.Chunker("whole"), P.Search(depth=4), prompt=P.Prompt(2, "reverse"))
    R.run_condition(docs, items, spans, spec, "one", str(tmp_path), R.Model("p", "m"), make=reading())
    log, _ = read_condition(spark, str(tmp_path), "one")
    stages = P.run(docs, items, spec)
    answers = log.select(F.col("item_id").cast("long").alias("item_id"), F.col("answer").alias("call"))
    want = {str(r.item_id): r.prompt for r in R.judge_prompts(items, stages, answers).collect()}
    again = J.prompts_again(log, log.select("item_id"), stages["chunks"], items)
    assert {r.item_id: r.prompt for r in again.collect()} == want and len(want) == 4
    sample = J.drawn(log, 2, seed=3)
    assert sample.count() == 2 and sample.collect() == J.drawn(log.repartition(5), 2, seed=3).collect() and J.drawn(log, 99).count() == 3
    second = J.second_judge(again, R.Model("q", "other"), reading())
    got = {r.item_id: r for r in second.collect()}
    assert set(got) == {"1", "2", "3", "4"} and got["3"].verdict is None and got["3"].error == "the reply holds no verdict" and got["1"].error is None
    one = J.two_judges(log, second).first()
    assert one.both == 3 and one.agree["correct"]["count"] == 3 and one.first_right == one.second_right
    with pytest.raises(Exception, match="the library has no passage"):
        J.prompts_again(log, log, stages["chunks"].where("doc_id <> 0"), items).collect()


def test_a_judge_may_take_the_others_place(spark):
    make = lambda rows: spark.createDataFrame(rows, VERDICT)
    sample = spark.createDataFrame([(str(i), "a" if i < 20 else "b") for i in range(30)] + [("0", "a")], "item_id string, type string")
    old = make([(str(i), (False, True, True)) for i in range(30)])
    new = make([(str(i), (False, i not in (0, 1, 20, 21), i % 2 == 0)) for i in range(30)])
    hand = make([(str(i), (None, True, None)) for i in range(5)] + [("25", (True, True, None)), ("26", None)])
    got = {r.type: r for r in J.switch_report(sample, old, new, hand, by=("type",), least_hand=0.6).collect()}
    assert got["a"].passed and got["a"]["items"] == 20 and got["a"].old_correct["count"] == 18 and (got["a"].hand_correct["count"], got["a"].hand_correct["total"]) == (3, 5) and got["a"].hand_declined["total"] == 0
    assert not got["b"].passed and got["b"].old_correct["count"] == 8 and got["b"].hand_correct["total"] == 1 and got["b"].hand_declined["count"] == 0
    assert not J.switch_report(sample, old, new.where("item_id <> '5'"), hand, by=("type",), least_hand=0.6).where("type = 'a'").first().passed
    nobody = J.switch_report(sample.limit(0), old, new, hand).first()
    assert nobody["items"] == 0 and not nobody.passed
    fields = {r.field: r.agree for r in J.agreement(old, hand).collect()}
    assert fields["correct"]["count"] == fields["correct"]["total"] == 6 and fields["faithful"]["total"] == 0


def test_arms_are_compared_on_what_both_measure(spark):
    schema = "item_id string, type string, verdict struct<correct:boolean>, code_check boolean"
    long = spark.createDataFrame([(str(i), "t", (True,) if i < 8 else None, i < 5 if i < 9 else None) for i in range(10)], schema)
    other = spark.createDataFrame([(str(i), "t", (i >= 6,), True) for i in range(12)], schema)
    r = L.against(long, other).first()
    assert r["items"] == 10 and (r.judge_long["count"], r.judge_long["total"], r.judge_retrieval["count"], r.judge_gained, r.judge_lost) == (8, 8, 2, 6, 0) and abs(r.judge_p - 2 / 64) < 1e-9
    assert (r.code_long["count"], r.code_long["total"], r.code_gained, r.code_lost) == (5, 9, 0, 4) and L.against(long.limit(0), other).count() == 0
