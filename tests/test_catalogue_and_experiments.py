import pytest
import yaml
from pyspark.sql import functions as F

from tarnfield.operators import corpus_build as B
from tarnfield.sources import catalogue as C
from tarnfield.sources import configs
from tarnfield.sources.library import LibraryError


def _yaml(path, data):
    path.write_text(yaml.safe_dump(data))
    return str(path)


MODEL = {"provider": "a", "model": "m", "modes": {"off": {"reasoning": "off", "temperature": 0, "max_output_tokens": 9}, "high": {"reasoning": "high", "temperature": None, "max_output_tokens": 99, "show_thinking": True}}}


def test_experiments_are_typed_and_checked(spark, tmp_path):
    path = tmp_path / "e.yaml"
    path.write_text("experiment: e-1\nseed: 3\nlimits: {a: {max_concurrency: 4}}\nmodels:\n- provider: a\n  model: m\n  modes:\n    off: {reasoning: off, temperature: 0, max_output_tokens: 9}\n    high: {reasoning: high, temperature: null, max_output_tokens: 99, show_thinking: true}\n")
    e, modes = configs.load_experiment(spark, str(path))
    assert (e.experiment, e.seed, e.call_order, e.measures_latency, e.pilot) == ("e-1", 3, "planned", True, {"strategy": "stratified"})
    assert e.limits_for("a") == {"max_concurrency": 4, "requests_per_minute": 30} and e.limits_for("b") == {"max_concurrency": 2, "requests_per_minute": 30}
    rows = {r.mode: r for r in modes.collect()}
    assert (rows["off"].reasoning, rows["off"].temperature, rows["off"].label) == ("off", 0.0, "m") and rows["high"].temperature is None and rows["high"].show_thinking
    good = {"experiment": "e", "seed": 1, "models": [MODEL]}
    for change, said in [
        ({"experiment": "E 1"}, "small letters"), ({"models": []}, "no models"), ({"seed": "x"}, "whole number"), ({"models": [MODEL, MODEL]}, "label m is not unique"), ({"more": 1}, "unknown: more"), ({"call_order": "odd"}, "planned or shuffled"),
        ({"models": [MODEL | {"modes": {"x": {"reasoning": "off", "max_output_tokens": 0}}}]}, "temperature must be stated.*max_output_tokens must be positive"), ({"limits": {"a": {"max_concurrency": 33}}}, "1 to 32"),
        ({"pilot": {"strategy": "stratified", "fraction": 0}}, "fraction"), ({"pilot": {"strategy": "filter", "include": [{}]}}, "needs a key"), ({"pilot": {"strategy": "odd"}}, "stratified or filter"),
    ]:
        with pytest.raises(LibraryError, match=said):
            configs.load_experiment(spark, _yaml(tmp_path / "bad.yaml", good | change))


def catalogue():
    fee = {"id": "fee", "kind": "money", "range": [1, 30], "named": "The {entity} costs {value}.", "bare": "It costs {value}.", "lead": "The {entity} has a price.", "twin": "deposit"}
    deposit = {"id": "deposit", "kind": "money", "range": [1, 12], "named": "The {entity} takes {value} down.", "twin": "fee"}
    return {
        "company": "Acme", "products": [f"Lamp {x}" for x in "ABCDE"], "plans": ["Basic"], "regions": {"North": ["N1", "N2", "N3"], "South": ["S1"]},
        "kinds": {"money": "£{n}.00", "days": "{n} days", "batch": "B-{n}"}, "max_attempts": 3,
        "policies": [{
            "doc_id": "POL-1", "title": "Prices", "general": [{"heading": "All", "attributes": [{"id": "wait", "kind": "days", "range": [1, 3], "named": "Wait {value}."}]}],
            "product": [{"heading": "Fees", "attributes": [fee, deposit]}], "plan": [], "region": [{"heading": "Where", "attributes": [], "postcodes": "{entity} is {areas}."}],
        }],
        "internal": [{"doc_id": "INT-1", "title": "Staff", "heading": "Stock", "attributes": [{"id": "stock", "kind": "days", "range": [1, 20], "named": "{entity}: {value}."}]}],
        "deleted": {"sentence": "{accessory} {value} of the {entity} is withdrawn.", "accessories": ["Cable", "Plug"]}, "prompts": {"ask": "Ask {x} as {\"a\": 1}."},
    }


def test_a_catalogue_becomes_facts(spark, tmp_path):
    c = C.load_catalogue(spark, _yaml(tmp_path / "c.yaml", catalogue()))
    assert c.prompt("ask", x=1) == 'Ask 1 as {"a": 1}.' and c.attributes.count() == 4
    with pytest.raises(KeyError):
        c.prompt("ask", y=1)
    taken = spark.createDataFrame([("It was £5.00 and 2 days.",)], "text string")
    facts, held = B.fact_plan(c, taken, held=4, versions=3, deleted=2, seed=5)
    again, held2 = B.fact_plan(c, taken.repartition(3), held=4, versions=3, deleted=2, seed=5)
    rows = {r.fact_id: r for r in facts.collect()}
    assert rows == {r.fact_id: r for r in again.collect()} and held.orderBy("attribute", "entity").collect() == held2.orderBy("attribute", "entity").collect()
    gone = held.collect()
    assert len(gone) == 4 and all(f"{h.attribute}:{h.entity}" not in rows and "..." in h.blank and h.entity in h.blank for h in gone)
    assert max(sum(h.attribute == a for h in gone) for a in ("fee", "deposit")) <= 3
    assert len(rows) == 1 + 10 - 4 + 5 + 2 + 2 and rows["wait"].value in ("1 day", "3 days") and rows["wait"].entity is None
    values = [x for r in rows.values() if r.kind != "postcode" for x in (r.value, r.old_value) if x]
    assert len(values) == len(set(values)) and "£5.00" not in values and "2 days" not in values
    old = [r for r in rows.values() if r.old_value]
    assert len(old) == 3 and all(r.scope == "product" and r.old_value != r.value for r in old)
    for r in rows.values():
        if r.attribute == "fee":
            assert r.named == f"The {r.entity} costs {r.value}." and r.lead == f"The {r.entity} has a price." and r.twin == (f"deposit:{r.entity}" if f"deposit:{r.entity}" in rows else None)
    assert rows["postcodes:North"].named == "North is N1, N2 and N3." and rows["postcodes:South"].value == "S1"
    d = rows["DEL-01"]
    assert d.named == f"{d.accessory} {d.value} of the {d.entity} is withdrawn." and d.value.startswith("B-") and d.doc_id == "DEL-01"
    with pytest.raises(ValueError, match="7 facts are to be held out, 6 can be"):
        B.fact_plan(c, taken, held=7)
    plain, none = B.fact_plan(c, taken.limit(0))
    assert none.count() == 0 and plain.where("old_value is not null or scope = 'deleted'").count() == 0


def test_faulty_catalogues_are_told_all_at_once(spark, tmp_path):
    bad = catalogue()
    product = bad["policies"][0]["product"][0]["attributes"]
    product[0] |= {"twin": "wait", "range": [9, 2], "bare": "none", "lead": "{value}", "kind": "odd"}
    bad["internal"][0]["attributes"].append({"id": "fee", "kind": "days", "range": [1, 2], "named": "{value}"})
    bad["regions"]["South"] = ["N1"]
    with pytest.raises(LibraryError) as e:
        C.load_catalogue(spark, _yaml(tmp_path / "c.yaml", bad | {"max_attempts": 0}))
    for said in ("fee stands 2 times", "fee: its twin wait", "unknown kind odd", "backwards", "bare needs one", "lead must not", "N1 belongs", "max_attempts"):
        assert said in str(e.value)


def test_a_pilot_has_what_its_items_need(spark):
    items = spark.createDataFrame([("a-1", "a", "test", ["f1"], None, None), ("a-0", "a", "test", ["f2"], ["f3"], None), ("b-0", "b", "test", [], None, "f4"), ("a--", "a", "dev", ["f9"], None, None)], "item_id string, type string, split string, facts array<string>, distractors array<string>, first string")
    sections = spark.createDataFrame([("d", ["f1"]), ("d", ["f2", "f9"]), ("e", ["f3"]), ("e", None), ("g", ["f4"]), ("keep", []), ("h", ["f9"])], "doc_id string, fact_ids array<string>")
    some, kept = B.pilot_scope(items, sections, 1, ("keep",))
    assert {r.item_id for r in some.collect()} == {"a-0", "b-0"}
    assert sorted((r.doc_id, r.fact_ids) for r in kept.collect()) == [("d", ["f2", "f9"]), ("e", ["f3"]), ("g", ["f4"]), ("keep", [])]
    assert B.pilot_scope(items.limit(0), sections, 1)[1].count() == 0


def test_templates_take_values_that_look_like_templates(spark):
    row = spark.createDataFrame([("{value} and {entity}", "{entity}", None)], "t string, v string, e string")
    assert row.select(B.filled(F.col("t"), entity=F.col("e"), value=F.col("v")).alias("x")).first().x == "{entity} and "
