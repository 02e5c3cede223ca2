"""Typed configurations from YAML: rules, cases, prices, capabilities and episodes. What is wrong is told all at once."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tarnfield.plans import pipeline as P
from tarnfield.sources.library import LibraryError, read_yaml


def _checked(path: str, problems: list[str]) -> None:
    if problems:
        raise LibraryError(f"{path}: " + "; ".join(problems))


@dataclass(frozen=True)
class Rule:
    """Gates, criteria and weights that candidates are scored by."""

    name: str
    version: int
    gates: tuple[str, ...]
    criteria: tuple[str, ...]
    weights: dict[str, float]
    sensitivity: dict[str, Any] = field(default_factory=dict)
    stop_criteria: tuple[str, ...] = ()


def load_rule(path: str) -> Rule:
    raw = read_yaml(path)
    ids = lambda key: tuple(x["id"] if isinstance(x, dict) else x for x in raw.get(key) or ())
    rule = Rule(raw.get("name", ""), int(raw.get("version", 0)), ids("gates"), ids("criteria"), raw.get("weights") or {}, raw.get("sensitivity") or {}, tuple(raw.get("stop_criteria") or ()))
    problems = [f"no {k}" for k in ("gates", "criteria") if not getattr(rule, k)]
    named = {"weights": rule.weights} | {f"sensitivity.{k}": v for k, v in rule.sensitivity.items() if isinstance(v, dict)}
    for name, weights in named.items():
        if set(weights) != set(rule.criteria):
            problems.append(f"{name} must weigh each criterion")
        elif min(weights.values(), default=-1) < 0 or sum(weights.values()) <= 0:
            problems.append(f"{name} must not be negative or all zero")
    if set(rule.weights) == set(rule.criteria) and abs(sum(rule.weights.values()) - 1) > 1e-9:
        problems.append("weights must add up to 1")
    _checked(path, problems)
    return rule


def load_case(spark: SparkSession, folder: str, rule: Rule) -> DataFrame:
    """id, name, gates_passed, redirect and a column for each criterion, from candidates.yaml and scores.yaml, checked against the rule."""
    candidates = read_yaml(f"{folder}/candidates.yaml").get("candidates") or []
    scored = read_yaml(f"{folder}/scores.yaml").get("candidates") or {}
    problems, rows = [], []
    if {c["id"] for c in candidates} != set(scored):
        problems.append("candidates and scored candidates differ")
    for c in candidates:
        s = scored.get(c["id"], {})
        gates = {k: v["result"] if isinstance(v, dict) else v for k, v in (s.get("gates") or {}).items()}
        got, failed = s.get("scores") or {}, "fail" in gates.values()
        problems += [f"{c['id']}: every gate must be given"] * (set(gates) != set(rule.gates))
        problems += [f"{c['id']}: unknown criteria"] * bool(set(got) - set(rule.criteria))
        problems += [f"{c['id']}: fails a gate without a redirect"] * (failed and not s.get("redirect"))
        problems += [f"{c['id']}: not scored on every criterion"] * (not failed and set(got) != set(rule.criteria))
        value = lambda x: float(x["score"] if isinstance(x, dict) else x)
        rows.append((str(c["id"]), c.get("name"), not failed, s.get("redirect"), *(value(got[k]) if k in got else None for k in rule.criteria)))
    _checked(folder, problems)
    return spark.createDataFrame(rows, "id string, name string, gates_passed boolean, redirect string, " + ", ".join(f"`{k}` double" for k in rule.criteria))


def load_prices(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float | None]] | None:
    """(provider, model, price_in, price_out) per million tokens and the budgets; None without a file, null without a price."""
    if not os.path.exists(path):
        return None
    raw = read_yaml(path)
    budgets = raw.get("budgets") or {}
    _checked(path, [f"the budget of {k} is negative" for k, v in budgets.items() if v is not None and v < 0])
    number = lambda x: None if x is None else float(x)
    rows = [(p, m, number((x or {}).get("input")), number((x or {}).get("output"))) for p, models in (raw.get("prices") or {}).items() for m, x in models.items()]
    return spark.createDataFrame(rows, "provider string, model string, price_in double, price_out double"), budgets


def load_capabilities(spark: SparkSession, path: str) -> DataFrame:
    """provider, model, reasoning (levels), temperature, max_output_tokens. The level "off" stays text, as read_yaml reads it."""
    rows = [(p, m, [str(x) for x in s.get("reasoning") or []], bool(s["temperature"]), s.get("max_output_tokens")) for p, models in read_yaml(path).items() for m, s in models.items()]
    _checked(path, [f"{m}: max_output_tokens must be positive" for _, m, _, _, n in rows if n is not None and n <= 0])
    return spark.createDataFrame(rows, "provider string, model string, reasoning array<string>, temperature boolean, max_output_tokens long")


_BLOCKS = {"chunker": P.Chunker, "search": P.Search, "filter": P.Filter, "rerank": P.Rerank, "prompt": P.Prompt}


def load_spec(path: str) -> P.Spec:
    """A pipeline's settings, a block for each stage that differs from the defaults."""
    raw = read_yaml(path)
    _checked(path, [f"unknown stage {k}" for k in raw if k not in {*_BLOCKS, "rewrite"}])
    try:
        return P.Spec(**{k: _BLOCKS[k](**v) if k in _BLOCKS else v for k, v in raw.items()})
    except TypeError as e:
        raise LibraryError(f"{path}: {e}") from e


@dataclass(frozen=True)
class Condition:
    name: str
    spec: P.Spec
    measure: str = "full"  # search stops when the prompt is built


def load_episode(path: str) -> tuple[P.Spec, list[Condition]]:
    """The base pipeline that an episode names and its conditions, each of which changes one stage."""
    raw = read_yaml(path)
    base = load_spec(os.path.join(os.path.dirname(path), raw["base"]))
    conditions = raw.get("conditions") or []
    names = [c["name"] for c in conditions]
    problems = ["no conditions"] * (not conditions) + ["condition names must be unique"] * (len(set(names)) < len(names))
    problems += [f"{c['name']}: measure is search or full" for c in conditions if c.get("measure", "full") not in ("search", "full")]
    out = []
    for c in conditions:
        try:
            out.append(Condition(c["name"], base.changed(**(c.get("changes") or {})), c.get("measure", "full")))
        except (ValueError, TypeError) as e:
            problems.append(f"{c['name']}: {e}")
    _checked(path, problems)
    return base, out


@dataclass(frozen=True)
class Experiment:
    """What an experiment runs apart from its models: calls are of `parameters`, a pilot is a part of them."""

    experiment: str
    seed: int
    description: str = ""
    parameters: dict[str, Any] = field(default_factory=dict)
    limits: dict[str, dict[str, int]] = field(default_factory=dict)
    pilot: dict[str, Any] = field(default_factory=lambda: {"strategy": "stratified"})
    call_order: str = "planned"
    measures_latency: bool = True

    def limits_for(self, provider: str) -> dict[str, int]:
        """max_concurrency and requests_per_minute, cautious where the file says nothing."""
        return {"max_concurrency": 2, "requests_per_minute": 30} | self.limits.get(provider, {})


_NAME = re.compile(r"[a-z0-9][a-z0-9-]*")


def _whole(x: Any, low: int, high: float = float("inf")) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and low <= x <= high


def _pilot_problems(p: dict[str, Any]) -> list[str]:
    if p.get("strategy") == "stratified":
        share = p.get("fraction", 0.05)
        bad = isinstance(share, bool) or not isinstance(share, (int, float)) or not 0 < share <= 1
        return ["the pilot's fraction must be within (0, 1]"] * bad + [f"unknown in the pilot: {k}" for k in p if k not in ("strategy", "fraction", "strata")]
    if p.get("strategy") == "filter":
        rules = p.get("include") or []
        return ["the pilot includes nothing"] * (not rules) + ["a pilot's rule needs a key"] * any(not r for r in rules) + [f"unknown in the pilot: {k}" for k in p if k not in ("strategy", "include")]
    return ["the pilot's strategy is stratified or filter"]


def load_experiment(spark: SparkSession, path: str) -> tuple[Experiment, DataFrame]:
    """The settings and a row for each mode of each model: provider, model, label, mode, reasoning, temperature, max_output_tokens, show_thinking.

    Reasoning and temperature must be stated, if only as null. Labels (the model's name without one) must be unique.
    """
    raw = dict(read_yaml(path))
    models = raw.pop("models", None) or []
    known = {f.name for f in fields(Experiment)}
    problems = [f"unknown: {k}" for k in raw if k not in known] + [f"no {k}" for k in ("experiment", "seed") if k not in raw] + ["no models"] * (not models)
    problems += ["the name may have small letters, digits and hyphens"] * ("experiment" in raw and not _NAME.fullmatch(str(raw["experiment"])))
    problems += ["the seed must be a whole number"] * ("seed" in raw and not _whole(raw["seed"], -(2**63)))
    problems += ["call_order is planned or shuffled"] * (raw.get("call_order", "planned") not in ("planned", "shuffled"))
    problems += _pilot_problems(raw.get("pilot") or {"strategy": "stratified"})
    for provider, limit in (raw.get("limits") or {}).items():
        problems += [f"{provider}: unknown limit {k}" for k in limit if k not in ("max_concurrency", "requests_per_minute")]
        problems += [f"{provider}: max_concurrency must be 1 to 32"] * (not _whole(limit.get("max_concurrency", 2), 1, 32)) + [f"{provider}: requests_per_minute must be positive"] * (not _whole(limit.get("requests_per_minute", 30), 1))
    rows, labels = [], [m.get("label") or m.get("model") for m in models]
    problems += [f"the label {x} is not unique" for x in sorted({x for x in labels if x and labels.count(x) > 1})]
    for m, label in zip(models, labels, strict=True):
        problems += [f"{label}: no {k}" for k in ("provider", "model", "modes") if not m.get(k)] + [f"{label}: unknown {k}" for k in m if k not in ("provider", "model", "label", "modes")]
        for mode, s in (m.get("modes") or {}).items():
            problems += [f"{label} {mode}: {k} must be stated" for k in ("reasoning", "temperature") if k not in s] + [f"{label} {mode}: unknown {k}" for k in s if k not in ("reasoning", "temperature", "max_output_tokens", "show_thinking")]
            problems += [f"{label} {mode}: max_output_tokens must be positive"] * (not _whole(s.get("max_output_tokens"), 1))
            heat = s.get("temperature")
            rows.append((m.get("provider"), m.get("model"), label, str(mode), s.get("reasoning"), None if heat is None else float(heat), s.get("max_output_tokens"), bool(s.get("show_thinking", False))))
    _checked(path, problems)
    modes = spark.createDataFrame(rows, "provider string, model string, label string, mode string, reasoning string, temperature double, max_output_tokens long, show_thinking boolean")
    return Experiment(**{k: v for k, v in raw.items() if v is not None}), modes
