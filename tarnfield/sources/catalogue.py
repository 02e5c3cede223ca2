"""The catalogue that a library is built from: who and what there is, the families of facts and the templates of their sentences."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tarnfield.sources.library import LibraryError, read_yaml

SCOPES = ("general", "product", "plan", "region")
#: Kind and range of the values of deleted documents.
BATCH = ("batch", 1000, 9999)

ATTRIBUTES = "attribute string, doc_id string, title string, scope string, section int, heading string, kind string, low long, high long, named string, bare string, lead string, twin_of string"


@dataclass(frozen=True)
class Catalogue:
    """Tables of the catalogue; what else the file says is in `settings`.

    attributes: ATTRIBUTES, a row for each family of facts. entities: scope, place, entity (internal facts are of products; general ones have
    none). areas: region, place, area. kinds: kind, template, low, high (the widest range that asks for the kind).
    """

    attributes: DataFrame
    entities: DataFrame
    areas: DataFrame
    kinds: DataFrame
    settings: dict[str, Any]

    def prompt(self, name: str, **values: Any) -> str:
        return fill(self.settings["prompts"][name], **values)


def fill(template: str, **values: Any) -> str:
    """template with each {name} replaced; a name that it lacks is an error, other braces stay."""
    for name, value in values.items():
        if (mark := "{" + name + "}") not in template:
            raise KeyError(f"the template has no {mark}")
        template = template.replace(mark, str(value))
    return template


def _families(raw: dict[str, Any]) -> list[tuple[dict, dict, str, int, str | None]]:
    """(attribute, document, scope, section's place, heading) in the order of the file."""
    out = []
    for policy in raw.get("policies") or []:
        for scope in SCOPES:
            for n, section in enumerate(policy.get(scope) or []):
                out += [(a, policy, scope, n, section.get("heading")) for a in section.get("attributes") or []]
    for doc in raw.get("internal") or []:
        out += [(a, doc, "internal", 0, doc.get("heading")) for a in doc.get("attributes") or []]
    return out


def load_catalogue(spark: SparkSession, path: str) -> Catalogue:
    raw = read_yaml(path)
    families, problems = _families(raw), []
    kinds, regions = raw.get("kinds") or {}, raw.get("regions") or {}
    ids = Counter(a.get("id") for a, *_ in families)
    problems += [f"the attribute {i} stands {n} times" for i, n in sorted(ids.items(), key=str) if n > 1]
    twins = {a["id"]: a["twin"] for a, *_ in families if a.get("twin")}
    problems += [f"{a}: its twin {b} must be there and name it" for a, b in sorted(twins.items()) if twins.get(b) != a]
    rows, spans = [], {BATCH[0]: BATCH[1:]} if BATCH[0] in kinds else {}
    for a, doc, scope, n, heading in families:
        name = a.get("id")
        problems += [f"{name}: unknown {k}" for k in a if k not in ("id", "kind", "range", "named", "bare", "lead", "twin")]
        problems += [f"{name}: no {k}" for k in ("id", "kind", "range", "named") if not a.get(k)]
        if a.get("kind") not in kinds:
            problems.append(f"{name}: unknown kind {a.get('kind')}")
        low, high = (int(x) for x in a.get("range") or (0, 0))
        problems += [f"{name}: its range is backwards"] * (low > high)
        problems += [f"{name}: {k} needs one {{value}}" for k in ("named", "bare") if a.get(k) is not None and a[k].count("{value}") != 1]
        problems += [f"{name}: lead must not hold the value"] * ("{value}" in (a.get("lead") or ""))
        was = spans.get(a.get("kind"), (low, high))
        spans[a.get("kind")] = (min(low, was[0]), max(high, was[1]))
        rows.append((name, doc.get("doc_id"), doc.get("title"), scope, n, heading, a.get("kind"), low, high, a.get("named"), a.get("bare"), a.get("lead"), a.get("twin")))
    homes = Counter(x for areas in regions.values() for x in areas)
    problems += [f"the postcode area {x} belongs to several regions" for x, n in sorted(homes.items()) if n > 1]
    positive = lambda x, least: isinstance(x, (int, float)) and not isinstance(x, bool) and x >= least
    problems += [f"{k} must be positive" for k in ("max_attempts", "pilot_per_type") if k in raw and not positive(raw[k], 1)] + ["spare_fraction must not be negative"] * ("spare_fraction" in raw and not positive(raw["spare_fraction"], 0))
    if problems:
        raise LibraryError(f"{path}: " + "; ".join(problems))
    of = {"product": raw.get("products") or [], "plan": raw.get("plans") or [], "region": list(regions), "internal": raw.get("products") or []}
    entities = [(scope, n, str(e)) for scope, names in of.items() for n, e in enumerate(names)]
    areas = [(r, n, str(x)) for r, xs in regions.items() for n, x in enumerate(xs)]
    return Catalogue(
        spark.createDataFrame(rows, ATTRIBUTES), spark.createDataFrame(entities, "scope string, place int, entity string"), spark.createDataFrame(areas, "region string, place int, area string"),
        spark.createDataFrame([(k, str(kinds[k]), *s) for k, s in spans.items()], "kind string, template string, low long, high long"), raw,
    )
