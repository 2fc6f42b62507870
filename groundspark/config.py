"""Loaders of YAML settings: semantic layer, ontology, policy documents and credentials.  Unknown keys are errors."""

from __future__ import annotations

from collections.abc import Iterable

import yaml

from .operators.graph import Intent, Ontology
from .operators.policy import ALLOW, MASK, Policy, PolicyError, Role
from .operators.questions import ColumnDef, Layer, TableDef
from .operators.sqlguard import Guardrails


class ConfigError(ValueError):
    pass


def mapping(value, where: str, allowed: Iterable[str] | None = None) -> dict:
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise ConfigError(f"{where} must be a mapping")
    if allowed is not None and (extra := set(value) - set(allowed)):
        raise ConfigError(f"{where}: unknown keys {sorted(map(str, extra))}")
    return value


def layer(text: str) -> Layer:
    """The semantic layer: tables with described columns, metrics, synonyms, example questions."""
    d = mapping(yaml.safe_load(text), "layer", ("tables", "metrics", "synonyms", "few_shots"))
    tables = []
    for t in d.get("tables") or ():
        mapping(t, "table", ("name", "description", "columns"))
        columns = tuple(ColumnDef(c["name"], str(c.get("type", "string")), c.get("description", ""), c.get("link", "") or "") for c in t.get("columns") or ())
        tables.append(TableDef(t["name"], t.get("description", ""), columns))
    shots = tuple((s["question"], s["sql"]) for s in d.get("few_shots") or ())
    return Layer(tuple(tables), mapping(d.get("metrics"), "metrics"), mapping(d.get("synonyms"), "synonyms"), shots)


SHAPES = {"entity_lookup": "lookup", "lookup": "lookup", "cluster": "cluster", "pairwise": "pairwise", "open": "open"}
ONTOLOGY_KEYS = ("entity_types", "relation_types", "attribute_relations", "connective_relations", "entity_relations", "intents", "relation_roles", "hint", "empty_graph_hint")


def ontology(text: str) -> Ontology:
    """Relations, which of them hold values or connect, and intents; every relation named must be declared."""
    d = mapping(yaml.safe_load(text), "ontology", ONTOLOGY_KEYS)
    relations = frozenset(d.get("relation_types") or ())
    intents = []
    for i in d.get("intents") or ():
        mapping(i, "intent", ("name", "shape", "triggers", "target_relations"))
        if i["shape"] not in SHAPES:
            raise ConfigError(f"intent {i['name']}: unknown shape {i['shape']}")
        intents.append(Intent(i["name"], SHAPES[i["shape"]], frozenset(str(x).lower() for x in i.get("triggers") or ()), frozenset(i.get("target_relations") or ())))
    named = {r for k in ONTOLOGY_KEYS[2:5] for r in d.get(k) or ()} | {r for i in intents for r in i.targets} | set(mapping(d.get("relation_roles"), "relation_roles"))
    if extra := named - relations:
        raise ConfigError(f"undeclared relations: {sorted(extra)}")
    return Ontology(frozenset(d.get("attribute_relations") or ()), frozenset(d.get("connective_relations") or ()), tuple(intents), relations, (d.get("hint") or "").strip(), (d.get("empty_graph_hint") or "").strip())


POLICY_KEYS = ("version", "default_effect", "anonymous_role", "roles", "data", "query_guardrails", "graph", "licenses", "pii_columns", "row_filters", "row_security", "cost_guardrail")
RULE_KEYS = ("actions", "tables", "columns", "row_security", "graph_relations", "max_rows", "max_graph_triples", "pii")
#: Actions of the policy documents, and ours.
ACTIONS = {"ask": "ask", "raw_sql": "query", "query": "query", "graph": "graph", "export": "export"}
GUARD_KEYS = {"max_sql_length": "max_length", "max_tables": "max_tables", "max_joins": "max_joins", "require_limit": "require_limit"}
CLASSES = ("confidentiality", "license", "privacy", "integrity")


def policy(text: str) -> tuple[Policy, Guardrails]:
    """A policy document of version 1 (permissive) or 2 (deny unless granted) and its limits on query text."""
    d = mapping(yaml.safe_load(text), "policy", POLICY_KEYS)
    version = int(d.get("version", 1))
    if version not in (1, 2):
        raise ConfigError(f"unknown policy version {version}")
    rules = mapping(d.get("roles"), "roles")
    anonymous = str(d.get("anonymous_role", "public"))
    if rules and anonymous not in rules:
        raise ConfigError("anonymous_role must be a declared role")
    guards = mapping(d.get("query_guardrails"), "query_guardrails", GUARD_KEYS)
    old = mapping(d.get("cost_guardrail"), "cost_guardrail", ("require_limit", "forbid_writes"))
    rails = Guardrails(**({GUARD_KEYS[k]: v for k, v in guards.items()} | ({"require_limit": bool(old["require_limit"])} if "require_limit" in old else {})))
    make = _deny_unless_granted if version == 2 else _permissive
    return make(d, rules, anonymous), rails


def _permissive(d: dict, rules: dict, anonymous: str) -> Policy:
    """Version 1: every action but export on every table; personal columns by the role's `pii`; denied values and row rules by role."""
    personal = [str(c).lower() for c in d.get("pii_columns") or ()]
    rows = mapping(d.get("row_security"), "row_security")
    values = mapping(d.get("row_filters"), "row_filters")
    roles = {}
    for name, r in rules.items():
        how = str(mapping(r, f"role {name}", RULE_KEYS).get("pii", MASK))
        roles[name] = Role(
            name,
            frozenset({"query", "ask", "graph"}),
            frozenset({"*"}),
            {} if how == ALLOW else {f"*.{c}": how for c in personal},
            {t.lower(): p for t, p in mapping(rows.get(name), "row_security").items()},
            frozenset({"*"}),
            deny_values={f["column"]: frozenset(map(str, f.get("deny_values") or ())) for f in values.get(name) or ()},
        )
    return Policy(roles, relations=frozenset({"*"}), version="1", anonymous=anonymous)


def _deny_unless_granted(d: dict, rules: dict, anonymous: str) -> Policy:
    """Version 2: listed grants on classified tables and relations, and a notice for each licence."""
    if not rules:
        raise ConfigError("a version 2 policy must declare a role")
    graph = mapping(d.get("graph"), "graph", ("default_effect", "relations"))
    if d.get("default_effect", "deny") != "deny" or graph.get("default_effect", "deny") != "deny":
        raise ConfigError("default_effect must be deny")
    notices = {str(k): str(v) for k, v in mapping(d.get("licenses"), "licenses").items()}
    classes, licences, required = {}, {}, []

    def classify(key: str, value: dict) -> None:
        found = mapping(value, key, None)
        classes[key.lower()] = dict(found)
        if licence := found.get("license"):
            if licence not in notices:
                raise ConfigError(f"{key}: licence {licence} has no notice")
            licences[key.lower()] = frozenset({licence})

    for table, t in mapping(mapping(d.get("data"), "data", ("tables",)).get("tables"), "data.tables").items():
        mapping(t, f"table {table}", ("classification", "columns", "required"))
        if missing := set(CLASSES) - set(mapping(t.get("classification"), f"table {table}")):
            raise ConfigError(f"table {table} is not classified: {sorted(missing)}")
        classify(table, t["classification"])
        for column, c in mapping(t.get("columns"), f"columns of {table}").items():
            classify(f"{table}.{column}", c)
        if t.get("required", False):
            required.append(table)
    relations = {}
    for name, r in mapping(graph.get("relations"), "graph.relations").items():
        relations[name] = mapping(r, f"relation {name}")
        licence = relations[name].get("license") or mapping(relations[name].get("classification"), name).get("license")
        if licence and licence not in notices:
            raise ConfigError(f"relation {name}: licence {licence} has no notice")
    roles = {}
    tables = {t for t in classes if "." not in t}
    for name, r in rules.items():
        r = mapping(r, f"role {name}", RULE_KEYS)
        granted = frozenset(str(t).lower() for t in r.get("tables") or ())
        if extra := granted - tables:
            raise ConfigError(f"role {name}: unclassified tables {sorted(extra)}")
        if extra := set(r.get("graph_relations") or ()) - set(relations):
            raise ConfigError(f"role {name}: unclassified relations {sorted(extra)}")
        if extra := set(r.get("actions") or ()) - set(ACTIONS):
            raise ConfigError(f"role {name}: unknown actions {sorted(extra)}")
        if extra := {t.lower() for t in r.get("row_security") or ()} - granted:
            raise ConfigError(f"role {name}: row rules on tables that are not granted {sorted(extra)}")
        columns = {str(k).lower(): v for k, v in mapping(r.get("columns"), f"columns of {name}").items()}
        if bad := [k for k, v in columns.items() if v not in ("allow", "mask", "deny") or k.split(".")[0] not in granted | {"*"}]:
            raise ConfigError(f"role {name}: column rules {bad}")
        most, triples = int(r.get("max_rows", 1000)), int(r.get("max_graph_triples", 200))
        if most <= 0 or triples <= 0:
            raise ConfigError(f"role {name}: caps must be positive")
        roles[name] = Role(name, frozenset(ACTIONS[a] for a in r.get("actions") or ()), granted, columns, {t.lower(): p for t, p in (r.get("row_security") or {}).items()}, frozenset(r.get("graph_relations") or ()), most, triples)
    return Policy(roles, licences, notices, frozenset(relations), frozenset(required), "2", anonymous, classes)


__all__ = ["ConfigError", "PolicyError", "layer", "ontology", "policy"]
