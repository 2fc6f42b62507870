"""Roles, what they may read, and what a result owes: deny unless granted."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml

ALLOW, MASK, DENY = "allow", "mask", "deny"


class PolicyError(ValueError):
    pass


@dataclass(frozen=True)
class Role:
    name: str
    actions: frozenset[str] = frozenset()
    tables: frozenset[str] = frozenset()  # '*' for all classified
    columns: dict[str, str] = field(default_factory=dict)  # table.column or *.column -> allow, mask, deny
    rows: dict[str, str] = field(default_factory=dict)  # table -> predicate
    relations: frozenset[str] = frozenset()
    max_rows: int = 1000
    max_triples: int = 200
    deny_values: dict[str, frozenset[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Policy:
    roles: dict[str, Role]
    licences: dict[str, frozenset[str]] = field(default_factory=dict)  # table or table.column -> licence ids
    notices: dict[str, str] = field(default_factory=dict)
    relations: frozenset[str] = frozenset()  # classified relations
    required: frozenset[str] = frozenset()
    version: str = "1"
    anonymous: str = "public"
    classes: dict[str, dict] = field(default_factory=dict)  # table or table.column -> its classification

    def may_relate(self, role: str, relation: str) -> bool:
        """A relation must be classified and granted."""
        r = self.role(role).relations
        return ("*" in self.relations or relation in self.relations) and ("*" in r or relation in r)

    def role(self, name: str) -> Role:
        if name not in self.roles:
            raise PolicyError(f"unknown_role: {name}")
        return self.roles[name]

    def allows(self, role: str, action: str) -> bool:
        return role in self.roles and action in self.roles[role].actions

    def may_read(self, role: str, table: str) -> bool:
        r = self.role(role)
        return "*" in r.tables or table.lower() in r.tables

    def column(self, role: str, table: str, column: str) -> str:
        c = self.role(role).columns
        return c.get(f"{table}.{column}".lower(), c.get(f"*.{column}".lower(), ALLOW))

    def obligations(self, tables: list[str], columns: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
        """(licence, notice) of all referenced tables and columns, sorted."""
        keys = [t.lower() for t in tables] + [f"{t}.{c}".lower() for t, cs in (columns or {}).items() for c in cs]
        return sorted((x, self.notices.get(x, "")) for x in {x for k in keys for x in self.licences.get(k, ())})

    def access_profile(self, role: str) -> dict:
        """What a caller may know of the role; predicates stay private."""
        r = self.role(role)
        return {"role": role, "actions": sorted(r.actions), "tables": sorted(r.tables), "columns": dict(sorted(r.columns.items())), "row_filtered": sorted(r.rows), "relations": sorted(r.relations), "max_rows": r.max_rows, "max_triples": r.max_triples}


KEYS = {"version", "default_effect", "roles", "licences", "notices", "relations", "required"}
ROLE_KEYS = {"actions", "tables", "columns", "rows", "relations", "max_rows", "max_triples", "deny_values"}


def load(text: str) -> Policy:
    """Policy from YAML; unknown keys and effects are errors."""
    d = yaml.safe_load(text) or {}
    if extra := set(d) - KEYS:
        raise PolicyError(f"unknown keys: {sorted(extra)}")
    if d.get("default_effect", DENY) != DENY:
        raise PolicyError("default_effect must be deny")
    roles = {}
    for name, r in (d.get("roles") or {}).items():
        r = r or {}
        if extra := set(r) - ROLE_KEYS:
            raise PolicyError(f"role {name}: unknown keys {sorted(extra)}")
        columns = {k.lower(): v for k, v in (r.get("columns") or {}).items()}
        for k, v in columns.items():
            if v not in (ALLOW, MASK, DENY) or k.count(".") != 1:
                raise PolicyError(f"role {name}: column rule {k}: {v}")
        if int(r.get("max_rows", 1000)) <= 0:
            raise PolicyError(f"role {name}: max_rows must be positive")
        low = lambda key, r=r: frozenset(str(x).lower() for x in r.get(key) or ())
        roles[name] = Role(name, low("actions"), low("tables"), columns, {k.lower(): v for k, v in (r.get("rows") or {}).items()}, frozenset(r.get("relations") or ()), int(r.get("max_rows", 1000)), int(r.get("max_triples", 200)), {k: frozenset(map(str, v)) for k, v in (r.get("deny_values") or {}).items()})
    licences = {k.lower(): frozenset(v) for k, v in (d.get("licences") or {}).items()}
    notices = d.get("notices") or {}
    if missing := {x for v in licences.values() for x in v} - set(notices):
        raise PolicyError(f"licences without a notice: {sorted(missing)}")
    return Policy(roles, licences, notices, frozenset(d.get("relations") or ()), frozenset(d.get("required") or ()), str(d.get("version", "1")))


#: The policy over the sample tables.
SAMPLE = """
version: "1"
default_effect: deny
required: [customer, orders]
relations: [HAS_BRAND, HAS_TYPE, SUPPLIED_BY, BASED_IN, IN_REGION]
licences: {customer: [crm], orders: [sales], customer.c_acctbal: [finance], nation: [open]}
notices: {crm: Customer data terms, sales: Sales data terms, finance: Restricted figures, open: Open data}
roles:
  public:
    actions: [query, ask]
    tables: [customer, orders, nation, region]
    columns: {customer.c_acctbal: mask, customer.c_mktsegment: deny}
    rows: {orders: "o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)"}
    relations: [HAS_BRAND, HAS_TYPE, IN_REGION]
    max_rows: 100
    max_triples: 50
  analyst:
    actions: [query, ask]
    tables: [customer, orders, nation, region, lineitem, part, supplier]
    columns: {"*.c_acctbal": mask}
    relations: [HAS_BRAND, HAS_TYPE, SUPPLIED_BY, BASED_IN, IN_REGION]
    max_rows: 10000
  steward:
    actions: [query, ask, export]
    tables: ["*"]
    relations: [HAS_BRAND, HAS_TYPE, SUPPLIED_BY, BASED_IN, IN_REGION]
    max_rows: 100000
"""
