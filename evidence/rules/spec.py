"""Document rules as data: where rows come from, how a document is built from one, what is checked, what history keeps."""

from __future__ import annotations

import dataclasses
import fnmatch
import hashlib
import json
import string
from dataclasses import dataclass, field
from typing import Any

FORMATS = ("iso", "year", "thousands")
ATTRIBUTES = ("title", "body", "url", "metadata")
CHECKS = {"not_null": "column", "unique": "column", "allowed_values": "values", "max_null_fraction": "max", "min_rows": "min"}


class RuleError(ValueError):
    """A rule that can't be right."""


def _known(cls, data: dict[str, Any], where: str, rename: dict[str, str] | None = None) -> dict[str, Any]:
    names = {f.name for f in dataclasses.fields(cls)}
    given = {(rename or {}).get(k, k): v for k, v in data.items()}
    if extra := sorted(set(given) - names):
        raise RuleError(f"{where}: unknown entries {extra}")
    missing = [f.name for f in dataclasses.fields(cls) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING and f.name not in given]
    if missing:
        raise RuleError(f"{where}: missing entries {missing}")
    return given


@dataclass(frozen=True)
class Value:
    """One value of a document: exactly one of field, join, template, coalesce, const."""

    field: str | None = None
    join: tuple[str, ...] | None = None
    template: str | None = None
    coalesce: tuple[Value, ...] | None = None
    const: str | None = None
    separator: str = ", "
    format: str | None = None

    def __post_init__(self):
        given = [n for n in ("field", "join", "template", "coalesce", "const") if getattr(self, n) is not None]
        if len(given) != 1:
            raise RuleError(f"a value has exactly one source, not {given}")
        if self.format is not None and self.format not in FORMATS:
            raise RuleError(f"unknown format {self.format}")

    @classmethod
    def of(cls, data: dict[str, Any], where: str = "value") -> Value:
        given = _known(cls, data, where)
        if "coalesce" in given:
            given["coalesce"] = tuple(cls.of(x, where) for x in given["coalesce"])
        if "join" in given:
            given["join"] = tuple(given["join"])
        return cls(**given)

    def columns(self) -> set[str]:
        if self.coalesce is not None:
            return set().union(*(x.columns() for x in self.coalesce))
        return {self.field} if self.field else set(self.join or ()) or set(template_names(self.template or ""))


def template_names(template: str) -> list[str]:
    return [name for _, name, _, _ in string.Formatter().parse(template) if name]


@dataclass(frozen=True)
class Source:
    source_id: str
    table: str
    key: str
    namespace: str = ""
    active_column: str = "is_active"
    order_by: str | None = None


@dataclass(frozen=True)
class Child:
    """A collection of a parent row: select of the rows that match join (child column to parent column)."""

    table: str
    join: dict[str, str]
    select: str
    namespace: str = ""
    order_by: str | None = None
    distinct: bool = False
    eq: tuple[str, str] | None = None
    ne: tuple[str, str] | None = None

    @classmethod
    def of(cls, data: dict[str, Any], where: str) -> Child:
        data = dict(data)
        condition = data.pop("where", None)
        given = _known(cls, data, where, {"schema": "namespace"})
        if not given["join"]:
            raise RuleError(f"{where}: join names no columns")
        if condition is not None:
            kinds = [k for k in ("eq", "ne") if condition.get(k) is not None]
            if len(kinds) != 1 or set(condition) - {"column", "eq", "ne"}:
                raise RuleError(f"{where}: where has a column and one of eq, ne")
            given[kinds[0]] = (condition["column"], str(condition[kinds[0]]))
        return cls(**given)


@dataclass(frozen=True)
class History:
    track: tuple[str, ...] = ("title", "body")
    overwrite: tuple[str, ...] = ("url", "metadata")
    version_on_activation_change: bool = True

    def __post_init__(self):
        if unknown := (set(self.track) | set(self.overwrite)) - set(ATTRIBUTES):
            raise RuleError(f"unknown attributes {sorted(unknown)}")
        if both := set(self.track) & set(self.overwrite):
            raise RuleError(f"both tracked and overwritten: {sorted(both)}")
        if not self.track:
            raise RuleError("nothing is tracked")


@dataclass(frozen=True)
class Check:
    rule: str
    column: str | None = None
    values: tuple[str, ...] | None = None
    max: float | None = None
    min: int | None = None
    severity: str = "error"

    def __post_init__(self):
        if self.rule not in CHECKS or self.severity not in ("error", "warn"):
            raise RuleError(f"unknown check {self.rule} or severity {self.severity}")
        if self.rule != "min_rows" and not self.column:
            raise RuleError(f"{self.rule} needs a column")
        if getattr(self, CHECKS[self.rule]) in (None, ()):
            raise RuleError(f"{self.rule} needs {CHECKS[self.rule]}")

    @property
    def label(self) -> str:
        return f"{self.rule}({self.column or self.min})"


@dataclass(frozen=True)
class DocType:
    doc_type: str
    source: Source
    title: Value
    body: tuple[tuple[str, Value], ...]
    version: int = 1
    children: dict[str, Child] = field(default_factory=dict)
    url: Value | None = None
    metadata: dict[str, Value] = field(default_factory=dict)
    scd2: History = History()
    quality: tuple[Check, ...] = ()
    digest: str = ""

    @classmethod
    def of(cls, data: dict[str, Any]) -> DocType:
        where = str(data.get("doc_type"))
        given = _known(cls, data, where)
        given["source"] = Source(**_known(Source, given["source"], f"{where}.source", {"schema": "namespace"}))
        given["children"] = {k: Child.of(v, f"{where}.{k}") for k, v in (given.get("children") or {}).items()}
        given["title"] = Value.of(given["title"], f"{where}.title")
        if not given["body"]:
            raise RuleError(f"{where}: body has no lines")
        given["body"] = tuple((line["label"], Value.of(line["value"], f"{where}.{line['label']}")) for line in given["body"])
        given["url"] = Value.of(given["url"], f"{where}.url") if given.get("url") else None
        given["metadata"] = {k: Value.of(v, f"{where}.{k}") for k, v in (given.get("metadata") or {}).items()}
        history = given.get("scd2") or {}
        given["scd2"] = History(**{k: tuple(v) if isinstance(v, list) else v for k, v in _known(History, history, f"{where}.scd2").items()})
        given["quality"] = tuple(Check(**{k: tuple(map(str, v)) if isinstance(v, list) else v for k, v in _known(Check, q, f"{where}.quality").items()}) for q in given.get("quality") or ())
        # What decides a document's text; checks and history don't.
        shape = {k: data.get(k) for k in ("version", "source", "children", "title", "body", "url", "metadata")}
        given["digest"] = hashlib.sha256(json.dumps(shape, sort_keys=True, default=str).encode()).hexdigest()
        return cls(**given)

    def values(self) -> list[tuple[str, Value]]:
        out = [("title", self.title), *((f"body {label}", v) for label, v in self.body)]
        return out + ([("url", self.url)] if self.url else []) + [(f"metadata {k}", v) for k, v in self.metadata.items()]

    def columns(self) -> list[str]:
        """Parent columns that are read: by values, checks, key, activity and order."""
        read = set().union(*(v.columns() for _, v in self.values())) | {q.column for q in self.quality if q.column}
        fixed = {self.source.key, self.source.active_column, *([self.source.order_by] if self.source.order_by else [])}
        return sorted((read - set(self.children)) | fixed)

    def signature(self, size: int, overlap: int) -> str:
        return f"v{self.version}|rule={self.digest[:12]}|chunk={size}/{overlap}"


@dataclass(frozen=True)
class CatalogSpec:
    """Which namespaces' tables make up the catalog, and name patterns of tables left out."""

    schemas: tuple[str, ...]
    exclude: tuple[str, ...] = ()

    @classmethod
    def of(cls, data: dict[str, Any]) -> CatalogSpec:
        given = {k: tuple(map(str, v or ())) for k, v in _known(cls, data, "catalog").items()}
        if not given["schemas"]:
            raise RuleError("catalog: schemas names none")
        return cls(**given)

    def wants(self, table: str) -> bool:
        """Whether a table, named with or without a namespace, belongs to the catalog."""
        namespace, _, name = table.rpartition(".")
        return (not namespace or namespace in self.schemas) and not any(fnmatch.fnmatch(x, p) for p in self.exclude for x in (table, name))


@dataclass(frozen=True)
class Limits:
    min_chars: int = 3
    min_words: int = 1
    max_chars: int = 2000
    max_filters: int = 5
    max_doc_types: int = 6
    message_too_short: str = "Please say a little more about what you look for."
    message_too_vague: str = "What would you like to know about it?"
    message_too_long: str = "Please shorten the question."
    message_too_many_filters: str = "Please use fewer filters."


@dataclass(frozen=True)
class GateRule:
    id: str
    kind: str
    message: str
    patterns: tuple[str, ...] = ()
    equals_any: tuple[str, ...] = ()
    require_any: tuple[str, ...] = ()
    sql_hint: str | None = None
    skip_for_follow_up: bool = False
    enabled: bool = True

    def __post_init__(self):
        if self.kind not in ("reject", "needs_sql", "clarify"):
            raise RuleError(f"{self.id}: unknown kind {self.kind}")
        if sum(bool(x) for x in (self.patterns, self.equals_any, self.require_any)) != 1:
            raise RuleError(f"{self.id}: exactly one of patterns, equals_any, require_any")


@dataclass(frozen=True)
class Gate:
    limits: Limits = Limits()
    rules: tuple[GateRule, ...] = ()
    version: int = 1

    @classmethod
    def of(cls, data: dict[str, Any]) -> Gate:
        given = _known(cls, data, "gate")
        given["limits"] = Limits(**_known(Limits, given.get("limits") or {}, "limits"))
        rules = [GateRule(**{k: tuple(map(str, v)) if isinstance(v, list) else v for k, v in _known(GateRule, r, "rule").items()}) for r in given.get("rules") or ()]
        if len({r.id for r in rules}) != len(rules):
            raise RuleError("two gate rules share an id")
        given["rules"] = tuple(rules)
        return cls(**given)
