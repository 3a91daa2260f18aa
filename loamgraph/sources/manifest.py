"""What a graph is made of, read from TOML: node types and their properties, edge types, hierarchies, aliases, settings."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

KINDS = ("string", "markdown", "int", "float", "bool", "date", "datetime", "enum", "list-of", "ref")
#: Tables and keys that a manifest may have; any other is reported.
KNOWN = {
    "": {"types", "edges", "hierarchy", "alias", "query", "graph", "embeddings", "context"},
    "types": {"table", "key", "title", "properties", "json", "modified", "mentions", "source", "body"},
    "property": {"type", "item", "values", "from", "required", "target"},
    "edges": {"table", "source", "source-key", "target", "target-key", "inverse", "single", "acyclic", "distinct", "totals"},
    "hierarchy": {"edges", "parent-is-source", "max-depth", "ordered-by"},
    "alias": {"verb", "filter", "sort", "take", "skip", "semantic"},
    "query": {"lexical-weight", "title-weight", "type-weights", "path-weights", "graph-expansion"},
    "graph-expansion": {"enabled", "hops", "edges", "weight", "candidate-multiplier"},
    "graph": {"cluster"},
    "embeddings": {"model", "dim"},
    "context": {"pinned", "recent", "include"},
}


class ManifestError(ValueError):
    """A manifest that can't be used."""


@dataclass(frozen=True)
class Property:
    """kind is one of KINDS; expr is the SQL expression it is read by, its name if it has none."""

    kind: str
    item: str | None = None
    values: tuple[str, ...] = ()
    expr: str | None = None
    required: bool = False
    target: str | None = None


@dataclass(frozen=True)
class NodeType:
    """Where a type's rows come from. json names a column of further, undeclared properties; modified is when a row
    last changed, mentions an array of the paths its text names, body its text."""

    table: str
    key: str
    title: str
    properties: dict[str, Property] = field(default_factory=dict)
    json: str | None = None
    modified: str | None = None
    mentions: str | None = None
    body: str | None = None
    source: str | None = None


@dataclass(frozen=True)
class EdgeType:
    """source and target name node types, the keys are SQL expressions; totals is an aggregate of the table they may use."""

    table: str
    source: str
    source_key: str
    target: str
    target_key: str
    inverse: str | None = None
    single: bool = False
    acyclic: str | None = None
    distinct: bool = False
    totals: str | None = None


@dataclass(frozen=True)
class Hierarchy:
    """Edge types that lead from child to parent, or the other way round."""

    edges: tuple[str, ...]
    parent_is_source: bool = False
    max_depth: int | None = None
    ordered_by: str | None = None


@dataclass(frozen=True)
class Expansion:
    """Graph expansion of ranked results."""

    enabled: bool = False
    hops: int = 1
    edges: tuple[str, ...] = ("references", "parent", "tagged", "contains")
    weight: float = 0.2
    multiplier: int = 5

    def problems(self, edges: dict[str, EdgeType]) -> list[str]:
        out = []
        if self.hops not in (1, 2):
            out.append("graph-expansion-hops: hops must be 1 or 2")
        if not 0 <= self.weight <= 1:
            out.append("graph-expansion-weight: weight must be from 0 to 1")
        if self.multiplier < 1:
            out.append("graph-expansion-multiplier: candidate-multiplier must be 1 or more")
        if self.enabled and not self.edges:
            out.append("graph-expansion-edges: no edge types to follow")
        out += [f"graph-expansion-edges: no edge type {e!r}" for e in self.edges if self.enabled and e not in edges]
        return out

    def merged(self, **given) -> Expansion:
        """With what a call gives; None keeps the setting."""
        return Expansion(**{**self.__dict__, **{k: v for k, v in given.items() if v is not None}})


@dataclass(frozen=True)
class Manifest:
    types: dict[str, NodeType]
    edges: dict[str, EdgeType]
    hierarchies: dict[str, Hierarchy] = field(default_factory=dict)
    aliases: dict[str, dict] = field(default_factory=dict)
    expansion: Expansion = Expansion()
    lexical_weight: float = 0.0
    title_weight: float = 0.3
    type_weights: dict[str, float] = field(default_factory=dict)
    path_weights: dict[str, float] = field(default_factory=dict)
    embeddings: dict = field(default_factory=dict)
    context: dict = field(default_factory=dict)
    unknown: tuple[str, ...] = ()

    @property
    def inverses(self) -> dict[str, str]:
        return {e.inverse: name for name, e in self.edges.items() if e.inverse}

    def property(self, name: str, kinds: list[str] | None = None) -> Property | None:
        """The declaration of a property in the first of the types that has one; of the given types, or else of all."""
        for scope in (kinds or [], self.types):
            for k in scope:
                if name in self.types[k].properties:
                    return self.types[k].properties[name]
        return None

    def owners(self, name: str) -> list[str]:
        """Types whose nodes may have the property: those that declare it, or else those with undeclared ones."""
        return [k for k, t in self.types.items() if name in t.properties] or [k for k, t in self.types.items() if t.json]

    def names(self) -> list[str]:
        return sorted({p for t in self.types.values() for p in t.properties})


def _only(table: dict, known: str, where: str, unknown: list[str]) -> dict:
    unknown += [f"{where}.{k}".lstrip(".") for k in table if k not in KNOWN[known]]
    return {k.replace("-", "_"): v for k, v in table.items() if k in KNOWN[known]}


def _property(name: str, given: str | dict, unknown: list[str]) -> Property:
    p = {"type": given} if isinstance(given, str) else _only(given, "property", name, unknown)
    kind = p.get("type")
    if kind not in KINDS:
        raise ManifestError(f"{name}: no property type {kind!r}")
    if kind == "enum" and not p.get("values"):
        raise ManifestError(f"{name}: an enum needs values")
    if kind == "list-of" and p.get("item", "string") not in KINDS[:-2] + KINDS[-1:]:
        raise ManifestError(f"{name}: no list of {p['item']!r}")
    return Property(kind, p.get("item"), tuple(p.get("values", ())), p.get("from"), bool(p.get("required")), p.get("target"))


def loads(text: str) -> Manifest:
    """A manifest from TOML. Keys that are not known are kept apart, and what contradicts itself raises ManifestError."""
    try:
        return build(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise ManifestError(str(e)) from None


def build(raw: dict) -> Manifest:
    unknown: list[str] = []
    top = _only(raw, "", "", unknown)
    types, edges, hierarchies = {}, {}, {}
    for name, given in top.get("types", {}).items():
        t = _only(given, "types", f"types.{name}", unknown)
        for needed in ("table", "key", "title"):
            if needed not in t:
                raise ManifestError(f"types.{name}: no {needed}")
        t["properties"] = {p: _property(f"types.{name}.{p}", v, unknown) for p, v in t.get("properties", {}).items()}
        types[name] = NodeType(**t)
    for name, given in top.get("edges", {}).items():
        edges[name] = e = EdgeType(**_only(given, "edges", f"edges.{name}", unknown))
        for end in (e.source, e.target):
            if end not in types:
                raise ManifestError(f"edges.{name}: no type {end!r}")
        if e.acyclic not in (None, "error", "warning"):
            raise ManifestError(f"edges.{name}: acyclic is error or warning")
    clash = [e.inverse for e in edges.values() if e.inverse in edges]
    if clash:
        raise ManifestError(f"inverse {clash[0]!r} is an edge type too")
    for name, given in top.get("hierarchy", {}).items():
        h = _only(given, "hierarchy", f"hierarchy.{name}", unknown)
        h["edges"] = tuple(h.get("edges", ()))
        if not h["edges"] or any(e not in edges for e in h["edges"]):
            raise ManifestError(f"hierarchy.{name}: edges must name edge types")
        hierarchies[name] = Hierarchy(**h)
    query = _only(top.get("query", {}), "query", "query", unknown)
    x = _only(query.get("graph_expansion", {}), "graph-expansion", "query.graph-expansion", unknown)
    if "candidate_multiplier" in x:
        x["multiplier"] = x.pop("candidate_multiplier")
    if "edges" in x:
        x["edges"] = tuple(x["edges"])
    for name in ("lexical_weight", "title_weight"):
        if not 0 <= query.get(name, 0) <= 1:
            raise ManifestError(f"query.{name}: must be from 0 to 1")
    for name in ("type_weights", "path_weights"):
        if any(not 0 < w <= 1 for w in query.get(name, {}).values()):
            raise ManifestError(f"query.{name}: weights are above 0 and up to 1")
    return Manifest(
        types, edges, hierarchies, {n: _only(a, "alias", f"alias.{n}", unknown) for n, a in top.get("alias", {}).items()}, Expansion(**x),
        query.get("lexical_weight", 0.0), query.get("title_weight", 0.3), query.get("type_weights", {}), query.get("path_weights", {}),
        _only(top.get("embeddings", {}), "embeddings", "embeddings", unknown), _only(top.get("context", {}), "context", "context", unknown), tuple(unknown),
    )


def merged(own: dict, *packs: dict) -> dict:
    """A manifest's raw tables with those of type packs; a name that two of them declare raises ManifestError."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in own.items()}
    for pack in packs:
        for section in ("types", "edges", "hierarchy"):
            for name, given in pack.get(section, {}).items():
                if name in out.setdefault(section, {}):
                    raise ManifestError(f"{section}.{name} is declared twice")
                out[section][name] = given
    return out


def load(path: str | Path, packs: list[str | Path] = ()) -> Manifest:
    """A manifest file, with type packs from further files."""
    read = [tomllib.loads(Path(p).read_text()) for p in (path, *packs)]
    return build(merged(*read))


#: The manifest of the test tables.
TABLES = load(Path(__file__).with_name("tables.toml"))
