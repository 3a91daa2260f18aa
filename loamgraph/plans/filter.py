"""The filter language: text to a tree of predicates, and the tree to columns and semi-joins."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import temporal
from loamgraph.operators.traverse import reach
from loamgraph.sources.graph import CORE, Graph
from loamgraph.sources.manifest import TABLES, Manifest, Property

_LEX = re.compile(r'\s*(?:(?P<op>!=|~=|<=|>=|->|<-|\.\.|[=<>()\[\],])|(?P<hops>\+|\{\d+(?:,\d*)?\})|"(?P<quoted>(?:[^"\\]|\\.)*)"|(?P<word>(?:(?!->|<-|\.\.)[^\s=<>()\[\]",!~+{])+))')
MOST_HOPS, MOST_CHAIN = 50, 5
COMPARISONS = ("=", "!=", "<", "<=", ">", ">=", "~=")


class FilterError(ValueError):
    """The filter's text is wrong."""


@dataclass
class And:
    parts: list


@dataclass
class Or:
    parts: list


@dataclass
class Not:
    part: object


@dataclass
class Compare:
    name: str
    op: str
    value: object
    quoted: bool = False


@dataclass
class Edge:
    name: str
    out: bool
    inner: object | None
    least: int = 1
    most: int | None = 1


@dataclass
class Tree:
    kind: str
    value: str
    alias: str = "parent"


@dataclass
class Since:
    value: str


@dataclass
class Names:
    path: str
    edge: str | None = None
    quoted: bool = False


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise FilterError(f"unexpected {text[at:].strip()[:10]!r}")
        kind = m.lastgroup
        out.append((kind, re.sub(r"\\(.)", r"\1", m[kind]) if kind == "quoted" else m[kind]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = lex(text), 0

    def peek(self, value: str | None = None) -> bool | tuple[str, str]:
        t = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return t if value is None else t[0] in ("op", "word") and t[1] == value

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if t[0] == "end" or value is not None and t[1] != value:
            raise FilterError(f"expected {value or 'a word'}, found {t[1] or 'the end'}")
        self.at += 1
        return t

    def expression(self):
        parts = [self.conjunction()]
        while self.peek("OR"):
            self.take()
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Or(parts)

    def conjunction(self):
        parts = [self.negation()]
        while True:
            if self.peek("AND"):
                self.take()
            elif self.peek()[0] == "end" or self.peek("OR") or self.peek(")"):
                break
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else And(parts)

    def negation(self):
        if self.peek("NOT"):
            self.take()
            return Not(self.negation())
        if self.peek("("):
            self.take()
            inner = self.expression()
            self.take(")")
            return inner
        return self.predicate(0)

    def predicate(self, depth: int):
        kind, name = self.take()
        if kind != "word":
            raise FilterError(f"expected a property, found {name!r}")
        t = self.peek()
        if not (t[0] == "op" and t[1] in ("->", "<-", *COMPARISONS)) and ":" in name[1:]:
            # name:value is name=value.
            at = name.index(":", 1)
            name, rest = name[:at], name[at + 1 :]
            if rest:
                return self.compared(name, "=", ("word", rest))
            op = "="
        else:
            op = self.take()[1]
        if op in ("->", "<-"):
            return self.edge(name, op == "->", depth + 1)
        if op not in COMPARISONS:
            raise FilterError(f"no operator {op!r}")
        return self.compared(name, op, None)

    def compared(self, name: str, op: str, first: tuple[str, str] | None):
        base, _, alias = name.partition(":")
        if base in ("tree", "parent", "root") and op == "=":
            return Tree(base, (first or self.take())[1], alias or "parent")
        if base == "modified-since":
            if op != "=":
                raise FilterError("modified-since takes = only")
            return Since((first or self.take())[1])
        if base == "names-path":
            if op not in ("=", "!="):
                raise FilterError("names-path takes = and != only")
            kind, value = first or self.take()
            found = Names(value, alias or None, kind == "quoted")
            return found if op == "=" else Not(found)
        if first is None and self.peek("["):
            if op not in ("=", "!="):
                raise FilterError(f"a list of values takes = and != only, not {op}")
            self.take()
            items = [self.take()[1]]
            while self.peek(","):
                self.take()
                items.append(self.take()[1])
            self.take("]")
            return Compare(name, op, items)
        kind, value = first or self.take()
        if kind == "op":
            raise FilterError(f"expected a value, found {value!r}")
        if self.peek(".."):
            if op != "=":
                raise FilterError(f"a range takes = only, not {op}")
            self.take()
            return Compare(name, op, (value, self.take()[1]))
        if value == "*" and kind != "quoted" and op not in ("=", "!="):
            raise FilterError(f"* takes = and != only, not {op}")
        return Compare(name, op, value, kind == "quoted")

    def edge(self, name: str, out: bool, depth: int):
        if depth > MOST_CHAIN:
            raise FilterError(f"more than {MOST_CHAIN} edges in a chain")
        least, most = 1, 1
        if self.peek()[0] == "hops":
            hops = self.take()[1]
            if hops == "+":
                most = None
            else:
                a, comma, b = hops[1:-1].partition(",")
                least, most = int(a), (int(b) if b else None) if comma else int(a)
                if least < 1 or (most is not None and not least <= most <= MOST_HOPS):
                    raise FilterError(f"hops {hops} are out of range")
        t = self.peek()
        if t[0] == "end" or t[1] in ("AND", "OR", "NOT", ")") and t[0] != "quoted":
            inner = None
        elif self.peek("("):
            self.take()
            inner = self.expression()
            self.take(")")
        else:
            inner = self.predicate(depth)
        return Edge(name, out, inner, least, most)


def parse(text: str):
    """The predicate tree; None for empty text, which matches all."""
    if not text.strip():
        return None
    p = _Parser(text)
    tree = p.expression()
    if p.peek()[0] != "end":
        raise FilterError(f"unexpected {p.peek()[1]!r}")
    return tree


def glob_pattern(glob: str) -> str:
    """* within a folder, ? one character of a name; ** as a whole segment is any number of folders, none at the pattern's
    end or as all of it included; anchored at both ends."""
    if set(glob.split("/")) == {"**"}:
        return r"(?s)\A.*\z"
    out, parts = [], glob.split("/")
    for i, part in enumerate(parts):
        if part != "**":
            name = "".join({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c) for c in re.sub(r"\*+", "*", part))
            out.append(name + ("/" if i + 1 < len(parts) else ""))
        elif i + 1 == len(parts):
            out.append("(?:[^/]*/)*[^/]+")
        elif not i or parts[i - 1] != "**":
            out.append("(?:[^/]*/)*")
    return rf"(?s)\A{''.join(out)}\z"


_OPS = {
    "=": lambda c, v: c == v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "!=": lambda c, v: ~c.eqNullSafe(v),
}


def parts_of(tree) -> list:
    return tree.parts if isinstance(tree, And) else [tree]


def _walk(tree):
    yield tree
    for x in (*getattr(tree, "parts", ()), getattr(tree, "part", None), getattr(tree, "inner", None)):
        if x is not None:
            yield from _walk(x)


def scope(tree, manifest: Manifest, ends=lambda name: None, within: list[str] | None = None) -> list[str] | None:
    """The node types that a conjunction leaves: those it names, that may have its properties, and that its edges lead
    from. None where the manifest has no types."""
    if not manifest.types:
        return None
    kinds = set(within if within is not None else manifest.types)
    for p in parts_of(tree) if tree is not None else []:
        if isinstance(p, Compare) and p.name == "type" and p.op == "=" and isinstance(p.value, str) and p.value != "*":
            source, colon, name = p.value.rpartition(":")
            kinds &= {name} if not source else {k for k in (name,) if k in manifest.types and manifest.types[k].source == source}
        elif isinstance(p, Compare) and p.name not in CORE and p.op != "!=":
            kinds &= set(manifest.owners(p.name))
        elif isinstance(p, Edge):
            name = manifest.inverses.get(p.name.lstrip(":"), p.name.lstrip(":"))
            both = ends(name)
            if both:
                kinds &= set(both[0] if p.out != (name != p.name.lstrip(":")) else both[1])
        elif isinstance(p, Since):
            kinds &= {k for k, t in manifest.types.items() if t.modified}
    return [k for k in manifest.types if k in kinds]


def validate(tree, manifest: Manifest = TABLES, strict: bool = False) -> list[str]:
    """What is wrong with a filter, all of it; strict also minds undeclared types, properties and members of enums."""
    if tree is None:
        return []
    out = []
    known = [*manifest.edges, *manifest.inverses, *manifest.hierarchies]
    for x in _walk(tree):
        if isinstance(x, Edge) and manifest.edges and x.name.lstrip(":") not in known:
            out.append(f"no edge type {x.name!r}{near_name(x.name, known)}")
        if isinstance(x, Tree) and x.alias not in manifest.hierarchies:
            out.append(f"no hierarchy {x.alias!r}{near_name(x.alias, list(manifest.hierarchies))}")
        if not isinstance(x, Compare):
            continue
        p = manifest.property(x.name)
        if p is None and x.name not in CORE and (strict or manifest.types and not manifest.owners(x.name)):
            out.append(f"no property {x.name!r}{near_name(x.name, manifest.names())}")
        if strict and x.name == "type" and isinstance(x.value, str) and x.value != "*" and x.value.rpartition(":")[2] not in manifest.types:
            out.append(f"no type {x.value!r}{near_name(x.value, list(manifest.types))}")
        if p is not None:
            try:
                _check(x, p, strict)
            except FilterError as e:
                out.append(str(e))
    return out


def _number(c: Compare, value: str) -> int | float:
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    raise FilterError(f"{c.name} is a number, not {value!r}")


def _place(c: Compare, p: Property, value: str) -> int:
    if value in p.values:
        return p.values.index(value)
    if value.isdigit() and int(value) < len(p.values):
        return int(value)
    raise FilterError(f"{c.name} has no member {value!r}{near_name(value, list(p.values))}")


def _check(c: Compare, p: Property, strict: bool = False) -> None:
    values = list(c.value) if isinstance(c.value, (tuple, list)) else [c.value]
    if c.value == "*" and not c.quoted:
        return
    if p.kind == "list-of" and (c.op in ("<", "<=", ">", ">=") or isinstance(c.value, tuple)):
        raise FilterError(f"{c.name} is a list: ask for an item with ~=")
    if p.kind == "list-of" and c.op in ("=", "!=") and isinstance(c.value, str):
        raise FilterError(f"{c.name} is a list: ask for an item with ~=, or for items in brackets")
    ordered = c.op in ("<", "<=", ">", ">=") or isinstance(c.value, tuple)
    if p.kind in ("int", "float") and c.op != "~=":
        for v in values:
            _number(c, v)
    if p.kind == "enum" and (ordered or strict):
        for v in values:
            _place(c, p, v)
    if p.kind == "bool" and c.op != "~=" and (ordered or c.value not in ("true", "false")):
        raise FilterError(f"{c.name} is true or false")


class Compiler:
    """A tree's column over the nodes; edge predicates become marks joined to them, so OR and NOT can hold them."""

    def __init__(self, graph: Graph, kinds: list[str] | None = None):
        self.graph, self.manifest, self.kinds = graph, graph.manifest, kinds
        self.marks: list[DataFrame] = []

    def column(self, tree) -> Column:
        if isinstance(tree, And):
            return reduce(lambda a, b: a & b, map(self.column, tree.parts))
        if isinstance(tree, Or):
            return reduce(lambda a, b: a | b, map(self.column, tree.parts))
        if isinstance(tree, Not):
            return ~F.coalesce(self.column(tree.part), F.lit(False))
        if isinstance(tree, (Edge, Tree, Names)):
            return self.mark(self.ids(tree))
        if isinstance(tree, Since):
            return self.since(tree)
        return self.compare(tree)

    def ids(self, tree) -> DataFrame:
        """The ids that an edge, a hierarchy or a path predicate gives."""
        return self.edge(tree) if isinstance(tree, Edge) else self.hierarchy(tree) if isinstance(tree, Tree) else self.names(tree)

    def mark(self, ids: DataFrame) -> Column:
        name = f"_m{len(self.marks)}_{id(self)}"
        self.marks.append(ids.distinct().withColumn(name, F.lit(True)))
        return F.coalesce(F.col(name), F.lit(False))

    def edge(self, e: Edge) -> DataFrame:
        given = e.name.lstrip(":")
        name = self.manifest.inverses.get(given, given)
        known = [*self.manifest.edges, *self.manifest.inverses, *self.manifest.hierarchies]
        if known and name not in known:
            raise FilterError(f"no edge type {e.name!r}{near_name(e.name, known)}")
        pairs, ends = self.graph.edges(name), self.graph.ends(name)
        forward = e.out != (name != given)
        if not forward:
            pairs = pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))
        if e.inner is None and (e.least, e.most) == (1, 1):
            return pairs.select(F.col("source").alias("id"))
        # Only the types at the far end are read.
        far = matching(self.graph, e.inner, None if ends is None else ends[1 if forward else 0]).select("id")
        if (e.least, e.most) == (1, 1):
            return pairs.join(far, pairs.target == far.id, "left_semi").select(F.col("source").alias("id"))
        return reach(pairs, far, e.least, e.most)

    def hierarchy(self, t: Tree) -> DataFrame:
        h = self.manifest.hierarchies.get(t.alias)
        if h is None:
            raise FilterError(f"no hierarchy {t.alias!r}{near_name(t.alias, list(self.manifest.hierarchies))}")
        up = self.graph.edges(t.alias)
        seed = self.graph.spark.createDataFrame([(t.value,)], "id string")
        if t.kind == "parent":
            return up.where(F.col("target") == t.value).select(F.col("source").alias("id"))
        if t.kind == "tree":
            return reach(up, seed, 1, h.max_depth)
        down = up.select(F.col("target").alias("source"), F.col("source").alias("target"))
        above = reach(down, seed, 1, h.max_depth).union(seed)
        roots = above.join(up, above.id == up.source, "left_anti").select("id")
        if h.max_depth:
            roots = roots.union(reach(down, seed, h.max_depth, h.max_depth))
        return reach(up, roots, 1, h.max_depth).union(roots)

    def names(self, n: Names) -> DataFrame:
        """Nodes whose text names the path, or a folder above it; a pattern is held against what is named."""
        refs = self.graph.path_refs()
        if n.edge:
            refs = refs.where(F.col("type") == n.edge)
        if not n.quoted and re.search(r"[*?]", n.path):
            return refs.where(F.col("target").rlike(glob_pattern(n.path))).select("id")
        parts = [p for p in n.path.split("/") if p not in ("", ".")]
        return refs.where(F.col("target").isin(["/".join(parts[:k]) for k in range(1, len(parts) + 1)])).select("id")

    def since(self, s: Since) -> Column:
        """Changed since a time, or within a span of it before now."""
        span = temporal.span(s.value)
        at = self.graph.now - span if span else temporal.relative(s.value, self.graph.now) or temporal.instant(s.value)
        if at is None:
            raise FilterError(f"no time or span {s.value!r}")
        at = at.replace(tzinfo=None) if at.tzinfo is None else at.astimezone(temporal.UTC).replace(tzinfo=None)
        return F.coalesce(F.col("modified") >= F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz"), F.lit(False))

    def day(self, kind: str, value: str) -> Column:
        """A date or time as it is stored; today-30d and the like count from the graph's clock."""
        at = temporal.relative(value, self.graph.now)
        if at is None and value.startswith(("today", "now")):
            raise FilterError(f"no relative date {value!r}")
        if at is None and kind == "datetime":
            at = temporal.instant(value)
        return F.lit(value if at is None else temporal.stored(at, kind))

    def type_is(self, c: Compare) -> Column:
        """t of any source, :t without one, source:t of that one."""
        source, colon, name = c.value.rpartition(":")
        fits = F.col("type") == name
        if colon:
            fits = fits & (F.lit(not source) if not self.has_source else F.col("source").eqNullSafe(F.lit(source or None)))
        fits = F.coalesce(fits, F.lit(False))
        return fits if c.op == "=" else ~fits

    has_source = False

    def compare(self, c: Compare) -> Column:
        p = self.manifest.property(c.name, self.kinds)
        if c.name in CORE:
            if c.name == "type" and c.op in ("=", "!=") and isinstance(c.value, str) and (c.value != "*" or c.quoted):
                return self.type_is(c)
            p = Property("string")
        if p is None:
            if self.manifest.types and not self.manifest.owners(c.name):
                raise FilterError(f"no property {c.name!r}{near_name(c.name, self.manifest.names())}")
            return self.loose(c)
        _check(c, p)
        col = F.col(c.name)
        if c.name in ("path", "id") and c.op in ("=", "!=") and isinstance(c.value, str) and not c.quoted and re.search(r"[*?]", c.value):
            fits = col.rlike(glob_pattern(c.value))
            return fits if c.op == "=" else ~fits
        if c.value == "*" and not c.quoted:
            has = F.exists(col, lambda x: x.isNotNull()) if p.kind == "list-of" else (col != "") if c.name in CORE else col.isNotNull()
            has = F.coalesce(has, F.lit(False))
            return has if c.op == "=" else ~has
        if p.kind == "list-of" or c.op == "~=" or isinstance(c.value, list):
            items = col if p.kind == "list-of" else F.array(col.cast("string"))
            holds = [F.coalesce(F.array_contains(items, F.lit(v)), F.lit(False)) for v in (c.value if isinstance(c.value, list) else [c.value])]
            both = reduce(lambda a, b: a & b, holds)
            return ~both if c.op == "!=" else both
        if p.kind == "enum":
            if isinstance(c.value, tuple):
                lo, hi = (_place(c, p, v) for v in c.value)
                fit = list(p.values[lo : hi + 1])
            elif c.op in ("=", "!="):
                return _OPS[c.op](col, F.lit(c.value))
            else:
                i = _place(c, p, c.value)
                fit = [n for k, n in enumerate(p.values) if {"<": k < i, "<=": k <= i, ">": k > i, ">=": k >= i}[c.op]]
            return col.isin(fit) if fit else F.lit(False)
        typed = {"int": lambda v: F.lit(_number(c, v)), "float": lambda v: F.lit(float(_number(c, v))), "bool": lambda v: F.lit(v == "true")}
        typed |= {k: lambda v, k=k: self.day(k, v) for k in ("date", "datetime")}
        value = typed.get(p.kind, F.lit)
        if isinstance(c.value, tuple):
            return col.between(*map(value, c.value))
        return _OPS[c.op](col, value(c.value))

    def loose(self, c: Compare) -> Column:
        """An undeclared property, read from the JSON column. Only strings equal a value, true and false besides equal
        themselves and 1 and 0, and order is that of whole numbers: a string counts by the digits it starts with."""
        path = "$['" + c.name.replace("\\", "\\\\").replace("'", "\\'") + "']"
        doc = F.try_parse_json("json")
        value = F.try_variant_get(doc, path, "variant")
        kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))

        def equals(v: Column, k: Column, want: str, bare: bool) -> Column:
            text = F.try_variant_get(v, "$", "string")
            same = (k == "STRING") & (text == want)
            if bare and want in ("true", "false"):
                same = ((k == "BOOLEAN") & (text == want)) | (~k.isin("STRING", "BOOLEAN") & (F.try_variant_get(v, "$", "double") == float(want == "true")))
            return F.coalesce(same, F.lit(False))

        items = F.try_variant_get(doc, path, "array<variant>")
        is_list = kind.startswith("ARRAY")
        if c.value == "*" and not c.quoted:
            has = F.when(is_list, F.exists(items, lambda x: F.schema_of_variant(x) != "VOID")).otherwise(kind != "VOID")
            has = F.coalesce(has, F.lit(False))
            return has if c.op == "=" else ~has
        if c.op == "~=" or isinstance(c.value, list):
            wanted = c.value if isinstance(c.value, list) else [c.value]

            def held(want: str) -> Column:
                return F.when(is_list, F.exists(items, lambda x: equals(x, F.schema_of_variant(x), want, False))).otherwise(equals(value, kind, want, False))

            holds = [held(w) for w in wanted]
            both = reduce(lambda a, b: a & b, [F.coalesce(h, F.lit(False)) for h in holds])
            return ~both if c.op == "!=" else both
        if c.op in ("=", "!=") and isinstance(c.value, str):
            same = equals(value, kind, c.value, not c.quoted)
            return same if c.op == "=" else ~same
        text = F.when(kind != "VOID", F.try_variant_get(doc, path, "string"))
        digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
        whole = F.when(text.isNotNull(), F.coalesce(F.when(digits != "", digits).try_cast("bigint"), F.lit(0).cast("bigint")))
        if isinstance(c.value, tuple):
            return whole.between(*(F.lit(_number(c, v)) for v in c.value))
        return _OPS[c.op](whole, F.lit(_number(c, c.value)))


def matching(graph: Graph, tree, kinds: list[str] | None = None, files_only: bool = False) -> DataFrame:
    """The nodes that match, of the given types if any. A conjunction's edge predicates become semi-joins, others marks."""
    if isinstance(tree, str):
        tree = parse(tree)
    if kinds is not None:
        kinds = [k for k in graph.manifest.types if k in kinds]
    kinds = scope(tree, graph.manifest, graph.ends, kinds) if not isinstance(tree, (Or, Not)) else kinds
    nodes = graph.nodes(kinds)
    if files_only and "parent_id" in nodes.columns:
        nodes = nodes.where("parent_id is null")
    if tree is None:
        return nodes
    compiler = Compiler(graph, kinds)
    compiler.has_source = "source" in nodes.columns and not graph.manifest.property("source")
    for x in _walk(tree):
        if isinstance(x, Compare) and x.name not in nodes.columns:
            extra = "json" if compiler.manifest.property(x.name) is None else x.name
            if extra not in nodes.columns:
                nodes = nodes.withColumn(extra, F.lit(None).cast(_column_type(compiler.manifest.property(x.name))))
        if isinstance(x, Since) and "modified" not in nodes.columns:
            nodes = nodes.withColumn("modified", F.lit(None).cast("timestamp_ntz"))
    plain = [p for p in parts_of(tree) if isinstance(p, (Compare, Since))]
    for p in plain:
        nodes = nodes.where(compiler.column(p))
    for p in parts_of(tree):
        if isinstance(p, (Edge, Tree, Names)):
            nodes = nodes.join(compiler.ids(p), "id", "left_semi")
        elif isinstance(p, Not) and isinstance(p.part, (Edge, Tree, Names)):
            nodes = nodes.join(compiler.ids(p.part), "id", "left_anti")
        elif p not in plain:
            seen = len(compiler.marks)
            cond = compiler.column(p)
            for m in compiler.marks[seen:]:
                nodes = nodes.join(m, "id", "left")
            nodes = nodes.where(cond)
    return nodes.drop(*(c for m in compiler.marks for c in m.columns if c != "id"))


def _column_type(p: Property | None) -> str:
    kinds = {"int": "bigint", "float": "double", "bool": "boolean", "list-of": "array<string>"}
    return kinds.get(p.kind, "string") if p else "string"


def near_name(name: str, known: list[str]) -> str:
    """A hint where a known name is one letter away."""
    close = [k for k in known if abs(len(k) - len(name)) <= 1 and sum(n for *_, n in _changes(name, k)) <= 1]
    return f"; did you mean {close[0]!r}?" if close else ""


def _changes(a: str, b: str) -> list[tuple[str, int]]:
    return [(tag, max(i2 - i1, j2 - j1)) for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]


def sort_keys(spec: str, manifest: Manifest = TABLES, kinds: list[str] | None = None) -> list[Column]:
    """+a,-b as columns; an enum sorts by its declared order in the types given, unknown members last."""
    out = []
    for part in spec.split(","):
        m = re.fullmatch(r"([+-]?)([A-Za-z_][A-Za-z0-9_-]*)", part.strip())
        if not m:
            raise FilterError(f"no sort key {part!r}")
        col, p = F.col(m[2]), manifest.property(m[2], kinds)
        if p is not None and p.kind == "enum":
            col = enum_place(col, p.values)
        out.append(col.desc_nulls_last() if m[1] == "-" else col.asc_nulls_first())
    return out


def enum_place(col: Column, values: tuple[str, ...]) -> Column:
    """A member's place in the declared order, unknown ones after all; null stays null."""
    known = reduce(lambda w, kv: w.when(col == kv[1], kv[0]), list(enumerate(values))[1:], F.when(col == values[0], 0))
    return known.otherwise(F.when(col.isNotNull(), len(values)))


def query(graph: Graph, text: str, sort: str | None = None, take: int | None = None, skip: int | None = None, files_only: bool = False) -> DataFrame:
    """Filter, order and window. skip needs take. Children asked for by a hierarchy that has an order come in it."""
    if skip is not None and take is None:
        raise FilterError("skip needs take")
    tree = parse(text)
    rows = matching(graph, tree, files_only=files_only)
    h = graph.manifest.hierarchies.get(tree.alias) if isinstance(tree, Tree) else None
    if sort:
        rows = rows.orderBy(*sort_keys(sort, graph.manifest, scope(tree, graph.manifest, graph.ends)), "id")
    elif h is not None and h.ordered_by and h.ordered_by in rows.columns:
        rows = rows.orderBy(F.coalesce(F.col(h.ordered_by), F.lit(0)), "id")
    if skip:
        rows = rows.offset(skip)
    return rows.limit(take) if take is not None else rows
