"""Requests, checks, changes and incremental work on small graphs."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loamgraph.functions import scalars
from loamgraph.functions.passages import passage
from loamgraph.functions.text import forms_of, stem_of, terms_of, tokens
from loamgraph.operators import hybrid, mutate, views
from loamgraph.plans import behaviors, checks, service
from loamgraph.plans.filter import Compare, FilterError, Names, Not, Since, glob_pattern, matching, parse, query, validate
from loamgraph.sources import files, manifest, mentions
from loamgraph.sources.graph import Frames, Graph
from loamgraph.streaming import queue

SF = "/root/testdata/sf0.001"
NODES = "id string, type string, path string, title string, parent_id string, source string, json string"


@pytest.fixture
def graph(spark):
    rows = [
        ("a", "note", "docs/a.md", "Alpha", None, None, '{"n": 3, "l": ["x", "y"], "done": true, "e": ""}'),
        ("b", "note", "docs/in/b.md", "Beta", None, None, '{"n": "3", "l": [], "done": 1, "m": null}'),
        ("c", "task", "c.md", "Alpha", None, "user", '{"n": 12.5, "l": "x", "done": "true"}'),
        ("d", "task", "d.md", "Delta", None, None, None),
        ("a#S1", "section", "docs/a.md", "Head", "a", "markdown", "{}"),
    ]
    edges = [("ref", "a", "b"), ("ref", "b", "c"), ("ref", "c", "a"), ("ref", "c", "gone"), ("up", "a", "d")]
    refs = [("a", "mentions", "src/x.py"), ("b", "mentions", "src"), ("c", "links", "src/y/z.py")]
    return Frames(spark.createDataFrame(rows, NODES), spark.createDataFrame(edges, "type string, source string, target string"), spark.createDataFrame(refs, "id string, type string, target string"))


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("n=3", "b"), ("n!=3", "a c d a#S1"), ('n="3"', "b"), ("n>2", "a b c"), ("n>3.5", "c"), ("n=2..4", "a b"), ("done=true", "a b"), ('done="true"', "c"), ("done!=true", "c d a#S1"),
        ("l=*", "a c"), ("l!=*", "b d a#S1"), ("e=*", "a"), ("m=*", ""), ("l~=x", "a c"), ("l=[y, x]", "a"), ("l!=[x]", "b d a#S1"), ("NOT n=3", "a c d a#S1"), ("title:Alpha", "a c"),
        ("type=note", "a b"), ("type=:task", "d"), ("type=user:task", "c"), ("type!=user:task", "a b d a#S1"), ("path=docs/**", "a b a#S1"), ("path!=docs/** title=*", "c d"),
        ("names-path=src/x.py", "a b"), ("names-path:mentions=src/**", "a"), ("names-path!=src/y/z.py", "a d a#S1"), ("ref->type=task", "b"), ("ref<-", "a b c"), ("ref->+id=b", "a b c"),
        ("NOT ref->", "d a#S1"), ("title=Alpha AND (n=12.5 OR ref->id=b)", "a"), ("up->title=Delta OR type=section", "a a#S1"),
    ],
)
def test_filters(graph, text, ids):
    assert sorted(r.id for r in matching(graph, text).collect()) == sorted(ids.split())


def test_files_only_and_clock(spark, graph):
    assert "a#S1" not in {r.id for r in query(graph, "", files_only=True).collect()}
    g = Graph(spark, SF, datetime(2024, 1, 31, tzinfo=UTC))
    assert 0 < query(g, "modified-since=48h").count() < query(g, "modified-since=2024-01-01").count()


@pytest.mark.parametrize("text", ["p_size!=1..2", "p_size<1..2", "p_size=x", "o_orderpriority>odd", "p_size>*", "words>[a]", "modified-since>1d", "modified-since=soon", "names-path>x", "urgent=maybe", "tree:odd=x", "words=small"])
def test_refused(spark, text):
    with pytest.raises(FilterError):
        query(Graph(spark, SF), text)


def test_parse_special():
    assert parse("modified-since:7d") == Since("7d") and parse('names-path:refs!="a*"') == Not(Names("a*", "refs", True))
    assert parse("status:done") == Compare("status", "=", "done") and parse("n:1..3") == Compare("n", "=", ("1", "3"))


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("docs/*/index.md", "docs/guide/index.md", "docs/a/b/index.md docs/index.md"), ("**/index.md", "index.md a/b/index.md", "docs/myindex.md"), ("docs/**/a*b.md", "docs/ab.md docs/x/y/ab.md", "docs/xa/yb.md"),
        ("docs/a**.md", "docs/abc.md", "docs/a/b.md"), ("**", "a a/b", ""), ("docs/**/**/i", "docs/i docs/a/b/i", "i"), ("notes/[a]+?/*", "notes/[a]+b/x", "notes/ab/x"), ("a/**", "a/b", "a ab/c"),
    ],
)
def test_globs(spark, glob, yes, no):
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in (*yes.split(), *no.split())], "x string").select("x", F.col("x").rlike(glob_pattern(glob)).alias("y")).collect()}
    assert got == {x: True for x in yes.split()} | {x: False for x in no.split()}


def test_validate_collects():
    assert len(validate(parse("placed-bi-> p_size=x type=ordr"), strict=True)) == 3 and not validate(parse("type=ordr"))


def test_stems_match(spark):
    words = "Nations tagging used rings bees plates cheese edly the running things sizes ease".split()
    got = spark.createDataFrame([(w,) for w in words], "w string").select(tokens("w").alias("t")).collect()
    assert [r.t for r in got] == [terms_of(w) for w in words]
    for w in words:
        assert w.lower() in forms_of(stem_of(w.lower())) or w == "the"


def test_manifest():
    good = '[types.a]\ntable="t"\nkey="k"\ntitle="k"\nodd=1\n[types.a.properties]\np={type="enum",values=["x"]}\n[edges.e]\ntable="t"\nsource="a"\nsource-key="k"\ntarget="a"\ntarget-key="j"\n[alias.q]\nfilter="p>y"\n[query.graph-expansion]\nenabled=true\nhops=3'
    m = manifest.loads(good)
    assert m.unknown == ("types.a.odd",) and m.expansion.merged(hops=1, weight=None).hops == 1
    for bad in ("x=", '[types.a]\ntable="t"', good.replace('"enum",values=["x"]', '"odd"'), good.replace('target="a"', 'target="b"'), good + "\n[query]\nlexical-weight=2"):
        with pytest.raises(manifest.ManifestError):
            manifest.loads(bad)
    with pytest.raises(manifest.ManifestError):
        manifest.merged({"types": {"a": {}}}, {"types": {"a": {}}})


def test_config_issues(spark):
    m = manifest.loads('odd=1\n[types.a]\ntable="t"\nkey="k"\ntitle="k"\n[alias.q]\nfilter="e->"\nskip=1\n[edges.e]\ntable="t"\nsource="a"\nsource-key="k"\ntarget="a"\ntarget-key="j"\n[query.graph-expansion]\nenabled=true\nhops=3\n[context]\ninclude=["nope"]\npinned=["a/1"]')
    kinds = {r.kind for r in checks.config_issues(spark, m, {"x": "1"}, {"x": "2"}).collect()}
    assert kinds == {"manifest-unknown-key", "graph-expansion-hops", "graph-expansion-edges", "alias-invalid", "context-invalid", "index-schema-stale"}
    assert checks.pinned_missing(m, spark.createDataFrame([("a/2",)], "id string")).count() == 1


def test_request_errors(graph):
    for r in (service.Request("n=", include=("odd",)), service.Request(include=("bodi",)), service.Request(fields=("pth",)), service.Request(skip=1), service.Request(semantic="x"), service.Request(semantic="x", count=True), service.Request(count=True, group_by="id")):
        with pytest.raises((FilterError, ValueError)):
            service.run(graph, r)


def test_count_groups(spark, graph):
    got = [tuple(r) for r in service.run(graph, service.Request(group_by="l")).collect()]
    assert got == [(None, 3), ('"x"', 2), ('"y"', 1)]
    assert service.run(graph, service.Request("type=note", count=True)).first().n == 2
    numbers = spark.createDataFrame([('{"n":1}',), ('{"n":1.0}',), ('{"n":"1"}',), ("{}",)], "json string")
    from loamgraph.operators.aggregate import count_by_json

    assert [tuple(r) for r in count_by_json(numbers, "n").collect()] == [("1", 2), ('"1"', 1), (None, 1)]


def test_rows_shown(spark):
    g = Graph(spark, SF)
    r = service.get(g, "order/1", ("properties", "edges")).first()
    assert r.properties["o_orderstatus"] and [e.type for e in r.edges] == sorted(e.type for e in r.edges)
    line = service.as_lines(service.run(g, service.Request("type=nation", sort="title", take=1))).first().line
    assert line.count("\t") == 3
    assert "null" not in service.as_json(g.nodes(["region", "customer"])).first().json
    assert set(service.digest(g)) == {"pinned", "recent"}


def test_section_fold_and_spread(spark):
    files = spark.createDataFrame([(x, "note", f"{x}.md", t) for x, t in (("f", "River"), ("g", "Lake"), ("h", "Hill"))], "id string, type string, path string, title string")
    leaf = "id string, chunk int, ordinal int, parent string, body string, vector array<float>, model string"
    leaves = [("f#P1", 0, 1, "f", "start", [1.0, 0.0], "m"), ("f#S1P1", 0, 3, "f#S1", "one", [0.8, 0.6], "m"), ("f#S1P2", 0, 4, "f#S1", "two", [0.8, 0.6], "m"), ("g#P1", 0, 1, "g", "old", [1.0, 0.0], "stale")]
    whole = spark.createDataFrame([("g", 0, "whole g", [0.6, 0.8], "m"), ("h", 0, "bad", [1.0], "m")], "id string, chunk int, body string, vector array<float>, model string")
    chunks = hybrid.candidates(files, spark.createDataFrame(leaves, leaf), whole, "m")
    sections = spark.createDataFrame([("f#S1",)], "id string")
    plain = hybrid.Settings(title_weight=0.0, take=9)
    got = hybrid.search(files, chunks, "river", [1.0, 0.0], plain, sections=sections).collect()
    assert [(r.id, round(r.score, 3), r.units_total) for r in got] == [("f", 1.0, 2), ("g", 0.6, 1)]
    assert [(u.id, u.leaf) for u in got[0].units] == [("f#P1", "f#P1"), ("f#S1", "f#S1P1")] and got[0].units[1].snippet == "one"
    near = spark.createDataFrame([("f", "h"), ("h", "f")], "id string, other string")
    spread = hybrid.Settings(title_weight=0.5, take=1, expansion=manifest.Expansion(enabled=True, multiplier=1, weight=0.5))
    got = hybrid.search(files, chunks, "river", [1.0, 0.0], hybrid.Settings(**{**spread.__dict__, "take": 1}), near, files, sections).collect()
    assert [(r.id, r.distance) for r in got] == [("f", 0)]
    wide = hybrid.search(files, chunks, "river", [1.0, 0.0], hybrid.Settings(**{**spread.__dict__, "take": 1, "skip": 1}), near, files, sections).collect()
    assert [(r.id, r.distance, r.score, r.units_total) for r in wide] == [("h", 1, 0.5, 0)]
    spans = spark.createDataFrame([("f#P1", 1, 1, 1), ("f#S1P1", 3, 3, 4), ("f#S1P2", 4, 6, 6)], "id string, ordinal int, start_line int, end_line int")
    body = spark.createDataFrame([("f", "start\n\nhead\none\n\ntwo")], "id string, body string")
    found = hybrid.search(files, chunks, "river", [1.0, 0.0], plain, sections=sections)
    assert [(r.id, r.text, r.first, r.last) for r in hybrid.with_passages(found, body, spans, 11).collect()] == [("f", "start", 1, 1), ("g", None, None, None)]


def test_passages():
    text = "\n".join(f"line {i}" for i in range(1, 10))
    assert passage(text, [(1, 2), (4, 5), (7, 7)], 1, 21) == ("line 4\nline 5\n\n".strip() + "\nline 6\nline 7"[:0], 4, 5)
    assert passage(text, [(1, 2), (4, 5), (7, 7)], 1, 999)[1:] == (1, 7)
    assert passage("aa bb cc dd", [(1, 1)], 0, 7) == ("aa bb…", 1, 1)


def test_refused_changes(spark):
    g = Graph(spark, SF)
    nodes, edges = g.nodes(["region", "nation", "customer"]), g.edges("in-region").select(F.lit("in-region").alias("type"), "source", "target").withColumns({"kind": F.lit("direct"), "position": F.lit(1)})
    m = g.manifest
    for kind, a, b in (("odd", "nation/1", "region/1"), ("in-region", "nation/1", "nation/2"), ("in-region", "nation/99", "region/1"), ("in-region", "nation/1", "region/3")):
        with pytest.raises(mutate.Refused):
            mutate.add_edge(nodes, edges, kind, a, b, m)
    assert mutate.add_edge(nodes, mutate.remove_edge(edges, "in-region", "nation/1", "region/1"), "in-region", "nation/1", "region/1", m).count() == edges.count()
    with pytest.raises(mutate.Refused):
        mutate.move(nodes, edges, spark.createDataFrame([("nation/1", "nation/2", "x")], "old string, new string, path string"))
    with pytest.raises(mutate.Refused):
        mutate.written(nodes, edges, nodes.where("id = 'nation/1'"), edges.limit(0), create=True)


def test_front_and_link_edges(spark):
    rows = spark.createDataFrame([("n", {"in-region": ["r1", "r2"], "size": ["3"]})], "id string, props map<string,array<string>>")
    left, edges = mutate.front_edges(rows, "props", manifest.TABLES)
    assert left.first().props == {"size": ["3"]} and [(r.target, r.position) for r in edges.collect()] == [("r1", 1), ("r2", 2)]
    links = spark.createDataFrame([("n", "t", 2), ("n", "t", 1), ("n", None, 3)], "source string, target string, position int")
    assert sorted((r.type, r.position) for r in mutate.link_edges(links, ["x", "y"]).collect()) == [("x", 1), ("y", 1)]
    units = spark.createDataFrame([("f#S1", "f", 1), ("f", None, None)], "id string, parent_id string, ordinal int")
    assert [(r.source, r.target) for r in mutate.contains(units).collect()] == [("f", "f#S1")]


def test_delete_names_referrers(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("a#S1",)], "id string")
    edges = spark.createDataFrame([("r", "b#S2", "a#S1", "derived"), ("r", "a", "b", "direct")], "type string, source string, target string, kind string")
    n, e, again = mutate.delete(nodes, edges, spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in n.collect()] == ["b"] and e.count() == 1 and [r.id for r in again.collect()] == ["b"]


def test_drain_reuses_and_reports(spark):
    @__import__("dataclasses").dataclass
    class Picky:
        model: str = "m"

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[float(len(t)), 1.0] for t in texts]

    chunks = spark.createDataFrame([("f", 0, "h1", "one"), ("g", 0, "h1", "one"), ("g", 1, "h2", "bad two"), ("h", 0, "h3", "three")], "id string, chunk int, content_hash string, body string")
    vectors = spark.createDataFrame([("h3", "m", [9.0, 9.0]), ("dead", "m", [0.0, 0.0])], "content_hash string, model string, vector array<float>")
    now, failures = queue.drain(chunks, vectors, Picky())
    assert {r.content_hash: r.vector[0] for r in now.collect()} == {"h1": 3.0, "h3": 9.0}
    assert [(r.content_hash, r.error) for r in failures.collect()] == [("h2", "RuntimeError: no")]
    files = spark.createDataFrame([("h",)], "id string")
    assert queue.has_vectors(chunks, now, files, "m") and not queue.has_vectors(chunks, now, files, "other")
    assert queue.vectors_of(chunks, now, files, "m").count() == 1


def test_hashing_embedder_and_settings():
    e = queue.HashingEmbedder()
    a, b, c = e.embed(["red plate", "red plates", "deep ocean"])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert dot(a, b) > dot(a, c) and abs(dot(a, a) - 1) < 1e-9 and queue.vector_key("m", 4) != queue.vector_key("m")
    assert queue.forced({"a": "1", "b": "2"}, {"a": "1", "b": "3"}) == ["b"] and queue.forced(None, {"a": "1"}) == ["a"]


def test_signal(spark):
    s, t = queue.Signal(), spark.range(3)
    assert s.poll(t) and not s.poll(t) and s.poll(spark.range(4)) and s.generation == 2
    s.reset()
    assert (s.epoch, s.generation) == (1, 0) and s.poll(t)


def test_sync_heal_and_reindex(spark):
    units = "id string, content_hash string, ordinal int"
    stored, parsed = spark.createDataFrame([("f#1", "a", 1), ("g#1", "b", 1)], units), spark.createDataFrame([("f#2", "c", 1)], units)
    assert {r.id for r in queue.synced(stored, parsed, spark.createDataFrame([("f",)], "id string")).collect()} == {"f#2", "g#1"}
    refs = spark.createDataFrame([("a", None, "dangling"), ("b", "x", "ok"), ("c", "y", "ok")], "source string, target string, state string")
    assert {r.id for r in queue.to_heal(refs, spark.createDataFrame([("x",)], "id string")).collect()} == {"a", "b"}
    rows = "path string, modified int, content string"
    got = queue.reindexed(spark.createDataFrame([("p", 1, "old"), ("q", 1, "keep"), ("r", 1, "go")], rows), spark.createDataFrame([("p", 2, "mid"), ("p", 3, "new"), ("r", 4, None), ("s", 5, "add")], rows))
    assert {(r.path, r.content) for r in got.collect()} == {("p", "new"), ("q", "keep"), ("s", "add")}


def test_more_checks(spark):
    links = spark.createDataFrame([("f#S1", "x", "dangling"), ("f#S2", "x", "dangling"), ("f", "y", "ambiguous"), ("g", "z#h", "missing-heading"), ("g", "ok", "ok")], "source string, link string, state string")
    got = {(r.kind, r.node_id): r.locations for r in checks.link_issues(links).collect()}
    assert got == {("dangling-edge", "f"): ["f#S1", "f#S2"], ("ambiguous-wikilink", "f"): [], ("missing-heading", "g"): []}
    failures = spark.createDataFrame([("a", 1, "e"), ("b", 3, None)], "id string, attempts int, error string")
    assert {r.node_id: r.kind for r in checks.embed_failures(failures).collect()} == {"a": "embed-retry", "b": "embed-failed"}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [r.node_id for r in checks.without_chunks(ids("a", "b", "c"), ids("a"), ids("b")).collect()] == ["c"]
    assert checks.prefix_hint(spark, "m:1", {"m": "query: "}, "").count() == 1 and checks.prefix_hint(spark, "m", {"m": "q"}, "q").isEmpty()
    assert checks.skipped(spark.createDataFrame([("p", "broken"), ("q", None)], "path string, error string")).count() == 1
    units = spark.createDataFrame([("f", None), ("f#1", "f")], "id string, parent_id string")
    assert checks.units_left(units, False).count() == 1 and checks.units_left(units, True).isEmpty()
    assert checks.large_chunks(spark.createDataFrame([("a", "xxx"), ("b", "x")], "id string, body string"), 2).first().severity == "advice"
    edges = spark.createDataFrame([("old-e", "a", "b")], "type string, source string, target string")
    assert checks.legacy_edges(edges, {"old-e": "legacy-cli-edge"}).first().kind == "legacy-cli-edge"
    assert checks.workflow_states(spark.createDataFrame([("a", "odd"), ("b", "open"), ("c", None)], "id string, state string"), {"open": []}).count() == 1
    assert [r.node_id for r in checks.unused_exemptions(spark.createDataFrame([("a", "r"), ("b", "r")], "id string, rule string"), spark.createDataFrame([("a", "r")], "id string, rule string")).collect()] == ["b"]
    refs = spark.createDataFrame([("a", "v", "t", None, "dangling"), ("b", "v", "t", "x", "ok")], "source string, value string, type string, target string, state string")
    assert [r.kind for r in checks.ref_issues(refs).collect()] == ["ref_dangling"]
    rows = spark.createDataFrame([("warning", "b", "1", ""), ("advice", "a", "1", ""), ("error", "z", "1", "")], "severity string, kind string, node_id string, message string")
    assert [r.severity for r in checks.ordered(rows).collect()] == ["error", "warning", "advice"]


def test_views_of_a_tree(spark, graph):
    nodes = graph.nodes().withColumn("ordinal", F.lit(1))
    edges = graph._edges.withColumn("kind", F.lit("direct"))
    assert [r.id for r in views.unit_tree(nodes, edges, "a").collect()] == ["a#S1"]
    assert [r.id for r in views.reading_index(nodes).collect()] == ["c", "d", "a", "b"]
    d = views.detail(nodes, edges, spark.createDataFrame([("a",)], "id string")).first()
    assert [(x.type, x.direction, x.other) for x in d.neighbors] == [("ref", "in", "c"), ("ref", "out", "b"), ("up", "out", "d")]
    assert views.edge_list(edges, source="a").count() == 2 and views.community_edges(edges, ["up"], ["structural"]).count() == 1
    links = spark.createDataFrame([("x", "beta", None), ("x", "alpha", None), ("x", "q", "z")], "source string, link string, target string")
    assert {r.link: r.target for r in views.link_map(links, nodes).collect()} == {"beta": "b", "alpha": None, "q": "z"}
    refs = spark.createDataFrame([("a", "m", "src/x", 4), ("a", "m", "src/x", 2), ("a", "m", "src/y", 9)], "id string, type string, target string, line int")
    sections = spark.createDataFrame([("a", "a#S1", 1, 9), ("a", "a#S2", 2, 3)], "file string, id string, start_line int, end_line int")
    got = views.path_list(refs, spark.createDataFrame([("src/x",)], "path string"), sections).first().paths
    assert [(p.target, p.lines, p.exists, p.section) for p in got] == [("src/x", [2, 4], True, "a#S2"), ("src/y", [9], False, "a#S1")]
    outline = hybrid.outline(nodes.where("parent_id is not null").withColumn("kind", F.col("type"))).first()
    assert [u.id for u in outline.units] == ["a#S1"]
    assert {r.id: r.group for r in views.grouped(graph.nodes(), graph._edges, "ancestor", parents=graph.edges("up")).collect()}["a"] == "d"


def test_scalars(spark):
    row = spark.createDataFrame([("Page#A#B|shown", "./a//b/", "src/x.py", "not a path", "", None)], "l string, p string, c string, n string, e string, z string")
    page, rest = scalars.fragment(F.col("l"))
    got = row.select(page, rest, scalars.path_clean(F.col("p")), scalars.regexp("^a", F.col("z")), scalars.header(F.lit("T"), F.array(F.lit("h"), F.col("z"), F.col("e"))), scalars.block_key(F.lit("Ab")), scalars.payload(F.lit("body"), F.lit("T"), "title", prefix="{title}: ")).first()
    assert tuple(got) == ("Page", "A#B", "a/b", None, "T > h", "^ab", "T: T\n\nbody")
    scalars.register(spark)
    assert spark.sql("select regexp_of('^a', 'abc') as x").first().x


def test_mentions():
    text = "see `src/x.py:12` and `Makefile`\n`not a path` [t](../up.md#h) ![i](img/a.png)\n```\n`src/no.py`\n```\n[out](../../x) [web](http://e.org/a) `a/b/`\n"
    assert mentions.mentions("docs/n.md", text) == [("src/x.py", 1), ("Makefile", 1), ("up.md", 2), ("docs/img/a.png", 2), ("a/b", 6)]
    page = "<p><code>src/x.py</code><pre><code>src/n.py</code></pre><a href='/top/y'>y</a><img src='i.png'>"
    assert mentions.mentions("docs/p.html", page) == [("src/x.py", None), ("top/y", None), ("docs/i.png", None)]
    assert [mentions.candidate(x) for x in ("a", "../a/b", "x=1.2", "...", "a//b/", "v1.2-x")] == [None, None, None, None, "a/b", "v1.2-x"]


def test_lines():
    source = "a\r\nb\u2028c\n".encode()
    assert [mentions.Lines(source, s).line(len(source) - 1) for s in ("lf", "universal", "unicode")] == [2, 2, 3]
    t = mentions.Lines(b"ab\ncd")
    assert [t.offset(n) for n in (0, 1, 2, 3)] == [0, 0, 3, 5] and [t.line(i) for i in (0, 2, 3)] == [1, 1, 2]


def test_ignored(spark):
    patterns = mentions.ignore_pattern(["# c", "*.log", "!keep.log", "/build", "tmp/", "a/**/z"])
    want = {".git/x": True, "x.log": True, "d/x.log": True, "d/keep.log": False, "build/o": True, "d/build": False, "d/tmp/q": True, "tmp": False, "a/z": True, "a/b/z": True, "b/a/z": False, "n.md": False}
    rows = spark.createDataFrame([(p,) for p in want], "p string").select("p", mentions.ignored(F.col("p"), patterns).alias("i")).collect()
    assert {r.p: r.i for r in rows} == want


def test_links_led_anew(spark):
    rows = [("a.md", "type: x", "---\ntype: note\n---\n[[b]] [[zz]]"), ("in/b.md", "", "---\ntype: note\n---\ntext `src/q.py`")]
    source = spark.createDataFrame([(p, s, "h") for p, _, s in rows], "path string, source string, content_hash string")
    nodes = files.parsed(source)
    edges = spark.createDataFrame([("ref", "a", "old/b", "b"), ("ref", "a", "in/b", None), ("ref", "a", "zz", "zz")], "type string, source string, target string, link string")
    assert sorted(r.target for r in mentions.relinked(edges, nodes).collect()) == ["in/b", "zz"]
    assert [(r.id, r.target, r.line) for r in mentions.path_refs(source).collect()] == [("in/b", "src/q.py", 4)]
    units = spark.createDataFrame([("in/b#P1",), ("no#P1",)], "id string")
    assert {r.id: r.file_type for r in mentions.with_files(units, nodes).collect()} == {"in/b#P1": "note", "no#P1": None}


def test_behaviours(spark):
    nodes = spark.createDataFrame([("a", "task", "open"), ("b", "note", None)], "id string, type string, state string")
    edges = spark.createDataFrame([], "type string, source string, target string, kind string, position int")
    seen = []
    pack = behaviors.workflow("flow", "task", "state", {"open": ["done"], "done": []}, ["open"])
    pack.reactors["node"] = [lambda before, after: seen.append((before.count(), after.count()))]
    write = lambda rows, **k: behaviors.write_nodes([pack], nodes, edges, spark.createDataFrame(rows, nodes.schema), edges, **k)
    assert {r.id: r.state for r in write([("a", "task", "done")])[0].collect()} == {"a": "done", "b": None}
    for rows in ([("a", "task", "odd")], [("c", "task", "done")], [("a", "task", None)]):
        with pytest.raises(mutate.Refused):
            write(rows)
    assert write([("c", "task", "open")], create=True)[0].count() == 3 and seen == [(1, 1), (0, 1)]
