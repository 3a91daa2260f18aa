import json

from loamgraph.operators.storage import kept
from loamgraph.sources import files
from loamgraph.streaming import changes

NOTE = """---
type: note
tags: [a, "b c"]
n: 3
---
# Top

Intro [[x]] `[[y]]`

## Sub
- [x] one
- two

> q1
> > q2

```go
x := 1
```

| a | b |
|---|---|
| 1 | 2 |

## Sib
Tail
"""


def test_markdown_units():
    node = files.parse_file("a.md", NOTE)
    assert (node["type"], node["title"], node["links"]) == ("note", "Top", ["x"])
    assert json.loads(node["properties"]) == {"n": 3, "tags": ["a", "b c"]}
    assert [(u["address"], u["payload"]) for u in node["units"]] == [
        ("S1", "Top"), ("S1P1", "Intro [[x]] `[[y]]`"), ("S1.1", "Sub"), ("S1.1L1", "one"), ("S1.1L2", "two"), ("S1.1Q1", "q1\nq2"), ("S1.1B1", "x := 1\n"),
        ("S1.1T1R0C0", "a"), ("S1.1T1R0C1", "b"), ("S1.1T1R1C0", "a: 1"), ("S1.1T1R1C1", "b: 2"), ("S1.2", "Sib"), ("S1.2P1", "Tail"),
    ]
    assert next(u for u in node["units"] if u["address"] == "S1.2P1")["start_line"] == NOTE.split("\n").index("Tail") + 1


def test_odd_texts():
    assert files.markdown_units("") == [] and files.front_block("---\nx") == ({}, "---\nx")
    assert [u["address"] for u in files.markdown_units("a\n\n---\n\nb")] == ["P1", "P2"]
    assert [u["kind"] for u in files.markdown_units("Head\n====\n\n```\nopen")] == ["section", "code-block"]
    assert files.page_text(None) == "" and files.parse_file("x.md", "no type")["error"] == "no type"


def test_page():
    source = '<html><head><meta name="node:type" content="memo"><title>t</title></head><body><h1>Hi <b>x</b></h1><p>a &amp; b<p>c<script>"</p>"</script><table><tr><th>k</th></tr><tr><td>v</td></tr></table><a href="b.html">l</a></body></html>'
    node = files.parse_file("a.html", source)
    assert node["type"] == "memo" and node["links"] == ["b.html"]
    assert [(u["address"], u["payload"]) for u in node["units"]] == [("S1", "Hi x"), ("S1P1", "a & b"), ("S1P2", "c"), ("S1T1R0C0", "k"), ("S1T1R1C0", "k: v")]
    assert files.page_text(source).split("\n\n")[:3] == ["Hi x", "a & b", "c"]


def _vault(folder):
    (folder / "d").mkdir()
    (folder / "d" / "a.md").write_text(NOTE.replace("[[x]]", "[[B]] [[B#one two]] [[B#none]] [[../c]] [[zz]] [[B#^blk]]"))
    (folder / "b.md").write_text("---\ntype: note\n---\n# One -- Two!\n\nbody ^blk\n")
    (folder / "c.html").write_text('<meta name="node:type" content="note"><p>c</p>')
    (folder / "z.txt").write_text("no")


def test_folder_and_links(spark, tmp_path):
    _vault(tmp_path)
    nodes = files.read_folder(spark, f"file://{tmp_path}").cache()
    assert {r.id: r.type for r in nodes.collect()} == {"d/a": "note", "b": "note", "c.html": "note"}
    assert files.units_of(nodes).where("id = 'd/a#S1.2P1'").first().text == "Tail"
    got = {r.link: (r.target, r.state) for r in files.resolved(nodes).collect()}
    assert got == {"B": ("b", "found"), "B#one two": ("b", "found"), "B#none": ("b", "missing-heading"), "../c": ("c.html", "found"), "zz": ("zz", "dangling"), "B#^blk": ("b", "found")}


def test_stream_of_files(spark, tmp_path):
    vault = tmp_path / "v"
    vault.mkdir()
    _vault(vault)
    seen = {}

    def apply(rows, number):
        for r in rows.select("path", "length").collect():
            seen[r.path.rsplit("/", 1)[-1]] = number

    changes.index_stream(changes.follow_files(spark, str(vault)), str(tmp_path / "ck"), apply).awaitTermination()
    assert set(seen) == {"a.md", "b.md", "c.html"}
    (vault / "e.md").write_text("new")
    changes.index_stream(changes.follow_files(spark, str(vault)), str(tmp_path / "ck"), apply).awaitTermination()
    assert seen["e.md"] > max(seen["a.md"], seen["b.md"])


def test_scan_opens_only_what_changed(spark, tmp_path):
    for name, text in (("a.md", "# A"), ("in/b.md", "# B"), ("c [1].html", "<p>c</p>"), ("no#id.md", "x"), ("reindex:x.md", "x"), ("out/skip.md", "x"), ("d.txt", "x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    root = f"file://{tmp_path}"
    nodes, state, faults = files.scan(spark, root, default_type="note", ignore="^out/")
    assert sorted(r.id for r in nodes.collect()) == ["a", "c [1].html", "in/b"]
    assert sorted(r.path for r in faults.collect()) == ["no#id.md", "reindex:x.md"]
    first = kept(state)
    assert {(r.path, r.state, r.generation) for r in first.collect()} == {("a.md", "live", 1), ("in/b.md", "live", 1), ("c [1].html", "live", 1)}
    # Nothing has changed: nothing is opened. Then one changes, one is new and one is gone.
    assert files.scan(spark, root, first, "note", "^out/")[0].count() == 0
    (tmp_path / "a.md").write_text("# A, longer")
    (tmp_path / "e.md").write_text("# E")
    (tmp_path / "in/b.md").unlink()
    nodes, state, _ = files.scan(spark, root, first, "note", "^out/")
    assert sorted(r.title for r in nodes.collect()) == ["A, longer", "E"]
    old = {r.path: r.content_hash for r in first.collect()}
    got = {r.path: r for r in state.collect()}
    assert {(p, r.state, r.generation) for p, r in got.items()} == {("a.md", "live", 2), ("e.md", "live", 2), ("c [1].html", "live", 2), ("in/b.md", "tombstone", 1)}
    assert got["c [1].html"].content_hash == old["c [1].html"] and got["a.md"].content_hash != old["a.md"]
    # A file with a colon in its name can't be opened by Hadoop's readers where a whole folder is read.
    (tmp_path / "reindex:x.md").unlink()
    many, files.LISTED = files.LISTED, 1
    try:
        assert files.scan(spark, root, None, "note", "^out/")[0].count() == 3
    finally:
        files.LISTED = many
