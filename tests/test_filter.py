import re
from pathlib import Path

import duckdb
import pytest

from loamgraph.functions.text import tokens
from loamgraph.operators.traverse import reach
from loamgraph.plans import catalog
from loamgraph.plans.filter import And, Compare, Edge, FilterError, Not, Or, glob_pattern, parse, query
from loamgraph.sources.graph import Graph

SF = "/root/testdata/sf0.001"


def test_parse_precedence():
    tree = parse('a=1 AND b=2 OR NOT c="x y"')
    assert isinstance(tree, Or) and isinstance(tree.parts[0], And) and isinstance(tree.parts[1], Not)
    assert tree.parts[1].part == Compare("c", "=", "x y", True)


def test_parse_edges():
    tree = parse("e->{2,4}f<-id=x")
    assert (tree.name, tree.out, tree.least, tree.most) == ("e", True, 2, 4)
    assert isinstance(tree.inner, Edge) and not tree.inner.out
    assert parse("e->+").most is None


@pytest.mark.parametrize("text", ["a=", "=1", "a=1)", "e->{0}", "e->{3,2}", "(a=1"])
def test_parse_errors(text):
    with pytest.raises(FilterError):
        parse(text)


@pytest.mark.parametrize(("glob", "yes", "no"), [("a/**", ["a/b", "a/b/c"], ["a"]), ("a/*", ["a/b"], ["a/b/c"]), ("?.md", ["x.md"], ["xy.md", "x.md\n"])])
def test_glob(glob, yes, no):
    pattern = glob_pattern(glob).replace(r"\z", r"\Z")
    assert all(re.search(pattern, x) for x in yes) and not any(re.search(pattern, x) for x in no)


def test_skip_needs_take(spark):
    with pytest.raises(FilterError):
        query(Graph(spark, SF), "type=region", skip=1)


def test_tokens(spark):
    got = spark.sql("select 'Hub.Broadcast([]byte) fans OUT' as x").select(tokens("x").alias("t")).first().t
    assert got == ["hub", "broadcast", "byt", "fan", "out"]


def test_cycle_walk(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    d, b = spark.createDataFrame([("d",)], "id string"), spark.createDataFrame([("b",)], "id string")
    assert {r.id for r in reach(ring, d, 1, None).collect()} == {"a", "b", "c"}
    assert {r.id for r in reach(ring, b, 4, 4).collect()} == {"a"}


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = lambda rs, names: sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rs)
    assert rows(map(tuple, df.collect()), df.columns) == rows(want.fetchall(), list(want.columns))
