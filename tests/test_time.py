"""Quiet periods and windows over streams with late rows, as-of and interval joins, sketches and totals."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import hybrid, intervals, sketches
from loamgraph.streaming import windows

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def stream_of(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{k:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(folder))


def test_debounce_over_batches(spark, tmp_path):
    """A path's events in several micro-batches are one burst; its last event leaves once the path has been quiet."""
    schema = "path string, ts timestamp, kind string"
    batches = [[("a", at(0.0), "create"), ("b", at(0.1), "create")], [("a", at(0.4), "write")], [("a", at(0.8), "write"), ("b", at(0.9), "remove")], [("c", at(1.0), "create")], [("a", at(9.0), "remove")], [("z", at(60), "create")]]
    out, late = windows.settled(windows.debounced(stream_of(spark, tmp_path / "in", batches, schema), "path", "ts"))
    got = sorted((r.path, r.ts, r.kind, r.n) for r in out.collect())
    assert got == [("a", at(0.8), "write", 3), ("a", at(9.0), "remove", 1), ("b", at(0.1), "create", 1), ("b", at(0.9), "remove", 1), ("c", at(1.0), "create", 1)] and late == 0
    batch = windows.debounced(spark.createDataFrame([r for b in batches for r in b] + [("n", None, "x"), (None, at(3), "y")], schema), "path", "ts")
    assert {r.path for r in batch.collect()} == {"a", "b", "c", "z", None} and batch.count() == 7


def test_windows_with_late_rows(spark, tmp_path):
    """What is on time equals the batch; rows behind the watermark are dropped and counted."""
    schema = "id long, ts timestamp, user string, value double"
    rnd = random.Random(2)
    on_time = [[(100 * b + i, at(600 * b + rnd.randrange(600)), rnd.choice("uvw"), float(i)) for i in range(20)] for b in range(8)]
    late = [(9000, at(5), "u", 1.0), (9001, at(10), "v", 1.0)]
    batches = [*on_time[:6], late, *on_time[6:], [(9999, at(100_000), "end", 0.0)]]
    parts = [F.count("*").alias("n"), F.sum("value").alias("total")]
    whole = spark.createDataFrame([r for b in on_time for r in b], schema)

    def rows(df):
        return sorted(tuple(r) for r in df.where("user <> 'end'").collect())

    for k, slide in enumerate((None, "5 minutes")):
        stream = stream_of(spark, tmp_path / f"in{k}", batches, schema)
        got, dropped = windows.settled(windows.windowed(stream, "ts", ["user"], parts, "10 minutes", slide, "10 minutes"))
        assert rows(got) == rows(windows.windowed(whole, "ts", ["user"], parts, "10 minutes", slide))
        assert dropped == (2 if slide is None else 4)  # once for each window that a row is in
    stream = stream_of(spark, tmp_path / "in9", batches, schema)
    got, dropped = windows.settled(windows.sessions(stream, "ts", ["user"], parts, "2 minutes", "10 minutes"))
    assert rows(got) == rows(windows.sessions(whole, "ts", ["user"], parts, "2 minutes")) and dropped == 2


def plain_as_of(left, right, strict):
    out = []
    for key, t in left:
        before = [(rt, v) for rk, rt, v in right if rk == key and t is not None and rt is not None and (rt < t or not strict and rt == t)]
        out.append((key, t, max(before)[1] if before else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, strict):
    rnd = random.Random(strict)
    key = lambda: rnd.choice(["hot"] * 6 + ["a", "b", None])
    right = [(key(), rnd.choice([None, *range(400)]), rnd.randrange(50)) for _ in range(300)]
    left = [(key(), rnd.choice([None, *range(-5, 405)])) for _ in range(300)] + [("hot", 7)] * 20 + [("nowhere", 3)]
    got = intervals.as_of(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame(right, "k string, t long, v long"), ["k"], "t", ["v"], strict=strict)
    assert sorted(((r.k, r.t, r.last_v) for r in got.collect()), key=str) == plain_as_of(left, right, strict)
    free = intervals.as_of(spark.createDataFrame([(t,) for _, t in left], "t long"), spark.createDataFrame([(t, v) for _, t, v in right], "t long, v long"), [], "t", ["v"], strict=strict)
    assert sorted(((None, r.t, r.last_v) for r in free.collect()), key=str) == plain_as_of([(None, t) for _, t in left], [(None, t, v) for _, t, v in right], strict)
    none = intervals.as_of(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame([], "k string, t long, v long"), ["k"], "t", ["v"])
    assert none.where("last_v is not null").count() == 0 and none.count() == len(left)


def test_points_and_overlaps(spark):
    rnd = random.Random(8)
    spans = [(i, rnd.choice("xy"), lo := rnd.randrange(-500, 500), lo + rnd.choice([0, 0, 1, 3, 40, 900, -2])) for i in range(300)] + [(900, "x", None, 4), (901, "x", 4, None)]
    points = [(i, rnd.choice("xy"), rnd.randrange(-520, 520)) for i in range(300)] + [(900, "x", None)]
    a = spark.createDataFrame(spans, "i long, k string, lo long, hi long")
    p = spark.createDataFrame(points, "p long, k string, t long")
    good = [s for s in spans if None not in s]
    for closed in (True, False):
        want = sorted((q[0], s[0]) for q in points for s in good if q[2] is not None and q[1] == s[1] and s[2] <= q[2] and (q[2] <= s[3] if closed else q[2] < s[3]))
        assert sorted((r.p, r.i) for r in intervals.points_in(p, a, "t", "lo", "hi", ["k"], closed).collect()) == want
    b = a.select(F.col("i").alias("j"), "k", (F.col("lo") + 3).alias("lo2"), (F.col("hi") + 5).alias("hi2"))
    other = [(i, k, lo + 3, hi + 5) for i, k, lo, hi in good]
    want = sorted((x[0], y[0]) for x in good for y in other if x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r.i, r.j) for r in intervals.overlapping(a, b, ("lo", "hi"), ("lo2", "hi2"), ["k"]).collect()) == want
    assert intervals.points_in(p.limit(0), a, "t", "lo", "hi").count() == intervals.points_in(p, a.limit(0), "t", "lo", "hi").count() == 0


def test_innermost_of_many_sections(spark):
    """A file of 100,000 sections, each inside one of a few large ones: pairs that meet grow with the lines, not with their square."""
    n = 100_000
    sections = spark.range(n).select(F.lit("f").alias("file"), F.concat(F.lit("s"), "id").alias("id"), (F.col("id") * 3).alias("start_line"), (F.col("id") * 3 + 2).alias("end_line"))
    large = spark.range(20).select(F.lit("f").alias("file"), F.concat(F.lit("L"), "id").alias("id"), (F.col("id") * 15_000).alias("start_line"), (F.col("id") * 15_000 + 15_999).alias("end_line"))
    lines = spark.range(0, 3 * n, 2).select(F.lit("f").alias("file"), F.col("id").alias("line")).union(spark.createDataFrame([("f", 10**7), ("g", 1)], "file string, line long"))
    got = hybrid.innermost(sections.union(large), lines)
    assert got.where("section = concat('s', cast(line div 3 as string))").count() == 3 * n // 2 and got.where("section is null").count() == 2


def test_sketches_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 7001).alias("user"), F.pmod(F.hash("id"), F.lit(10_000)).cast("double").alias("x"))
    daily = sketches.sketched(rows, ["day"], ["user"], ["x"])
    got = sketches.estimates(sketches.merged(daily, []), [0.1, 0.5, 0.99]).first()
    assert got.n == 60_000 and abs(got.distinct_user - 7001) < 4 * 1.04 / 64 * 7001
    for p in (10, 50, 99):
        assert abs(rows.where(F.col("x") <= got[f"x_p{p}"]).count() / 60_000 - p / 100) < 4 * 1.65 / sketches.K


def test_totals_of_lists_and_nulls(spark):
    rows = spark.createDataFrame([("a", ["x", "y", "x"]), ("a", []), (None, ["x"]), ("b", None)], "k string, l array<string>")
    got = {(r.k, r.l, r.level): r.n for r in sketches.totals(rows, ["k", "l"], "cube", [F.count("*").alias("n")]).collect()}
    assert got[None, None, 3] == 5 and got["a", None, 1] == 3 and got["a", None, 0] == 1 and got[None, None, 1] == 1 and got[None, "x", 2] == 2
    with pytest.raises(ValueError):
        sketches.totals(rows, ["k"], "squares", [])


def test_totals_in_intervals_make_no_pairs(spark):
    rnd = random.Random(9)
    spans = [(i, rnd.choice(["x", "y", None]), lo := rnd.randrange(-500, 500), lo + rnd.choice([0, 0, 1, 3, 40, 900, -2])) for i in range(200)] + [(900, "x", None, 4), (901, "x", 4, None)]
    points = [(rnd.choice(["x", "y", None]), rnd.randrange(-520, 520), rnd.choice([None, *range(-9, 9)])) for _ in range(300)] + [("x", None, 3)] + [("x", 7, 1)] * 50
    a, p = spark.createDataFrame(spans, "i long, k string, lo long, hi long"), spark.createDataFrame(points, "k string, t long, v long")
    for closed in (True, False):
        for keys in (["k"], []):
            want = []
            for i, k, lo, hi in spans:
                of = [v or 0 for pk, t, v in points if None not in (lo, hi, t) and (not keys or k is not None and pk == k) and lo <= t and (t <= hi if closed else t < hi)]
                want += [(i, len(of), sum(of))] if of else []
            got = intervals.totals_in(p if keys else p.drop("k"), a, "t", "lo", "hi", ["v"], keys, closed)
            assert sorted((r.i, r.n, r.v) for r in got.collect()) == sorted(want)
    assert intervals.totals_in(p.limit(0), a, "t", "lo", "hi", ["v"]).count() == intervals.totals_in(p, a.limit(0), "t", "lo", "hi", ["v"]).count() == 0
    # 10^10 pairs as two running totals.
    many = intervals.totals_in(spark.range(100_000).select((F.col("id") % 1000).alias("t"), F.lit(1).alias("v")), spark.range(100_000).select("id", F.lit(0).alias("lo"), F.lit(999).alias("hi")), "t", "lo", "hi", ["v"])
    assert many.agg(F.sum("n")).first()[0] == 10**10
