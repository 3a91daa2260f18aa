"""Registered queries over events in time: quiet periods, windows, as-of and interval joins, sketches and totals; with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.operators import intervals, sketches
from loamgraph.sources.graph import Graph
from loamgraph.streaming import windows

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _totals():
    return [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")]


def _events(spark, sf):
    return Graph(spark, sf).table("events").withColumn("ts", F.col("ts").cast("timestamp"))


def _debounced(spark, sf):
    rows = _events(spark, sf).select("user_id", "ts", "event_id", "event_type")
    return windows.debounced(rows, "user_id", "ts", "12 hours").select("user_id", "event_id", "event_type", "n")


def _named(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end") if c in df.columns}).withColumnsRenamed({"start": "starts", "end": "ends"})


def _tumbling(spark, sf):
    return _named(windows.windowed(_events(spark, sf), "ts", ["event_type"], _totals(), "1 day"))


def _sliding(spark, sf):
    return _named(windows.windowed(_events(spark, sf), "ts", ["event_type"], _totals(), "1 day", "6 hours"))


def _sessions(spark, sf):
    return _named(windows.sessions(_events(spark, sf), "ts", ["user_id"], _totals(), "1 day")).drop("ends")


def _streamed(spark, sf):
    """The windows of the day as a stream leaves them once all events are in."""
    stream = windows.follow(spark, f"{sf}/events.parquet", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    return _named(windows.settled(windows.windowed(stream, "ts", ["event_type"], _totals(), "1 day"), "complete")[0])


def _as_of(keys, strict):
    def run(spark, sf):
        e = _events(spark, sf).select("event_id", "user_id", "event_type", "ts", "value")
        left, right = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen"), "value")
        return intervals.as_of(left, right, keys, "ts", ["seen", "value"], strict=strict).select("event_id", "last_seen", "last_value")

    return run


def _bands(spark, sf):
    """How many suppliers' balances lie within a part's size, times ten, of its price."""
    g = Graph(spark, sf)
    balances = g.table("supplier").select("s_suppkey", F.floor("s_acctbal").alias("balance"))
    price, width = F.floor("p_retailprice"), F.col("p_size") * 10
    parts = g.table("part").select("p_partkey", (price - width).alias("low"), (price + width).alias("high"))
    held = intervals.totals_in(balances, parts, "balance", "low", "high", ["balance"])
    return held.groupBy("p_partkey").agg(F.sum("n").alias("n"), F.sum("balance").alias("balances"))


def _overlaps(spark, sf):
    """Pairs of a user's views and purchases whose lengths of time, their value in hours, overlap."""
    e = _events(spark, sf).where("value is not null")
    begin = F.unix_micros("ts")
    end = begin + F.round(F.col("value") * 3.6e9 / 24).cast("long")
    one = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("a"), begin.alias("a0"), end.alias("a1"))
    two = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), begin.alias("b0"), end.alias("b1"))
    return intervals.overlapping(one, two, ("a0", "a1"), ("b0", "b1"), ["user_id"]).select("a", "b")


def _rollup(spark, sf):
    return sketches.totals(Graph(spark, sf).nodes(["order"]), ["o_orderstatus", "o_orderpriority"], "rollup", [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")])


def _cube(spark, sf):
    return sketches.totals(Graph(spark, sf).nodes(["part"]), ["p_brand", "words"], "cube", [F.count("*").alias("n")])


def _sketches(spark, sf):
    """Sketches of lines by ship month, merged to return flags: within four times the error that their size allows."""
    lines = Graph(spark, sf).table("lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    by_month = sketches.sketched(lines, ["l_returnflag", "month"], ["l_partkey"], ["l_extendedprice"])
    got = sketches.estimates(sketches.merged(by_month, ["l_returnflag"]), [0.5])
    exact = lines.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"))
    below = lines.join(F.broadcast(got.select("l_returnflag", "l_extendedprice_p50")), "l_returnflag").groupBy("l_returnflag").agg(F.avg((F.col("l_extendedprice") <= F.col("l_extendedprice_p50")).cast("double")).alias("rank"))
    near = F.abs(F.col("distinct_l_partkey") - F.col("parts")) <= 4 * 1.04 / 2 ** (sketches.HLL / 2) * F.col("parts") + 1
    return got.join(exact, "l_returnflag").join(below, "l_returnflag").select("l_returnflag", "n", "parts", near.alias("near"), (F.abs(F.col("rank") - 0.5) <= 4 * 1.65 / sketches.K).alias("middle"))


QUERIES = {
    "m01_debounced": _debounced,
    "m12_tumbling": _tumbling,
    "m12_sliding": _sliding,
    "m12_sessions": _sessions,
    "m12_stream": _streamed,
    "j24_as_of": _as_of(["user_id"], False),
    "j24_as_of_one_key": _as_of([], True),
    "j24_points_in": _bands,
    "j24_overlaps": _overlaps,
    "a18_rollup": _rollup,
    "a18_cube": _cube,
    "a18_sketches": _sketches,
}

_AS_OF = "WITH v AS (SELECT user_id, ts, max(struct_pack(seen := event_id, value := value)) AS v FROM events WHERE event_type = 'view' GROUP BY ALL), p AS (SELECT * FROM events WHERE event_type = 'purchase') SELECT event_id, v.v.seen AS last_seen, v.v.value AS last_value FROM p ASOF LEFT JOIN"
_DAY = "SELECT date_trunc('day', ts)::TIMESTAMP AS starts, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS ends, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
_GAPS = "WITH g AS (SELECT *, sum(CASE WHEN ts - before <= INTERVAL {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))"

ORACLE_SQL = {
    "m01_debounced": _GAPS.format(gap="12 HOUR") + " SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM g GROUP BY user_id, burst",
    "m12_tumbling": _DAY,
    "m12_stream": _DAY,
    "m12_sliding": "SELECT starts, starts + INTERVAL 1 DAY AS ends, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 6 HOUR * k AS starts, event_type, value FROM events, unnest([0, 1, 2, 3]) AS t(k)) GROUP BY ALL",
    "m12_sessions": _GAPS.format(gap="1 DAY") + " SELECT min(ts) AS starts, user_id, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, burst",
    "j24_as_of": f"{_AS_OF} v ON p.user_id = v.user_id AND p.ts >= v.ts",
    "j24_as_of_one_key": f"{_AS_OF.replace('user_id, ts, max', 'ts, max')} v ON p.ts > v.ts",
    "j24_points_in": "SELECT p_partkey, count(*) AS n, sum(floor(s_acctbal))::BIGINT AS balances FROM part JOIN supplier ON floor(s_acctbal) BETWEEN floor(p_retailprice) - 10 * p_size AND floor(p_retailprice) + 10 * p_size GROUP BY p_partkey",
    "j24_overlaps": "WITH e AS (SELECT *, epoch_us(ts) AS lo, epoch_us(ts) + round(value * 3.6e9 / 24)::BIGINT AS hi FROM events WHERE value IS NOT NULL) SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.lo <= b.hi AND b.lo <= a.hi WHERE a.event_type = 'view' AND b.event_type = 'purchase'",
    "a18_rollup": "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "a18_cube": "SELECT p_brand, words, grouping(p_brand, words)::BIGINT AS level, count(*) AS n FROM (SELECT DISTINCT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS words FROM part) GROUP BY CUBE (p_brand, words)",
    "a18_sketches": "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, true AS near, true AS middle FROM lineitem GROUP BY l_returnflag",
}
