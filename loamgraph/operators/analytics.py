"""Components, ancestors, communities, cycles and pooled vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators.components import star_components
from loamgraph.operators.storage import apart, drop, kept
from loamgraph.operators.traverse import reach

#: Rounds of moves on one level, and levels, at most.
MOVES, LEVELS = 32, 20


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge: the smallest id reachable, by alternating large and small stars."""
    stars = star_components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    known = stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
    known = known.union(stars.select("b", "b").distinct())
    loops = edges.where("source = target").select(F.col("source").alias("id"), F.col("source").alias("component")).distinct()
    return known.union(loops.join(apart(known), "id", "left_anti"))


def ancestors(parents: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, ancestor) for every end of an edge (child source, parent target): the depth-th ancestor, or the
    topmost one of a shorter chain; the root without a depth. A child's smallest parent counts.

    Roots are found by doubling the step each round, so a chain of N takes log N joins. On a cycle the group
    is the cycle's smallest id.
    """
    up = kept(parents.where("source <> target").groupBy("source").agg(F.min("target").alias("target")))
    every = up.select(F.col("source").alias("id")).union(up.select("target")).distinct()
    now = every.join(up.withColumnRenamed("source", "id"), "id", "left").select("id", F.coalesce("target", "id").alias("ancestor"))
    if depth is not None:
        for _ in range(depth - 1):
            step = up.select(F.col("source").alias("ancestor"), F.col("target").alias("next"))
            now = now.join(step, "ancestor", "left").select("id", F.coalesce("next", "ancestor").alias("ancestor"))
        return now
    now = kept(now.withColumn("least", F.least("id", "ancestor")))
    size, reach = now.count(), 1
    while reach < 2 * size:
        far = now.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("least").alias("far"))
        later = kept(now.join(far, "ancestor").select("id", F.col("next").alias("ancestor"), F.least("least", "far").alias("least")))
        reach *= 2
        moved = later.join(now, "id").where(later.ancestor != now.ancestor).isEmpty()
        now = later
        if moved:
            break
    # What still has a parent lies on a cycle or below one.
    cyclic = now.join(up.select(F.col("source").alias("ancestor")), "ancestor", "left_semi").select("id", F.col("ancestor").alias("on"))
    far = now.select(F.col("id").alias("on"), F.col("least").alias("group"))
    marked = now.join(cyclic.join(far, "on").select("id", "group"), "id", "left")
    return marked.select("id", F.coalesce("group", "ancestor").alias("ancestor"))


def _moves(both: DataFrame, now: DataFrame, total: float, resolution: float) -> tuple[DataFrame, bool]:
    """now (id, strength, community) after rounds of moves along both (id, other, w), each edge in both directions, and whether
    any was made.

    Each round finds for every node the neighbouring community that gains most modularity over staying. Of the nodes that
    would move, those go whose lot, drawn by hash for the round, is the highest among their neighbours that would, too: no
    two neighbours move at once, as if colours took turns. It ends when no node would move, or in a cycle of equal gains.
    """
    now, last, any_moved = kept(now, slim=True), None, False
    for k in range(MOVES):
        held = now.groupBy("community").agg(F.sum("strength").alias("held"))
        near = both.join(apart(now.select(F.col("id").alias("other"), "community")), "other").groupBy("id", "community").agg(F.sum("w").alias("w"))
        mine = now.select("id", "strength", F.col("community").alias("home"))
        tried = near.unionByName(now.select("id", "community", F.lit(0.0).alias("w"))).groupBy("id", "community").agg(F.sum("w").alias("w"))
        tried = tried.join(apart(mine), "id").join(apart(held), "community")
        others = F.col("held") - F.when(F.col("community") == F.col("home"), F.col("strength")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("strength") * others / total, 9)
        # Of equal gains home comes first, then the smallest community.
        best = F.min(F.struct((-gain).alias("loss"), (F.col("community") != F.col("home")).alias("away"), "community")).alias("best")
        wanted = tried.groupBy("id").agg(best, F.first("home").alias("home")).where("best.away").select("id", F.col("best.community").alias("community"), F.xxhash64("id", F.lit(k)).alias("lot"))
        wanted = kept(wanted, slim=True)
        n = wanted.count()
        if not n or last is not None and n >= last and k > MOVES // 2:
            drop(wanted)
            break
        last, any_moved = n, True
        beside = both.join(apart(wanted.select("id", "lot")), "id").select("other", "lot").groupBy(F.col("other").alias("id")).agg(F.max("lot").alias("most"))
        going = wanted.join(apart(beside), "id", "left").where("most is null or lot > most").select("id", F.col("community").alias("to"))
        later = kept(now.join(apart(going), "id", "left").select("id", "strength", F.coalesce("to", "community").alias("community")), slim=True)
        drop(now)
        drop(wanted)
        now = later
    return now, any_moved


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, community) for every end of an edge (source, target[, weight]); a community is its smallest id.

    Modularity is raised level by level: rounds of moves over joins, then the groups they made, as far as they hang together,
    become the nodes of the next level, until no level groups anything. A last pass moves single nodes between the final
    groups. Any graph is worked on in the same way, and no group of nodes is ever one task's. Edges between two nodes add
    up whichever way they lead; loops count for their node's strength only.
    """
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)

    def folded(rows: DataFrame) -> DataFrame:
        return kept(rows.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.sum("w").alias("w")), slim=True)

    def two_way(pairs: DataFrame) -> DataFrame:
        one = pairs.where("source <> target").select(F.col("source").alias("id"), F.col("target").alias("other"), "w")
        return kept(one.union(one.select(F.col("other").alias("id"), F.col("id").alias("other"), "w")), slim=True)

    def strengths(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("source", "target")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("strength"))

    def connected(pairs: DataFrame, level: DataFrame) -> DataFrame:
        """level (id, community) with each community cut into its connected parts, named by their smallest id."""
        of = lambda end: apart(level.select(F.col("id").alias(end), F.col("community").alias(f"c_{end}")))
        inner = pairs.where("source <> target").join(of("source"), "source").join(of("target"), "target").where("c_source = c_target")
        return level.select("id").join(apart(components(inner.select("source", "target"))), "id", "left").select("id", F.coalesce("component", "id").alias("community"))

    first = folded(edges.where("source is not null and target is not null").select("source", "target", weight.alias("w")))
    total = 2 * (first.agg(F.sum("w")).first()[0] or 0.0)
    if not total:
        return strengths(first).select("id", F.col("id").alias("community"))
    strength = kept(strengths(first), slim=True)
    pairs, inside, both_first = first, strength.select("id", F.col("id").alias("node")), two_way(first)
    for level_no in range(LEVELS):
        both = two_way(pairs) if level_no else both_first
        moved, any_moved = _moves(both, strengths(pairs).withColumn("community", F.col("id")), total, resolution)
        if not any_moved:
            break
        level = kept(connected(pairs, moved.select("id", "community")), slim=True)
        if level.where("id <> community").isEmpty():
            break
        inside = kept(inside.join(apart(level.withColumnRenamed("id", "node")), "node").select("id", F.col("community").alias("node")), slim=True)
        s, t = (apart(level.select(F.col("id").alias(end), F.col("community").alias(end[0]))) for end in ("source", "target"))
        pairs = folded(pairs.join(s, "source").join(t, "target").select(F.col("s").alias("source"), F.col("t").alias("target"), "w"))
    last, any_moved = _moves(both_first, strength.join(apart(inside.withColumnRenamed("node", "community")), "id"), total, resolution)
    if any_moved:
        return connected(first, last.select("id", "community"))
    least = inside.groupBy("node").agg(F.min("id").alias("community"))
    return inside.join(apart(least), "node").select("id", "community")


def keep_labels(now: DataFrame, before: DataFrame) -> DataFrame:
    """(id, community, label): the label most of a community's members had; the community with most votes keeps
    a label that several want, the others are named anew by their smallest id."""
    votes = now.join(before.select("id", "label"), "id").groupBy("community", "label").agg(F.count("*").alias("n"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "label"))).where("r = 1")
    won = best.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "community"))).where("r = 1")
    return now.join(won.select("community", "label"), "community", "left").select("id", "community", F.coalesce("label", "community").alias("label"))


def _along_chains(left: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """left (source, target) with each chain of nodes of one way in and one way out bridged by an edge; the nodes bridged, as
    (node, before, after) of their chain; and (id, cycle) of those that form a ring of their own.

    A chain's nodes find its last one by doubling their steps. What hasn't come to an end after as many rounds as the number
    of nodes has binary digits goes round.
    """
    chain = kept(ends.where("ins = 1 and outs = 1 and after <> id").select("id", "before", "after"), slim=True)
    n = chain.count()
    if not n:
        return left, chain.select(F.col("id").alias("node"), "before", "after"), chain.select("id", F.col("id").alias("cycle"))
    nxt = chain.join(chain.select(F.col("id").alias("after"), F.lit(True).alias("on")), "after", "left")
    now = kept(nxt.select("id", F.when(F.col("on"), F.col("after")).otherwise(F.col("id")).alias("to"), F.col("on").isNull().alias("done"), F.col("id").alias("least")), slim=True)
    for _ in range(n.bit_length() + 1):
        going = now.where("not done")
        if going.isEmpty():
            break
        far = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("done").alias("done2"), F.col("least").alias("least2"))
        moved = going.join(far, "to").select("id", F.col("to2").alias("to"), F.col("done2").alias("done"), F.least("least", "least2").alias("least"))
        later = kept(now.where("done").unionByName(moved), slim=True)
        drop(now)
        now = later
    rings = now.where("not done").select("id", F.col("least").alias("cycle"))
    in_chain = chain.select(F.col("id").alias("before"), F.lit(True).alias("on"))
    tails = now.where("done").select("id", F.col("to").alias("tail"))
    begins = chain.join(in_chain, "before", "left").where("on is null").join(tails, "id").select("tail", "before")
    exits = chain.select(F.col("id").alias("tail"), "after")
    spans = kept(begins.join(exits, "tail"), slim=True)
    gone = kept(tails.join(spans, "tail").select(F.col("id").alias("node"), "before", "after"), slim=True)
    stay = left.join(chain.select(F.col("id").alias("source")), "source", "left_anti").join(chain.select(F.col("id").alias("target")), "target", "left_anti")
    bridges = spans.select(F.col("before").alias("source"), F.col("after").alias("target"))
    return kept(stay.select("source", "target").union(bridges).distinct(), slim=True), gone, kept(rings, slim=True)


def _from_pivots(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, cycle) of groups found from many pivots at once, and the edges that may hold more.

    Every node has a lot, drawn by hash. Forward from every node its lot spreads, the smallest wins, and all that has one
    colour is reached by that lot's owner, the pivot. What reaches the pivot inside its colour is its group. No group
    has two colours, so edges between colours go. Lots leave the pivots no order that follows the edges, so about as many
    rounds of this are needed as the number of groups has digits.
    """
    lot = F.struct(F.xxhash64("id").alias("lot"), "id")
    ids = left.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    now = kept(ids.select("id", lot.alias("colour"), F.lit(True).alias("new")), slim=True)
    while not (fresh := now.where("new")).isEmpty():
        # Only what has a new colour tells its targets.
        offered = left.join(fresh.select(F.col("id").alias("source"), "colour"), "source").groupBy(F.col("target").alias("id")).agg(F.min("colour").alias("c"))
        later = kept(now.join(offered, "id", "left").select("id", F.least("colour", "c").alias("colour"), F.coalesce(F.col("c") < F.col("colour"), F.lit(False)).alias("new")), slim=True)
        drop(now)
        now = later
    colours = now.select("id", F.col("colour.id").alias("colour"))
    same = left.join(colours.withColumnRenamed("id", "source"), "source").join(colours.select(F.col("id").alias("target"), F.col("colour").alias("c")), "target").where("colour = c").select("source", "target", "colour")
    same = kept(same, slim=True)
    found = kept(colours.where("id = colour").withColumn("new", F.lit(True)), slim=True)
    while not (frontier := found.where("new")).isEmpty():
        back = same.join(frontier.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"), "colour")
        every = found.select("id", "colour", F.lit(0).alias("more")).unionByName(back.withColumn("more", F.lit(1)))
        later = kept(every.groupBy("id", "colour").agg((F.min("more") == 1).alias("new")), slim=True)
        drop(found)
        found = later
    rest = same.join(found.select(F.col("id").alias("source")), "source", "left_anti").join(found.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target")
    many = found.groupBy("colour").count().where("count > 1").select("colour")
    return kept(found.join(many, "colour", "left_semi").select("id", F.col("colour").alias("cycle")), slim=True), kept(rest, slim=True)


def cycles(edges: DataFrame) -> DataFrame:
    """(id, cycle): nodes on a directed cycle, with the smallest id of their strongly connected group.

    Rounds of joins make the graph smaller until no edge is left: nodes without a way in or out go, chains are bridged, and
    where that takes less than a quarter off, groups are found from many pivots at once, forward and backward. Bridged nodes then join the group that they
    lie between, in the reverse order. A search from the pivots takes as many rounds as what is left is wide, without its
    chains.
    """
    every = kept(edges.where("source is not null and target is not null").select("source", "target").distinct(), slim=True)
    found, closed = [], [every.where("source = target").select(F.col("source").alias("id"))]
    left, bridged = every.where("source <> target"), []
    size = left.count()
    while size:
        ends = left.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("target").alias("after"), F.lit(None).cast("string").alias("before"))
        ends = ends.unionByName(left.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(None).cast("string").alias("after"), F.col("source").alias("before")))
        ends = kept(ends.groupBy("id").agg(F.sum("o").alias("outs"), F.sum("i").alias("ins"), F.min("after").alias("after"), F.min("before").alias("before")), slim=True)
        dead = ends.where("ins = 0 or outs = 0").select("id")
        left, gone, rings = _along_chains(left, ends)
        bridged.append(gone)
        # A bridge from a node to itself: it is on a cycle.
        found.append(rings)
        closed.append(left.where("source = target").select(F.col("source").alias("id")))
        alive = left.where("source <> target").join(dead.withColumnRenamed("id", "source"), "source", "left_anti").join(dead.withColumnRenamed("id", "target"), "target", "left_anti")
        left = kept(alive.select("source", "target"), slim=True)
        before, size = size, left.count()
        if size > 0.75 * before:
            groups, left = _from_pivots(left)
            found.append(groups)
            size = left.count()
    own = reduce(DataFrame.union, closed).select("id", F.lit(None).cast("string").alias("cycle"))
    got = kept(reduce(DataFrame.union, found, own).groupBy("id").agg(F.coalesce(F.min("cycle"), F.col("id")).alias("cycle")), slim=True)
    for gone in reversed(bridged):
        a = got.select(F.col("id").alias("before"), F.col("cycle").alias("a"))
        b = got.select(F.col("id").alias("after"), F.col("cycle").alias("b"))
        between = gone.join(a, "before").join(b, "after").where("a = b").select(F.col("node").alias("id"), F.col("a").alias("cycle"))
        got = kept(got.union(between).groupBy("id").agg(F.min("cycle").alias("cycle")), slim=True)
    return got.join(got.groupBy("cycle").agg(F.min("id").alias("least")), "cycle").select("id", F.col("least").alias("cycle"))


def shortest_cycle(edges: DataFrame, start: str) -> list[str]:
    """A shortest cycle through a node as the list of its ids, the smallest way on a tie; empty if it is on none."""
    step, ways = 0, [edges.where(F.col("source") == start).select(F.col("target").alias("id"), F.col("source").alias("before")).distinct()]
    seen = kept(ways[0].groupBy("id").agg(F.min("before").alias("before")), slim=True)
    layers = [seen]
    while seen.where(F.col("id") == start).isEmpty():
        step += 1
        ahead = edges.join(layers[-1].select(F.col("id").alias("source")), "source").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("before"))
        layers.append(kept(ahead.join(seen, "id", "left_anti"), slim=True))
        if layers[-1].isEmpty():
            return []
        seen = kept(seen.union(layers[-1]), slim=True)
    path, at = [], start
    for layer in reversed(layers):
        at = layer.where(F.col("id") == at).first()["before"]
        path.append(at)
    return path[::-1]


def closes_cycle(edges: DataFrame, source: str, target: str) -> bool:
    """Whether an edge from source to target would close a cycle."""
    if source == target:
        return True
    near = reach(edges.select("source", "target"), edges.sparkSession.createDataFrame([(source,)], "id string"), 1, None)
    return not near.where(F.col("id") == target).isEmpty()


def pooled(vectors: DataFrame) -> DataFrame:
    """(id, vector): the mean of a node's vectors (id, vector), scaled to length 1; nodes whose vectors differ in
    length, or average to zero, are left out."""
    even = vectors.groupBy("id").agg(F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).where("lo = hi").select("id")
    parts = vectors.join(even, "id", "left_semi").select("id", F.posexplode("vector").alias("at", "x")).groupBy("id", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select("id", F.col("v.x").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("n", norm).where("n > 0").select("id", F.transform("v", lambda x: x / F.col("n")).alias("vector"))
