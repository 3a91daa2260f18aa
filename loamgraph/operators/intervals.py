"""Joins by nearness in an order: as-of, points in intervals, overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators.storage import kept

#: Parts that the range of times is cut into, so that one key's rows are many tasks' work.
PARTS = 256


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], prefix: str = "last_", strict: bool = False) -> DataFrame:
    """left with the values (named with the prefix, time among them) of the last row of right of the same keys at its time or
    before; strict: before its time. Of right's rows that tie, the greatest values. Null keys match each other, rows
    without a time get nulls, and without keys all rows are one key.

    Right's rows are first folded to one a key and time, and left's to the times that a key has. These go in order through
    windows of one key and one of PARTS parts of the whole range; what earlier parts have seen last is carried over,
    one row a key and part. So a key that has a third of all rows is spread over many tasks, and one time that has,
    too, is one row.
    """
    types = dict(right.dtypes)
    number = F.unix_micros(F.col(time).cast("timestamp")) if types[time].startswith(("timestamp", "date")) else F.col(time).cast("double")
    last = right.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("_v")).select(*keys, time, F.struct(time, *(F.col(f"_v.{v}").alias(v) for v in values)).alias("_v"))
    times = left.where(F.col(time).isNotNull()).select(*keys, time).distinct()
    # Of one time, right's row comes before left's, or after it.
    rows = last.withColumn("_after", F.lit(1 if strict else 0)).unionByName(times.withColumns({"_v": F.lit(None).cast(last.schema["_v"].dataType), "_after": F.lit(0 if strict else 1)}))
    ends = rows.agg(F.min(number).alias("lo"), F.max(number).alias("hi")).first()
    lo, hi = (ends["lo"] or 0, ends["hi"] or 0) if ends else (0, 0)
    part = F.least(F.lit(PARTS - 1), F.floor((number - F.lit(lo)) / F.lit(float(hi - lo) or 1.0) * PARTS)).cast("int")
    rows = rows.withColumn("_part", part)
    here = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys, "_part").orderBy(time, "_after").rowsBetween(Window.unboundedPreceding, 0))
    asked = rows.withColumn("_here", here).where(F.col("_after") == (0 if strict else 1)).select(*keys, time, "_part", "_here")
    # One row a key and part: the last that part has seen, if any, and then what those before it have.
    spots = rows.groupBy(*keys, "_part").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(time))).alias("_v"))
    before = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    own = [f"_k{i}" for i in range(len(keys))]
    carry = spots.withColumn("_carry", before).select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col("_part").alias("_p"), "_carry")
    same = _all([F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)])
    found = asked.join(carry, same & (F.col("_part") == F.col("_p")), "left").select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col(time).alias("_t"), F.coalesce("_here", "_carry").alias("_v"))
    out = left.join(found, same & (F.col(time) == F.col("_t")), "left")
    return out.select(*left.columns, *(F.col(f"_v.{c}").alias(prefix + c) for c in [time, *values]))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def points_in(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, keys: list[str] | None = None, closed: bool = True) -> DataFrame:
    """Pairs of a point and an interval of the same keys that holds it: low <= at <= high, or low <= at < high where the
    interval isn't closed. Columns of both; keys once. Points and ends are whole numbers (times in microseconds); nulls
    and intervals that end before they begin match nothing.

    An interval goes to the one or two cells that it touches of the smallest power of two that is no shorter than it, and a
    point to the one cell around it of each power that some interval has. So no interval is cut into many, a pair
    meets in one cell only, and a cell holds no more than a few times the pairs that match.
    """
    keys = keys or []
    whole = intervals.where((F.col(low) <= F.col(high)) & F.col(low).isNotNull() & F.col(high).isNotNull())
    length = F.col(high).cast("long") - F.col(low).cast("long") + 1
    level = F.length(F.bin(length - 1)).cast("int")  # 2^level >= length, for length 1 as well
    cell = lambda c, lv: F.call_function("shiftright", F.col(c).cast("long"), lv)
    rows = whole.withColumn("_level", level)
    levels = sorted(r[0] for r in rows.select("_level").distinct().collect())  # at most 64
    rows = rows.withColumn("_cell", F.explode(F.sequence(cell(low, F.col("_level")), cell(high, F.col("_level")))))
    near = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_cell", cell(at, F.col("_level")))
    met = near.join(rows, [*keys, "_level", "_cell"])
    inside = (F.col(low) <= F.col(at)) & ((F.col(at) <= F.col(high)) if closed else (F.col(at) < F.col(high)))
    return met.where(inside).drop("_level", "_cell")


def totals_in(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, sums: list[str], keys: list[str] | None = None, closed: bool = True) -> DataFrame:
    """intervals that hold a point of the same keys, as points_in() says, with `n`, how many, and the sums of columns of
    the points: whole numbers whose total fits a long, nulls as 0. No pair is made.

    Points are folded to one row a key and place, with what lies there or before; an interval's numbers are those at its end
    less those before its beginning. Running totals go through windows of one key and one of PARTS parts of the range,
    and what earlier parts have is added, one row a key and part.
    """
    keys = keys or []
    known = _all([F.col(k).isNotNull() for k in keys])
    sums_of = ["n", *(f"_s{i}" for i in range(len(sums)))]
    rows = points.where(known & F.col(at).isNotNull()).groupBy(*keys, F.col(at).cast("long").alias("_at"))
    rows = kept(rows.agg(F.count("*").alias("n"), *(F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(o) for c, o in zip(sums, sums_of[1:], strict=True))))
    lo, hi = rows.agg(F.min(F.col("_at").cast("double")), F.max(F.col("_at").cast("double"))).first()
    part = F.least(F.lit(PARTS - 1), F.floor((F.col("_at").cast("double") - F.lit(lo or 0.0)) / F.lit(((hi or 0.0) - (lo or 0.0)) or 1.0) * PARTS)).cast("int")
    rows = rows.withColumn("_part", part)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "_part").agg(*(F.sum(c).alias(c) for c in sums_of)).select(*keys, "_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in sums_of))
    here = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.select(*keys, "_part", "_at", *(F.sum(c).over(here).alias(c) for c in sums_of)).join(carry, [*keys, "_part"])
    upto = kept(upto.select(*keys, "_at", *((F.col(c) + F.col(f"_b{c}")).alias(c) for c in sums_of)))
    out = intervals.where(known & (F.col(low) <= F.col(high)))
    for end, prefix in ((F.col(high).cast("long") - (0 if closed else 1), "_to_"), (F.col(low).cast("long") - 1, "_from_")):
        out = as_of(out.withColumn("_at", end), upto, keys, "_at", sums_of, prefix).drop("_at", f"{prefix}_at")
    less = [(F.coalesce(f"_to_{c}", F.lit(0)) - F.coalesce(f"_from_{c}", F.lit(0))).alias(o) for c, o in zip(sums_of, ["n", *sums], strict=True)]
    return out.select(*intervals.columns, *less).where("n > 0")


def overlapping(a: DataFrame, b: DataFrame, a_ends: tuple[str, str], b_ends: tuple[str, str], keys: list[str] | None = None) -> DataFrame:
    """Pairs of intervals of the same keys that have a whole number in common, each once; column names other than the keys
    differ. Of two that overlap, either the first begins within the second, or the second within the first, later."""
    whole = [x.where(F.col(lo) <= F.col(hi)) for x, (lo, hi) in ((a, a_ends), (b, b_ends))]
    first = points_in(whole[0], whole[1], a_ends[0], *b_ends, keys)
    later = points_in(whole[1], whole[0], b_ends[0], *a_ends, keys).where(F.col(b_ends[0]) > F.col(a_ends[0]))
    return first.unionByName(later.select(*first.columns))
