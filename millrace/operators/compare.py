"""Comparing two tables by digests of key ranges: only ranges whose digests differ are read again.

A range's digest is its number of rows and two sums of row hashes, so the rows' order is no matter and copies of a row count. The key's
range is cut at keys of a bounded sample, both tables are digested in one pass each, and each range that differs is cut again at keys
drawn from it, until it is small or cuts no more; then the rows of those ranges alone are joined. Filters name ranges of the key, so on
tables that are sorted by it they reach the scan. Where differences are everywhere, the ranges that differ hold most rows and are joined
at once.

Keys may repeat: a key is the same if it has the same rows. Null keys are a range of their own. Columns are compared by name; a column
that one table lacks is an error.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIVOTS, CUTS, SMALL, MOST_RANGES, MOST_SHARE = 127, 7, 2000, 256, 0.25
Range = tuple[object, object]  # from (None: the least) to (None: the end); (None, None, True) is the null keys' range


@dataclass
class Comparison:
    """differences: key, kind ("left", "right": one table alone has it; "differs"). rows_read: how many rows of the left table each
    pass looked at, the last one for the join."""

    differences: DataFrame
    rows_read: list[int] = field(default_factory=list)


def _within(key: Column, low: object, high: object) -> Column:
    out = key.isNotNull()
    if low is not None:
        out = out & (key >= F.lit(low))
    return out & (key < F.lit(high)) if high is not None else out


def _any(key: Column, ranges: Iterable[Range], nulls: bool) -> Column:
    out = key.isNull() if nulls else F.lit(False)
    for low, high in ranges:
        out = out | _within(key, low, high)
    return out


def _number(key: Column, bounds: list) -> Column:
    """How many bounds are at or below the key, by halving; -1 for null."""

    def among(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(key < F.lit(bounds[mid]), among(a, mid)).otherwise(among(mid + 1, b))

    return F.when(key.isNull(), -1).otherwise(among(0, len(bounds)))


def _digests(rows: DataFrame, key: Column, bounds: list) -> dict[int, tuple]:
    row = F.xxhash64(*(F.to_json(F.struct(c)) if rows.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in sorted(rows.columns)), *(F.isnull(c) for c in sorted(rows.columns)))
    cut = rows.select(_number(key, bounds).alias("range"), row.alias("h"))
    half = lambda n: F.sum(F.call_function("shiftrightunsigned", F.col("h"), F.lit(n)).bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(38,0)"))
    return {r["range"]: (r["n"], r["low"], r["high"]) for r in cut.groupBy("range").agg(F.count("*").alias("n"), half(0).alias("low"), half(32).alias("high")).collect()}


def _pivots(rows: DataFrame, key: str, ranges: list[Range], cuts: int) -> list:
    """For each range up to `cuts` of its keys, drawn by the least of as many hashes."""
    bounds = sorted({x for r in ranges for x in r if x is not None})
    drawn = [F.min_by(key, F.xxhash64(key, F.lit(i))).alias(f"p{i}") for i in range(cuts)]
    got = rows.where(F.col(key).isNotNull()).groupBy(_number(F.col(key), bounds).alias("range")).agg(*drawn).collect()
    return sorted({r[f"p{i}"] for r in got for i in range(cuts)} | set(bounds))


def compare(left: DataFrame, right: DataFrame, key: str, small: int = SMALL) -> Comparison:
    """The keys at which two tables differ. Both should be tables that are stored; each is read some times, the later ones in part."""
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    k = F.col(key)
    both = left, right.select(*left.columns)
    sample = [r[0] for t in both for r in t.select(key).where(k.isNotNull()).distinct().orderBy(F.xxhash64(key)).limit(PIVOTS).collect()]
    bounds, ranges, nulls, read, total = sorted(set(sample)), [(None, None)], True, [], 1
    while True:
        here = [t.where(_any(k, ranges, nulls)) if read else t for t in both]
        a, b = (_digests(t, k, bounds) for t in here)
        read.append(sum(n for n, _, _ in a.values()))
        total = max(total, read[0])
        differ = sorted(i for i in a.keys() | b.keys() if a.get(i) != b.get(i))
        edges = [None, *bounds, None]
        ranges, nulls = [(edges[i], edges[i + 1]) for i in differ if i >= 0], -1 in differ
        size = {i: max(a.get(i, (0,))[0], b.get(i, (0,))[0]) for i in differ if i >= 0}
        if not size or max(size.values()) <= small or len(ranges) > MOST_RANGES or sum(size.values()) > MOST_SHARE * total:
            break
        wide = [(edges[i], edges[i + 1]) for i, n in size.items() if n > small]
        cut = _pivots(left.where(_any(k, wide, False)).unionByName(right.where(_any(k, wide, False)).select(*left.columns)), key, ranges, CUTS)
        if set(cut) <= set(bounds):
            break
        bounds = cut
    last = [t.where(_any(k, ranges, nulls)) for t in both]
    read.append(last[0].count())
    names = [c for c in left.columns if c != key]
    rows = F.struct(*names) if names else F.lit(True)
    of = lambda t: t.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.xxhash64(rows).cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64(F.lit(1), rows, F.lit(2)).cast("decimal(38,0)")).alias("g"))
    a, b = of(last[0]).select(key, F.struct("n", "h", "g").alias("a")), of(last[1]).select(F.col(key).alias("_key"), F.struct("n", "h", "g").alias("b"))
    joined = a.join(b, a[key].eqNullSafe(b["_key"]), "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    kind = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("differs")
    return Comparison(joined.select(F.when(F.col("a").isNull(), F.col("_key")).otherwise(a[key]).alias(key), kind.alias("kind")), read)
