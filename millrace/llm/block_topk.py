"""Exact top-k inner products by block-at-a-time pruning.

Vectors of whole numbers are ordered by a locality code (the leaf of a tree fitted on SAMPLE rows of least hash, then signs of fixed
random projections) and cut into blocks of consecutive rows; many blocks, some MB of vectors, are a shard. The order decides how much
is skipped, never what is found. A block keeps its greatest and least value of each dimension, and its rows as a
forward index. For one query a block's bound is the sum over dimensions of the query's weight times the greatest value (the least
one, for negative weights). Each query visits blocks from its highest bound down until no bound reaches its k-th score; at equal score
and bound a block is still skipped if its least id is beyond the k-th result's. Queries that visit the same block next are scored
together, as one matrix product with its forward index. Each query begins with the k-th score among the other queries of its own block,
which are candidates too.

Queries are a stated set; they go in blocks. The shards' extremes alone, many shards to a row, meet the query blocks, in two waves:
first each query block gets the vectors of the shards that promise most, and a window gives each query's k-th score of those; then
only shards that still can reach some query's k-th score are visited. Each pair of query block and shard gives at most k results a
query, and a window keeps the k best of them. Vectors of different sizes do not meet.

A row is its own, whatever its id: each query row is asked, and all rows but itself are its candidates, those with the same id
or none too. Ties go to the smaller vec_id, null ids last; a query without id keeps a null query_id. Sums are exact: in floating
point or in longs where the operands' bounds allow it, in Python's numbers elsewhere; a score beyond a long is given, and
ranked, as the nearest long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.common import arrow_rows, columns, written
from millrace.operators.vector_index import Tree

#: Rows that the order is fitted on, and levels of its tree.
SAMPLE, LEVELS = 20_000, 11
#: Rows of a block, values of a shard, queries of a query block, shards whose extremes are one row, shards of the first wave.
BLOCK, SHARD, QUERIES, TOGETHER, FIRST = 128, 1 << 20, 1024, 256, 2
#: ids: 2^63 - 1 for null ones, which `known` tells apart; rows: of the narrowest kind of number that holds them exactly.
PACKED = columns("number long,size int,kind string,keys binary,ids binary,known binary,rows binary,theta binary")
HITS = columns("block long,query long,query_id long,row long,vec_id long,score long")
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole(vectors: DataFrame, vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """vec_id, x (array of whole doubles): floor(scale * component), of vectors that have finite components only."""
    x = F.transform(vector, lambda v: F.lit(scale) * v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    floor = lambda v: F.when(F.abs(v) < F.lit(2.0**52), F.floor(v).cast("double")).otherwise(v)
    return vectors.where(F.col(vector).isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, floor).alias("x"))


def _code(x: np.ndarray, bits: int = 14) -> np.ndarray:
    """Signs of fixed random projections; the first ones count most."""
    planes = np.random.default_rng(5).normal(size=(x.shape[1], bits))
    return ((x.astype(float) @ planes) > 0) @ (1 << np.arange(bits - 1, -1, -1))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a batch, and their vectors, for each size of vector."""
    lists = batch.column("x")
    size, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    begin = np.cumsum(size) - size
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, flat[begin[at][:, None] + np.arange(d)].astype(float).reshape(len(at), d)


def _trees(vectors: DataFrame) -> dict[int, Tree]:
    """A tree for each size of vector that the sample has enough rows of."""
    taken = vectors.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).toArrow()
    out = {}
    for batch in taken.combine_chunks().to_batches():
        for _, x in _matrices(batch):
            x = x[np.abs(x).max(1, initial=0) > 0] if x.shape[1] else x[:0]
            levels = min(LEVELS, int(np.log2(max(len(x) // 8, 1))))
            if levels and x.shape[1]:
                out[x.shape[1]] = Tree(_directions(x), levels)
    return out


def _directions(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1)  # no square is beyond a double
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def ordered(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, x, asked, in order of size, locality code and id over the partitions. To be written
    before use: another run can number the rows otherwise."""
    shared = vectors.sparkSession.sparkContext.broadcast(_trees(vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            for at, x in _matrices(batch):
                tree = shared.value.get(x.shape[1])
                code[at] = (x.shape[1] << 40) + ((tree.leaves(_directions(x)) if tree else 0) << 14) + _code(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "x", "asked")), pa.array(code)], ["vec_id", "x", "asked", "code"])

    coded = vectors.mapInArrow(run, "vec_id long, x array<double>, asked boolean, code long")
    return coded.repartitionByRange("code", "vec_id").sortWithinPartitions("code", "vec_id").select(F.monotonically_increasing_id().alias("row"), "vec_id", "x", "asked")


def packed(vectors: DataFrame, rows: Callable[[int], int], k: int = 0) -> DataFrame:
    """Rows of PACKED, each of up to rows(size) consecutive vectors of one size. With k, theta has a lower bound of each vector's
    k-th score. The numbers are unique within one run; so the table has to be written before it is used."""
    arrow = to_arrow_schema(PACKED)

    def row(number: int, keys: np.ndarray, ids: np.ndarray, known: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        theta = np.full(len(ids), _LEAST)
        if k and len(ids) > k:
            own = product(x, x)
            own[np.arange(len(ids)), np.arange(len(ids))] = _LEAST
            theta = np.partition(own, len(ids) - k, axis=1)[:, len(ids) - k]
        kind = next((c for c in ("i1", "i2", "i4") if len(x) and np.abs(x).max(initial=0) <= np.iinfo(c).max), "f8")
        values = {"keys": keys, "ids": ids, "known": known, "rows": x.astype(kind), "theta": theta}
        return arrow_rows({"number": [number], "size": [x.shape[1]], "kind": [kind], **{n: [v.tobytes()] for n, v in values.items()}}, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, keys = batch.column("vec_id"), batch.column("row").to_numpy()
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(_MOST).to_numpy()
            for at, x in _matrices(batch):
                d = x.shape[1]
                held.setdefault(d, []).append((keys[at], ids[at], known[at], x))
                most = rows(d)
                if sum(len(p[0]) for p in held[d]) >= most:
                    parts = [np.concatenate(p) for p in zip(*held[d], strict=True)]
                    n = len(parts[0])
                    for i in range(0, n - most + 1, most):
                        yield row(number, *(p[i : i + most] for p in parts))
                        number += 1
                    held[d] = [tuple(p[n - n % most :] for p in parts)]
        for tail in held.values():
            parts = [np.concatenate(p) for p in zip(*tail, strict=True)]
            if len(parts[0]):
                yield row(number, *parts)
                number += 1

    return vectors.mapInArrow(run, PACKED)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole doubles, exactly, as longs; what is beyond a long becomes the nearest one."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**52:
        return np.rint(a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    left, right = ([[int(v) for v in r] for r in m] for m in (a, b))
    exact = [[min(max(sum(map(int.__mul__, r, c)), int(_LEAST)), int(_MOST)) for c in right] for r in left]
    return np.array(exact, np.int64).reshape(len(a), len(b))


def extremes(x: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each block of rows begins, and its greatest and least value of each dimension."""
    begin = np.arange(0, len(x), size)
    return begin, np.maximum.reduceat(x, begin), np.minimum.reduceat(x, begin)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(queries, blocks): no row of the block has a higher score. The two sums are each clamped to a long, so is their sum."""
    a, b = product(np.maximum(q, 0), high), product(np.minimum(q, 0), low)
    total = a + b
    over = ((a ^ total) & (b ^ total)) < 0  # two's complement: the sum left the range
    total[over] = np.where(a[over] > 0, _MOST, _LEAST)
    total[(a == _MOST) | (b == _MOST)] = _MOST  # a clamped part bounds nothing
    return total


def search(q_keys: np.ndarray, q: np.ndarray, theta: np.ndarray, keys: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, seen: list[tuple[int, int]] | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (its row): places and scores of its k best rows of x that can be among its k best of all. seen: gets the number
    of visits of a query to a block, and how many there could be."""
    begin, high, low = extremes(x)
    least, bound = np.minimum.reduceat(ids, begin), bounds(q, high, low)
    order = np.argsort(bound, axis=1)[:, ::-1]
    kth, last = theta.copy(), np.full(len(q), _MOST)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
    alive, visits = np.arange(len(q)), 0
    for turn in range(len(begin)):
        block = order[alive, turn]
        top = bound[alive, block]
        going = top >= kth[alive]  # a query's later blocks promise no more than this one
        alive, block, top = alive[going], block[going], top[going]
        now = (top > kth[alive]) | (least[block] <= last[alive])
        visits += int(now.sum())
        for b in np.unique(block[now]):
            who = alive[now & (block == b)]
            rows = slice(begin[b], begin[b] + BLOCK)
            scores = product(x[rows], q[who])
            fit = (scores >= kth[who]) & (keys[rows][:, None] != q_keys[who])
            for j in np.flatnonzero(fit.any(0)):
                i, at = who[j], np.flatnonzero(fit[:, j])
                s, place = np.append(best[i][1], scores[at, j]), np.append(best[i][0], begin[b] + at)
                pick = np.lexsort((keys[place], ids[place], ~s))[:k]  # ~s falls as s rises, for every long
                best[i] = place[pick], s[pick]
                if len(pick) == k:
                    worst = s[pick[-1]]
                    if worst >= kth[i]:
                        kth[i], last[i] = worst, ids[place[pick[-1]]]
    if seen is not None:
        seen.append((visits, len(q) * len(begin)))
    return [(i, place, s) for i, (place, s) in enumerate(best) if len(place)]


def _view(batch: pa.RecordBatch, name: str, row: int, kind: type | str = np.int64) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_py(), kind)


def _rows(batch: pa.RecordBatch, row: int, n: int, prefix: str = "") -> np.ndarray:
    """n packed vectors."""
    kind, d = batch.column(f"{prefix}kind")[row].as_py(), batch.column("size")[row].as_py()
    return _view(batch, f"{prefix}rows", row, kind).astype(float).reshape(n, d)


def outlines(shards: DataFrame) -> DataFrame:
    """size, part, shards, high, low: the extremes of TOGETHER shards to a row, with two values a dimension each."""

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                _, high, low = extremes(_rows(batch, r, len(_view(batch, "keys", r))), 1 << 60)
                ends = [pa.array([e[0].tolist()], pa.list_(pa.float64())) for e in (high, low)]
                yield pa.RecordBatch.from_arrays([batch.column("number")[r : r + 1], batch.column("size")[r : r + 1], *ends], ["shard", "size", "high", "low"])

    parts = max(1, shards.count() // TOGETHER)
    made = shards.select("number", "size", "kind", "keys", "rows").mapInArrow(outline, "shard long, size int, high array<double>, low array<double>")
    groups = made.groupBy("size", F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int").alias("part")).agg(F.collect_list(F.struct("shard", "high", "low")).alias("s"))
    return written(groups.select("size", "part", F.col("s.shard").alias("shards"), F.flatten("s.high").alias("high"), F.flatten("s.low").alias("low")))


def close(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """block, shard, promise: the pairs in which some query's bound, from the shard's extremes, reaches what the query has already, and
    the sum of all its queries' bounds."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                theta, at, d = _view(batch, "theta", r), batch.column("shards")[r].values.to_numpy(), batch.column("size")[r].as_py()
                high, low = (batch.column(n)[r].values.to_numpy().reshape(len(at), d) for n in ("high", "low"))
                bound = bounds(_rows(batch, r, len(theta)), high, low)
                near = (bound >= theta[:, None]).any(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(near.sum(), batch.column("block")[r].as_py())), pa.array(at[near]), pa.array(bound.astype(float).sum(0)[near])], ["block", "shard", "promise"])

    asking = blocks.select(F.col("number").alias("block"), "size", "kind", "rows", "theta")
    pairs = asking.join(groups, "size").select("block", "size", "kind", "rows", "theta", "shards", "high", "low")
    return pairs.mapInArrow(reach, "block long, shard long, promise double")


def _raised(blocks: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The query blocks, with the k-th scores that their queries have among the hits."""
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    found = hits.select("block", "query", "score").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).where(F.col("n") == k)
    held = found.groupBy("block").agg(F.collect_list("query").alias("found"), F.collect_list("score").alias("scores"))
    arrow = to_arrow_schema(PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                theta, keys, found = _view(batch, "theta", r).copy(), _view(batch, "keys", r), batch.column("found")[r]
                if found.is_valid:
                    by = np.argsort(keys)
                    at = by[np.searchsorted(keys, found.values.to_numpy(), sorter=by)]
                    theta[at] = np.maximum(theta[at], batch.column("scores")[r].values.to_numpy())
                cells = [pa.array([theta.tobytes()], pa.binary()) if f.name == "theta" else batch.column(f.name)[r : r + 1] for f in arrow]
                yield pa.RecordBatch.from_arrays(cells, schema=arrow)

    return written(blocks.join(held, blocks["number"] == held["block"], "left").select(*(f.name for f in PACKED), "found", "scores").mapInArrow(run, PACKED))


def _visited(pairs: DataFrame, blocks: DataFrame, shards: DataFrame, k: int, tally: tuple[Accumulator, Accumulator] | None) -> DataFrame:
    """HITS of pairs of query block and shard."""
    asking = pairs.select("block", "shard").join(blocks.select(F.col("number").alias("block"), *(F.col(c).alias(f"q_{c}") for c in ("kind", "keys", "ids", "known", "rows", "theta"))), "block")
    both = asking.repartition("shard").join(shards.select(F.col("number").alias("shard"), "size", "kind", "keys", "ids", "known", "rows"), "shard")
    arrow = to_arrow_schema(HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_keys, q_ids, q_known = _view(batch, "q_keys", r), _view(batch, "q_ids", r), _view(batch, "q_known", r, bool)
                keys, ids, known = _view(batch, "keys", r), _view(batch, "ids", r), _view(batch, "known", r, bool)
                seen: list[tuple[int, int]] = []
                found = search(q_keys, _rows(batch, r, len(q_keys), "q_"), _view(batch, "q_theta", r), keys, ids, _rows(batch, r, len(keys)), k, seen)
                for count, n in zip(tally or (), seen[0], strict=False):
                    count.add(n)
                if found:
                    who = np.repeat([i for i, _, _ in found], [len(v) for _, v, _ in found])
                    at = np.concatenate([v for _, v, _ in found])
                    block = np.full(len(at), batch.column("block")[r].as_py())
                    cells = [pa.array(block), pa.array(q_keys[who]), pa.array(q_ids[who], mask=~q_known[who]), pa.array(keys[at]), pa.array(ids[at], mask=~known[at]), pa.array(np.concatenate([s for _, _, s in found]))]
                    yield pa.RecordBatch.from_arrays(cells, schema=arrow)

    return written(both.select("block", "size", "q_kind", "q_keys", "q_ids", "q_known", "q_rows", "q_theta", "kind", "keys", "ids", "known", "rows").mapInArrow(run, HITS))


def top_k(vectors: DataFrame, asked: Column, k: int = 20, tally: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, x) that `asked` holds for, its k highest scores among
    all other rows; ties go to the smaller vec_id. tally: how many visits of a query to a block there were, and to how many blocks of
    the shards that its query block met (more where a lost task ran again)."""
    if k < 1:
        raise ValueError("k has to be positive")
    every = written(ordered(vectors.select("vec_id", F.col("x").cast("array<double>").alias("x"), F.coalesce(asked, F.lit(False)).alias("asked"))))
    shards = written(packed(every, lambda size: max(BLOCK, SHARD // max(size, 1) // BLOCK * BLOCK)))
    blocks = written(packed(every.where("asked").repartitionByRange("row").sortWithinPartitions("row"), lambda size: QUERIES, k))
    groups = outlines(shards)
    promised = Window.partitionBy("block").orderBy(F.desc("promise"), "shard")
    wave = written(close(blocks, groups).withColumn("n", F.row_number().over(promised)).where(F.col("n") <= FIRST))
    hits = _visited(wave, blocks, shards, k, tally)
    raised = _raised(blocks, hits, k)
    left = written(close(raised, groups).join(wave.select("block", "shard"), ["block", "shard"], "left_anti"))
    hits = hits.unionByName(_visited(left, raised, shards, k, tally))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
