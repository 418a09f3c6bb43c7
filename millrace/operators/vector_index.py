"""An index for nearest chunks: inverted lists along a tree of centres, one tree for all datasets.

The tree halves a bounded sample (SAMPLE rows of least key hash) at each node along the line between two far means, so its leaves hold
equal shares of the sample. Every row goes down the tree, whatever the sample was. A dataset of n rows uses as many levels as give lists
of some LIST rows each, so small datasets have one list; lists are partitions of a Parquet table below tenant and dataset. A second
table keeps each list's rows and its radius, the greatest angle between its centre and a row.

A question looks at the lists whose centres are nearest ("probes" of them), and, in the exact mode, then at every list that can still
hold a better row: none of a list is nearer to the question than the angle to its centre less its radius. The lists that are read are
scored exactly by operators.search.

Rows without a direction (null, zero, or components that are not finite), key, tenant or dataset are in no list, as they are no hits.
All vectors have one size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import search
from millrace.operators.vectors import top_k
from millrace.session import stored

SAMPLE, LIST, LEVELS, PROBES = 20_000, 1000, 10, 8
KEYS = ["tenant_id", "dataset_id"]


class Tree:
    """A binary tree in heap order: node 0 is the root, 2 i + 1 and 2 i + 2 are below i. Each inner node has a plane, each node a
    centre of length 1."""

    def __init__(self, sample: np.ndarray, levels: int):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.levels, n = levels, 2 ** (levels + 1) - 1
        self.centre, self.plane, self.cut = np.zeros((n, x.shape[1])), np.zeros((n // 2, x.shape[1])), np.zeros(n // 2)
        rows = [np.arange(len(x))]
        for node in range(n):
            mine = x[rows[node]]
            self.centre[node] = _unit(mine.mean(0)) if len(mine) else self.centre[(node - 1) // 2]
            if node < n // 2:
                self.plane[node] = _far_means(mine)
                at = mine @ self.plane[node]
                self.cut[node] = np.median(at) if len(at) else 0.0
                rows += [rows[node][at < self.cut[node]], rows[node][at >= self.cut[node]]]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the leaves, from 0, that rows come down to."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + ((x * self.plane[node]).sum(1) >= self.cut[node])
        return node - (2**self.levels - 1)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 0 else np.eye(1, len(v))[0]


def _far_means(x: np.ndarray, rounds: int = 8) -> np.ndarray:
    """The line between two means, begun with the row that is farthest from the mean and the one farthest from that."""
    if len(x) < 2:
        return np.zeros(x.shape[1])
    a = x[np.argmin(x @ x.mean(0))]
    b = x[np.argmin(x @ a)]
    for _ in range(rounds):
        side = x @ (a - b) >= 0
        if side.all() or not side.any():
            break
        a, b = x[side].mean(0), x[~side].mean(0)
    return a - b


@dataclass
class Index:
    rows: DataFrame  # chunk_id, embedding; partitioned by tenant_id, dataset_id, list
    lists: DataFrame  # tenant_id, dataset_id, list, levels, n, radius
    tree: Tree


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def build(chunks: DataFrame, path: str, *, sample: int = SAMPLE, rows_a_list: int = LIST, levels: int = LEVELS) -> Index:
    """Writes the index of chunks (tenant_id, dataset_id, chunk_id, embedding) below a path that all executors share."""
    spark = chunks.sparkSession
    rows = search.usable(chunks.select(*KEYS, "chunk_id", "embedding").dropna(subset=[*KEYS, "chunk_id"]), "embedding")
    taken = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    x = taken.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(taken), -1) if len(taken) else np.ones((0, 1))
    while levels and 2**levels * 8 > len(x):  # leaves of fewer rows say nothing
        levels -= 1
    tree = Tree(x, levels)
    spark.createDataFrame([(levels, *(t.ravel().tolist() for t in (tree.centre, tree.plane, tree.cut)))], "levels int, centre array<double>, plane array<double>, cut array<double>").coalesce(1).write.parquet(f"{path}/tree")
    shared = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("leaf int, angles array<double>")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tree = shared.value
        for vectors in batches:
            x = np.stack(vectors.to_numpy()).astype(float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            leaf = tree.leaves(x)
            nodes = [(leaf >> (tree.levels - d)) + 2**d - 1 for d in range(tree.levels + 1)]  # the ones that a row comes by
            angles = np.stack([_angle((x * tree.centre[n]).sum(1)) for n in nodes], axis=1)
            yield pd.DataFrame({"leaf": leaf, "angles": list(angles)})

    depth = F.least(F.lit(levels), F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / rows_a_list)))).cast("int")
    depths = rows.groupBy(*KEYS).agg(depth.alias("levels"))
    listed = rows.withColumn("p", placed("embedding")).join(depths, KEYS)
    number = F.expr(f"shiftright(p.leaf, {levels} - levels)")  # of the node that many levels down, among those beside it
    listed = listed.select(*KEYS, number.alias("list"), "levels", F.get("p.angles", F.col("levels")).alias("angle"), "chunk_id", "embedding")
    listed.repartition(*KEYS, "list").write.option("maxRecordsPerFile", 1_000_000).partitionBy(*KEYS, "list").parquet(f"{path}/rows")
    spark.read.schema(listed.schema).parquet(f"{path}/rows").groupBy(*KEYS, "list", "levels").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).write.parquet(f"{path}/lists")
    return opened(spark, path, chunks)


def opened(spark: SparkSession, path: str, like: DataFrame) -> Index:
    """A written index; `like` has the types of the chunks' columns."""
    kind = like.select(*KEYS, "chunk_id", "embedding").withColumns({"levels": F.lit(0), "angle": F.lit(0.0), "list": F.lit(0)}).schema
    r = spark.read.parquet(f"{path}/tree").first()
    tree = Tree.__new__(Tree)
    tree.levels, n = r["levels"], 2 ** (r["levels"] + 1) - 1
    tree.centre, tree.plane, tree.cut = np.array(r["centre"]).reshape(n, -1), np.array(r["plane"]).reshape(n // 2, -1) if n > 1 else np.zeros((0, 1)), np.array(r["cut"])
    lists = spark.read.parquet(f"{path}/lists")
    return Index(spark.read.schema(kind).parquet(f"{path}/rows"), lists.select(*(F.col(c).cast(kind[c].dataType).alias(c) if c in KEYS else c for c in lists.columns)), tree)


def _near_lists(index: Index, questions: DataFrame) -> DataFrame:
    """question_id, by, k, list, n, angle (to the list's centre), bound (the best score that a row of it can have); without the
    vectors, which would be as many as lists."""
    shared = index.rows.sparkSession.sparkContext.broadcast(index.tree.centre)

    @F.pandas_udf("array<double>")
    def angles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            x = np.stack(vectors.to_numpy()).astype(float)
            yield pd.Series(list(_angle(x @ shared.value.T / np.linalg.norm(x, axis=1, keepdims=True))))

    asked = search.usable(questions.select("question_id", *KEYS, "vector", "k"), "vector").withColumn("angles", angles("vector")).drop("vector")
    pairs = asked.join(index.lists, KEYS).withColumn("angle", F.get("angles", F.expr("shiftleft(1, levels) - 1 + list"))).drop("angles")
    return pairs.withColumn("bound", F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius"))) + 1e-9)


def find(index: Index, questions: DataFrame, *, probes: int = PROBES, exact: bool = True) -> DataFrame:
    """question_id, chunk_id, score, n of questions (question_id, tenant_id, dataset_id, vector, k): the k best rows of all lists that
    can hold one, or, not exact, of the `probes` nearest lists alone: how many of the best these hold depends on the vectors."""
    by = (*KEYS, "list")
    pairs = stored(_near_lists(index, questions).withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("angle", "list"))))
    vectors = questions.select("question_id", "vector")
    found = search.nearest(pairs.where(F.col("rank") <= probes).join(vectors, "question_id"), index.rows, by)
    if not exact:
        return found
    first = stored(found)
    known = first.join(questions.select("question_id", search.clamped(F.col("k")).alias("k")), "question_id")
    worst = known.where("n = k").select("question_id", F.col("score").alias("worst"))
    left = pairs.where(F.col("rank") > probes).join(worst, "question_id", "left").where("worst IS NULL OR bound >= worst").drop("worst")
    more = search.nearest(left.join(vectors, "question_id"), index.rows, by).join(questions.select("question_id", search.clamped(F.col("k")).alias("k")), "question_id")
    return search.merged(known.unionByName(more).drop("n"), "chunk_id")


def rows_read(index: Index, questions: DataFrame, probes: int = PROBES) -> float:
    """The share of all rows of the questions' datasets that `probes` lists hold."""
    pairs = _near_lists(index, questions).withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("angle", "list")))
    r = pairs.agg(F.sum(F.when(F.col("rank") <= probes, F.col("n"))).alias("some"), F.sum("n").alias("every")).first()
    return (r["some"] or 0) / max(r["every"] or 0, 1)


def find_one(index: Index, tenant: str, dataset: str, vector: list[float], k: int = search.USUAL, *, probes: int = PROBES) -> DataFrame:
    """chunk_id, score of one question; the lists are named in the filter, so that no others are read. A dataset has 2^levels lists
    at most, and their numbers come to the driver."""
    x = np.array(vector, float)
    angle = _angle(index.tree.centre @ x / np.linalg.norm(x))
    mine = index.lists.where((F.col("tenant_id") == tenant) & (F.col("dataset_id") == dataset)).select("list", "levels").collect()
    lists = sorted((angle[2 ** r["levels"] - 1 + r["list"]], r["list"]) for r in mine)[:probes]
    where: Column = (F.col("tenant_id") == tenant) & (F.col("dataset_id") == dataset) & F.col("list").isin([n for _, n in lists])
    return top_k(index.rows, vector, k, where).select("chunk_id", "score")
