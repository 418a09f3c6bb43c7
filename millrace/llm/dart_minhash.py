"""Near-duplicate classes by DartMinHash signatures and banded joining.

Signatures. Every weighted element owns a strip of regions, unit boxes of weight by rank; hashed darts fall into them (about one
a box, the same for every text that has the element). A text throws the boxes under its elements' weights up to the rank at
which about k log k + 2 k darts have fallen, and further only while one of the k coordinates has none; the earliest dart of each
coordinate is the signature. Two texts agree on a coordinate with the probability of their weighted Jaccard similarity, and the
work is of the order of elements plus darts, not elements times coordinates.

Texts. Words are white-space parts without punctuation at their sides, in lower case; elements are the distinct runs of five words
(weight 1 each by default, their count with weights="counts"); a text of one to four words is one element; texts without words
are all alike, null ones too. Texts with equal words are one node, whose copies are never compared.

Links. Nodes that share a band are candidates. Each node is first held against one node of the bucket it shares most bands
with, then against the first node of its other buckets. In a bucket whose nodes are in several components still, all nodes of
different components are compared: a group's intersections are one matrix product over the elements that two of its nodes share,
and only the links come out. Buckets with the same nodes count once. A bucket too large for one group is split without loss:
similar nodes share one of the first n - ceil(0.8 n) + 1 elements of each, whatever order the elements have, so the bucket's
nodes meet by those elements, the rarest ones first; text that all of them have in common brings none together. What is large
even so goes in blocks, each two of which meet in one group. Links are exact similarities (of 64-bit element hashes) of at least
the threshold; classes are the connected components of links, so that a group of thousands of copies costs links in proportion
to its size. Bands of 7 of 224 coordinates find a pair of similarity 0.8 with a probability over 0.999. Everything is joined and
grouped by Spark; nothing of the corpus is collected.

Null texts are empty ones, and all texts without words are one class; null ids count as greatest, and a class of them alone has
class_id null. Rows that repeat an id are told apart by their texts. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_intdigest

from millrace.llm.common import hot_join, slices, texts, written

WORDS, BANDS, ROWS, SIMILAR = 5, 32, 7, 0.8
#: Nodes, and elements of nodes, that are compared as one group.
BLOCK, WEIGHT = 1000, 2_000_000
REMEMBERED = 250_000
#: Marks that are cut off the sides of words.
MARKS = string.punctuation + "«»“”„‘’…–—·¿¡"
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (three multiplications and shifts)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _darts_a_box() -> np.ndarray:
    """How many darts a box holds by 16 bits of its hash: a Poisson law of mean 1."""
    p, total, out = math.exp(-1), 0.0, np.zeros(1 << 16, np.uint8)
    for k in range(12):
        total += p
        out[min(1 << 16, round(total * (1 << 16))) :] = k + 1
        p /= k + 1
    return out


_COUNT = _darts_a_box()


class Elements:
    """Texts -> element hashes; a worker remembers its words' hashes."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def word(self, w: str) -> int:
        core = w.lower().strip(MARKS)
        h = (xxh3_64_intdigest(core.encode("utf-8", "replace")) | 1) if core else 0
        self.known[w] = h
        return h

    def words(self, text: str) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        parts = text.split()
        try:
            found = [known[w] for w in parts]
        except KeyError:
            found = [known.get(w) or self.word(w) for w in parts]
        h = np.array(found, np.uint64)
        return h[h != 0]

    def elements(self, words: np.ndarray) -> np.ndarray:
        """Hash of each run of five words; of all words if they are fewer."""
        if not len(words):
            return words
        size = min(WORDS, len(words))
        n = len(words) - size + 1
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = mix(h + words[k : k + n])
        return h


def node_of(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """(sets, k) earliest darts: each a rank (16 bits of box, 48 bits within it) that also identifies the dart. Sets are of
    distinct element hashes and not empty; weights are positive (default 1 each)."""
    out = np.full((len(sets), k), np.iinfo(np.uint64).max, np.uint64)
    flat, expected = out.ravel(), k * math.log(k) + 2 * k
    size = np.array([len(s) for s in sets])
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    depth = np.ones(len(items), np.int64)
    if weights is not None:
        heavy = np.concatenate(weights).astype(float)
        depth = np.ceil(heavy).astype(np.int64)
        total = np.bincount(owner, heavy, len(sets))
        limit = np.repeat(heavy, depth) - (np.arange(depth.sum()) - np.repeat(np.cumsum(depth) - depth, depth))
        layer = np.arange(depth.sum()) - np.repeat(np.cumsum(depth) - depth, depth)
        items, owner = mix(np.repeat(items, depth) + layer.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), np.repeat(owner, depth)
    else:
        total, limit = size.astype(float), None
    low, high = np.zeros(len(sets), np.int64), np.ceil(expected / total).astype(np.int64)
    while len(items):
        span = (high - low)[owner]
        box = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(low[owner], span)
        seed = mix(np.repeat(items, span) + (box.astype(np.uint64) + _U(1)) * _U(0xD1B54A32D192ED03))
        darts = _COUNT[(seed & _U(0xFFFF)).astype(np.int64)].astype(np.int64)
        which = np.repeat(np.arange(len(seed)), darts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
        d = mix(seed[which] + (nth.astype(np.uint64) + _U(1)) * _U(0xA0761D6478BD642F))
        at = np.repeat(owner, span)[which]
        if limit is not None:  # the dart's weight has to be under the element's
            under = (mix(d) >> _U(11)).astype(float) / 2**53 < np.repeat(limit, span)[which]
            which, d, at = which[under], d[under], at[under]
        np.minimum.at(flat, at * k + (d & _U(0xFFFF)).astype(np.int64) % k, (box[which].astype(np.uint64) << _U(48)) | (d >> _U(16)))
        open_ = (out == np.iinfo(np.uint64).max).any(1)
        low, high = high, np.where(open_, 2 * high, high)  # the next ranks, where a coordinate has no dart yet
        keep = open_[owner]
        items, owner = items[keep], owner[keep]
        limit = limit[keep] if limit is not None else None
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the bands."""
    part = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), part.shape[:2])
    for r in range(ROWS):
        h = mix(h + part[:, :, r] * _U(0x9E3779B97F4A7C15))
    return h.view(np.int64)


SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])
NODES = T.StructType([T.StructField("node", T.LongType()), T.StructField("elements", T.ArrayType(T.LongType()))])


def hash_of(text: str = "text") -> Column:
    """With doc_id it tells a row's text from others of the same id, or without one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def key(doc_id: str, text_hash: Column) -> Column:
    """One column that equal ids (null ones too) with equal texts have in common."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), text_hash.cast("string"))


def least(doc_id: str = "doc_id", text_hash: str = "hash") -> Column:
    """Aggregate: the row of least doc_id, null ids last; the least hash among rows of one id."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(text_hash).alias("hash")))


def sign(docs: DataFrame, weights: str = "set") -> DataFrame:
    """doc_id, hash (of the text), node (of equal words), n (how many elements it is compared by) and bands (empty without words)."""
    arrow = to_arrow_schema(SIGNED)

    def lists(a: np.ndarray, full: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(np.where(full, a.shape[1], 0))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(a.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Elements()
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for a, b in slices(column, 1 << 20):
                words = [maker.words(t) for t in column[a:b].to_pylist()]
                found = [np.unique(maker.elements(w), return_counts=True) for w in words]
                full = np.array([len(w) > 0 for w in words])
                some = [f for f in found if len(f[0])]
                sig = signatures([f[0] for f in some], [f[1] for f in some] if weights == "counts" else None) if some else np.zeros((0, BANDS * ROWS), np.uint64)
                columns = [ids[a:b], batch.column("hash")[a:b], pa.array([node_of(w) for w in words], pa.int64()), pa.array([int(f[1].sum()) if weights == "counts" else len(f[0]) for f in found], pa.int32()), lists(bands_of(sig), full)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return texts(docs, hash_of().alias("hash")).mapInArrow(run, SIGNED)


def compared(elements: np.ndarray, weights: str) -> np.ndarray:
    """Sorted hashes of a text's elements; with counts, of each element's first, second, ... occurrence."""
    h, count = np.unique(elements, return_counts=True)
    if weights == "counts":
        h = np.sort(mix(np.repeat(h, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)))
    return h.view(np.int64)


def elements_of(docs: DataFrame, weights: str = "set") -> DataFrame:
    """node, elements (see compared()) of each row of docs (text, node) whose words are its node's."""
    arrow = to_arrow_schema(NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Elements()
        for batch in batches:
            column, nodes = batch.column("text"), batch.column("node")
            for a, b in slices(column, 1 << 20):
                rows = [(n, maker.words(t)) for n, t in zip(nodes[a:b].to_pylist(), column[a:b].to_pylist(), strict=True)]
                rows = [(n, compared(maker.elements(w), weights)) for n, w in rows if node_of(w) == n]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], schema=arrow)

    return docs.select("text", "node").mapInArrow(run, NODES)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the graph of edges (a, b). Labels flow to neighbours and along labels, round by round;
    each round is written, so a lost executor repeats one at most."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        new = written(step.join(jump, "to").select("node", F.least("to", "further").alias("component"), "was"))
        if not new.where("component <> was").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")


def mixed(rows: DataFrame) -> DataFrame:
    """key, members, weight of the groups of rows (key, node, n, component) whose nodes are in several components; of groups with
    the same nodes, one."""
    found = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("node")).alias("print"))
    return found.where("low <> high").groupBy("members", "weight", "print").agg(F.min("key").alias("key")).drop("print")


class Linker:
    """Verified links of candidate nodes, and the components that they make so far."""

    def __init__(self, elements: DataFrame, similar: float):
        self.elements, self.similar = elements, similar  # node, elements
        self.known: DataFrame | None = None  # node, component

    def of(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        """rows with the component of a node's column; a node without links is its own."""
        if self.known is None:
            return rows.withColumn(name, F.col(node))
        labels = self.known.select(F.col("node").alias(node), F.col("component").alias("_c"))
        return rows.join(labels, node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c")

    def link(self, pairs: DataFrame) -> bool:
        """Compare pairs (a, b) exactly, b being a node that many others may have, and join the components of those that are
        similar. Says whether there were any pairs."""
        pairs = written(pairs)
        if not pairs.limit(1).count():
            return False
        second = hot_join(pairs, self.elements.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
        both = second.join(self.elements.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
        common = F.size(F.array_intersect("x", "y"))
        edges = both.where(common >= F.lit(self.similar) * (F.size("x") + F.size("y") - common)).select("a", "b")
        self.merge(self.of(self.of(written(edges), "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        return True

    def merge(self, edges: DataFrame) -> None:
        """Join the components of edges (a, b) between components."""
        merged = components(edges.where("a <> b"))
        if self.known is None:
            self.known = merged
            return
        old = self.known.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        self.known = written(old.union(merged.join(self.known, "node", "left_anti")))

    def split(self, rows: DataFrame) -> DataFrame:
        """rows (key, node, n, component) of groups, with a group for each element by which similar nodes of it have to meet."""
        has = rows.select("node", "n").distinct().join(self.elements, "node").select("node", "n", F.explode("elements").alias("element"))
        shared = has.groupBy("element").agg(F.count("*").alias("nodes")).where("nodes > 1")
        ranked = has.join(shared, "element").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("nodes", "element"))).alias("r"))
        # the n - size(r) elements that no other node has come first, and lead nowhere
        first = F.greatest(F.size("r") - F.ceil(F.lit(self.similar) * F.col("n") - F.lit(1e-9)).cast("int") + 1, F.lit(0))
        meet = ranked.select("node", F.explode(F.slice("r", F.lit(1), first)).alias("e")).select("node", "e.element")
        return rows.join(meet, "node").select(F.xxhash64("key", "element").alias("key"), "node", "n", "component")

    def link_within(self, filed: DataFrame) -> None:
        """Compare all nodes of one band (band, node, n) that are in different components."""
        rows = written(self.of(filed.select(F.col("band").alias("key"), "node", "n"), "node", "component"))
        open_ = written(rows.join(mixed(rows), "key"))
        if not open_.limit(1).count():
            return
        fits = (F.col("members") <= BLOCK) & (F.col("weight") <= WEIGHT)
        large = open_.where(~fits).drop("members", "weight")
        if large.limit(1).count():
            parts = written(self.split(large))
            open_ = open_.where(fits).unionByName(parts.join(mixed(parts), "key"))
        blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("weight") / WEIGHT))
        rows = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component")
        rows, similar = rows.join(self.elements, "node").drop("node"), self.similar

        def compare(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(links(group["component"].to_numpy(), list(group["elements"]), similar), columns=["a", "b"])

        self.merge(written(rows.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()))


def links(component: np.ndarray, elements: list[np.ndarray], similar: float) -> np.ndarray:
    """Pairs of different components of which two nodes are similar."""
    size = np.array([len(e) for e in elements], np.float32)
    if not len(size) or (component == component[0]).all():
        return np.zeros((0, 2), np.int64)
    flat, owner = np.concatenate(elements), np.repeat(np.arange(len(size)), size.astype(int))
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # an element of one node alone is in no intersection
    names, column = np.unique(column[shared], return_inverse=True)
    owner, common = owner[shared], np.zeros((len(size), len(size)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, len(names), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((len(size), min(4096, len(names) - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        common += part @ part.T
    i, j = np.nonzero(common >= np.float32(similar) * (size[:, None] + size[None, :] - common) - np.float32(1e-3))
    exact = common[i, j].astype(float) >= similar * (size[i].astype(float) + size[j] - common[i, j])
    pairs = np.stack([component[i[exact]], component[j[exact]]], 1)
    return np.unique(pairs[pairs[:, 0] < pairs[:, 1]], axis=0)


def linked(docs: DataFrame, similar: float, weights: str) -> tuple[DataFrame, DataFrame, Linker]:
    """The signed rows, their nodes (node, doc_id and hash of its least row, bands), and a linker that has seen all candidates."""
    signed = written(sign(docs, weights))
    nodes = signed.groupBy("node").agg(least().alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("node", "at.doc_id", "at.hash", "n", "bands"))
    rows = nodes.select("node", "n", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where("members > 1").select("band", "pivot")
    filed = written(rows.join(buckets, "band"))  # the nodes that share a band with another
    at = nodes.join(filed.select("node").distinct(), "node").select(key("doc_id", F.col("hash")).alias("_row"), "node")
    each = texts(docs, key("doc_id", hash_of()).alias("_row")).select("_row", "text").dropDuplicates(["_row"])
    linker = Linker(written(elements_of(each.join(at, "_row"), weights)), similar)
    star = written(filed.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("shared")))
    best = star.groupBy("node").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("pivot"))
    if linker.link(best.select(F.col("node").alias("a"), F.col("pivot").alias("b"))):
        rest = linker.of(linker.of(star.join(best, ["node", "pivot"], "left_anti"), "node", "x"), "pivot", "y").where("x <> y")
        linker.link(rest.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        linker.link_within(filed)
    return signed, nodes, linker


def firsts(nodes: DataFrame, linker: Linker) -> DataFrame:
    """node and `at`, the least row (see least()) of its class, of the nodes that have links."""
    if linker.known is None:
        return nodes.limit(0).select("node", F.struct(F.lit(False).alias("none"), "doc_id", "hash").alias("at"))
    classes = linker.known.join(nodes.select("node", "doc_id", "hash"), "node").groupBy("component").agg(least().alias("at"))
    return hot_join(linker.known, classes, "component").select("node", "at")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, weights: str = "set") -> DataFrame:
    """doc_id, class_id of every row of docs: the least doc_id of the class that is not null; null if its rows have
    null ids alone."""
    signed, nodes, linker = linked(docs, similar, weights)
    first = nodes.select("node", "doc_id").join(firsts(nodes, linker), "node", "left")
    first = written(first.select("node", F.when(F.col("at").isNull(), F.col("doc_id")).otherwise(F.col("at.doc_id")).alias("class_id")))
    return hot_join(signed.select("node", "doc_id"), first, "node").select("doc_id", "class_id")


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each class: that of its least doc_id, or one without id if the class has no other. Of rows that share
    that id the text of least hash stays, and of equal texts one. Classes are of rows: other classes with the same id, or with
    none, keep theirs."""
    _, nodes, linker = linked(docs, similar, "set")
    own = nodes.select("node", key("doc_id", F.col("hash")).alias("_millrace_row"))
    at = firsts(nodes, linker).select("node", key("at.doc_id", F.col("at.hash")).alias("_first"))
    first = own.join(at, "node", "left").where("_first IS NULL OR _first = _millrace_row").select("_millrace_row")
    rows = docs.withColumn("_millrace_row", key("doc_id", hash_of())).dropDuplicates(["_millrace_row"])
    return rows.join(first, "_millrace_row", "left_semi").drop("_millrace_row").select(*docs.columns)
