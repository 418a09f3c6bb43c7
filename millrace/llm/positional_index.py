"""Benchmark decontamination by a positional inverted index.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. The index is written once, by shards:
a shard holds some MB of documents, their places, and for each of its words the list of positions at which it stands, counted
through the shard. Building it needs no shuffle, and a lost task makes its shards again. A shard is one row of some MB and a row group
of its own: Spark's reader holds a row group's rows at once, and arrays with three numbers an entry, so the positions are bytes.

Test items are cut into phrases (windows of consecutive words; a shorter item is one phrase). In each shard, a phrase's candidate
places are the list of its rarest word (by the whole index's counts), moved by that word's offset; the other words' lists, moved
likewise, are intersected with them from the rarest to the most frequent. Exact matches are what all lists hold. Proximity matches
are places of the rarest word that have each other word of the phrase within a distance, in any order.

The test items are broadcast by blocks of some BLOCK bytes, one after the other, so neither the driver nor a task ever holds more of
them, however many there are; a long item is cut into pieces that overlap by a phrase less one word. Null and empty
texts have no words. A null item id is the id "null"; rows that repeat an item's id are one item. Rows that repeat a doc_id are each a
document of its own. Other columns of the inputs are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.common import slices, texts, written

WINDOW, SHARD, BLOCK, STEP = 10, 8 << 20, 4 << 20, 1 << 20
_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_L, _S = T.LongType(), T.StringType()
#: ids, starts: of the shard's documents; there is one start more, the end. terms are sorted by their bytes; ends[i] is where the
#: list of terms[i] ends in positions, which are 32-bit integers, little-endian.
INDEX = T.StructType([T.StructField("shard", _L), T.StructField("ids", T.ArrayType(_L)), *(T.StructField(n, T.ArrayType(k)) for n, k in (("starts", _L), ("terms", T.BinaryType()), ("ends", _L))), T.StructField("positions", T.BinaryType())])
#: A document's matches with one item: from_word and to_word are the ends of its merged spans, in words of the document.
SPANS = T.StructType([T.StructField("shard", _L), T.StructField("place", _L), T.StructField("item_id", _S), T.StructField("from_word", T.ArrayType(_L)), T.StructField("to_word", T.ArrayType(_L))])


def words(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def _pieces(text: str, size: int = 1 << 20) -> Iterator[pa.Array]:
    """A text's words, some MB of text at a time, so that a long one is not held as Python objects."""
    data, start = text.encode().translate(_BYTES), 0
    while start < len(data):
        stop = data.find(b" ", start + size)
        stop = len(data) if stop < 0 else stop
        yield pa.array(data[start:stop].split(), pa.binary())
        start = stop


def _postings(pieces: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Sorted terms, the ends of their lists, and the lists one after the other."""
    coded = pa.chunked_array(pieces, pa.binary()).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[coded.indices.to_numpy()]
    return coded.dictionary.take(pa.array(order)), np.cumsum(np.bincount(codes, minlength=len(order))), np.argsort(codes, kind="stable").astype("<i4")


def build(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """The index of docs (doc_id, text), as a written table of one row a shard."""
    arrow = to_arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, starts, pieces, size = [], [0], [], 0

        def row() -> pa.RecordBatch:
            terms, ends, positions = _postings(pieces)
            fields = ([first + made], [ids], [starts], [terms], [ends], [positions.tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(fields, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if size > shard_bytes:
                    yield row()
                    made, ids, starts, pieces, size = made + 1, [], [0], [], 0
                value, own = text.as_py(), 0
                for piece in _pieces(value):
                    pieces.append(piece)
                    own += len(piece)
                ids.append(i)
                starts.append(starts[-1] + own)
                size += len(value)
        if ids:
            yield row()

    return written(texts(docs).mapInArrow(run, INDEX), **{"parquet.block.row.count.limit": "1"})


def places(index: DataFrame) -> DataFrame:
    """shard, place, doc_id, n_words of every document; shard and place tell rows of one id apart."""
    rows = index.select("shard", F.posexplode(F.transform("ids", lambda x, i: F.struct(x.alias("doc_id"), (F.get("starts", i + 1) - F.get("starts", i)).alias("n_words")))).alias("place", "d"))
    return rows.select("shard", F.col("place").cast("long").alias("place"), "d.doc_id", "d.n_words")


def term_counts(index: DataFrame) -> DataFrame:
    """term, n: how often each word stands in all documents."""
    n = F.transform("ends", lambda e, i: e - F.when(i > 0, F.get("ends", i - 1)).otherwise(0))
    return index.select(F.explode(F.arrays_zip("terms", n.alias("n"))).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.n").alias("n")).groupBy("term").agg(F.sum("n").alias("n"))


def phrases(items: DataFrame, window: int, piece_bytes: int) -> DataFrame:
    """The items as written pieces: item_id, words (array<binary>) and bytes. Pieces of an item overlap by window - 1 words."""
    schema = T.StructType([T.StructField("item_id", _S), T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("bytes", _L)])
    arrow, step = to_arrow_schema(schema), max(piece_bytes // 32, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 20):
                rows = []
                for i, text in zip(batch.column("item_id")[a:b].to_pylist(), batch.column("text")[a:b].to_pylist(), strict=True):
                    w = words(text)
                    rows += [(i, w[s : s + step + window - 1]) for s in range(0, max(len(w) - window + 1, 1), step) if w]
                yield pa.RecordBatch.from_pylist([{"item_id": i, "words": w, "bytes": sum(map(len, w)) + 16 * len(w)} for i, w in rows], schema=arrow)

    slim = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(slim.mapInArrow(run, schema))


class Phrases:
    """A block of pieces, ready to be looked for: the different phrases with their words by rank of rarity, and whose they are."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], counts: dict[bytes, int], window: int):
        known = {t: i for i, t in enumerate(sorted({w for _, ws in pieces for w in ws if counts.get(w)}))}
        self.terms = sorted(known)
        rarity = [counts[t] for t in self.terms]
        found: dict[tuple[bytes, ...], int] = {}
        whose: set[tuple[int, str]] = set()
        for item, ws in pieces:
            for i in range(max(len(ws) - window + 1, 1)):
                phrase = tuple(ws[i : i + window])
                if all(w in known for w in phrase):  # others stand nowhere
                    whose.add((found.setdefault(phrase, len(found)), item))
        of, self.items = zip(*sorted(whose), strict=True) if whose else ((), ())
        self.owners = np.searchsorted(np.array(of, np.int64), np.arange(len(found) + 1))  # phrase p belongs to items[owners[p]:owners[p + 1]]
        self.length = np.array([len(p) for p in found], np.int64)
        self.term, self.offset = (np.full((len(found), window), -1, np.int64) for _ in range(2))
        for p, phrase in enumerate(found):
            order = sorted(range(len(phrase)), key=lambda i: (rarity[known[phrase[i]]], phrase[i], i))
            self.term[p, : len(order)] = [known[phrase[i]] for i in order]
            self.offset[p, : len(order)] = order


class Shard:
    """One shard's lists, of a block's terms only: keys are rank of the term * span + position, sorted, so that one binary search
    looks many positions up in many lists."""

    def __init__(self, row: dict, terms: pa.Array):
        self.starts = row["starts"].values.to_numpy()
        self.span = int(self.starts[-1]) + 1
        ends, positions = row["ends"].values.to_numpy(), np.frombuffer(row["positions"].as_buffer(), "<i4")
        at = pc.index_in(terms, value_set=row["terms"].values).fill_null(-1).to_numpy()
        there = np.flatnonzero(at >= 0)
        stop = ends[at[there]]
        start = np.where(at[there] > 0, ends[np.maximum(at[there] - 1, 0)], 0)
        self.size = np.zeros(len(terms), np.int64)
        self.size[there] = stop - start
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        parts = [positions[a:b].astype(np.int64) + t * self.span for t, a, b in zip(there.tolist(), start.tolist(), stop.tolist(), strict=True)]
        self.keys = np.concatenate(parts) if parts else np.empty(0, np.int64)

    def candidates(self, block: Phrases, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases that have all their words here, and the positions of their rarest word; about `step` pairs at a time."""
        size = np.where(block.term >= 0, self.size[block.term], 1).min(1, initial=1 << 40) if len(block.term) else np.empty(0, np.int64)
        able = np.flatnonzero(size > 0)
        n = self.size[block.term[able, 0]]
        total = np.concatenate([[0], np.cumsum(n)])
        for a in range(0, int(total[-1]), step):  # a range of pairs, which may begin and end within a phrase's list
            pair = np.arange(a, min(a + step, int(total[-1])))
            which = np.searchsorted(total, pair, side="right") - 1
            phrase = able[which]
            term = block.term[phrase, 0]
            yield phrase, self.keys[self.first[term] + pair - total[which]] - term * self.span

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * self.span + position
        at = np.searchsorted(self.keys, key)
        return (self.keys[np.minimum(at, len(self.keys) - 1)] == key) & (position >= 0) & (position < self.span)

    def near(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Has a term's list a position from low to high?"""
        return np.searchsorted(self.keys, term * self.span + high, side="right") > np.searchsorted(self.keys, term * self.span + low)

    def bounds(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The document that holds each position, its first position, and the one behind it. Empty documents hold none."""
        place = np.searchsorted(self.starts, position, side="right") - 1
        return place, self.starts[place], self.starts[np.minimum(place + 1, len(self.starts) - 1)]

    def exact(self, block: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases, and the first and the last position of each place where all words stand in order, within one document."""
        out = []
        for phrase, position in self.candidates(block):
            start = position - block.offset[phrase, 0]
            _, low, high = self.bounds(position)
            inside = (start >= low) & (start + block.length[phrase] <= high)
            phrase, start = phrase[inside], start[inside]
            for rank in range(1, block.term.shape[1]):
                term = block.term[phrase, rank]
                kept = (term < 0) | self.holds(np.maximum(term, 0), start + block.offset[phrase, rank])
                phrase, start = phrase[kept], start[kept]
            out.append((phrase, start, start + block.length[phrase] - 1))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3

    def close(self, block: Phrases, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases, and the position of their rarest word (twice), where each other word stands within a distance, in one document."""
        out = []
        for phrase, position in self.candidates(block):
            _, low, high = self.bounds(position)
            low, high = np.maximum(low, position - distance), np.minimum(high - 1, position + distance)
            for rank in range(1, block.term.shape[1]):
                term = block.term[phrase, rank]
                kept = (term < 0) | self.near(np.maximum(term, 0), low, high)
                phrase, position, low, high = (x[kept] for x in (phrase, position, low, high))
            out.append((phrase, position, position))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _spans(shard: Shard, block: Phrases, phrase: np.ndarray, start: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, str, list[int], list[int]]]:
    """place, item, and the ends of merged spans, of matches."""
    places, first, _ = shard.bounds(start)
    found: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for p, place, a, b in zip(phrase.tolist(), places.tolist(), (start - first).tolist(), (last - first).tolist(), strict=True):
        for o in range(block.owners[p], block.owners[p + 1]):
            found.setdefault((place, block.items[o]), []).append((a, b))
    for (place, item), spans in found.items():
        low, high = [], []
        for a, b in sorted(spans):
            if high and a <= high[-1] + 1:
                high[-1] = max(high[-1], b)
            else:
                low.append(a)
                high.append(b)
        yield place, item, low, high


def matches(index: DataFrame, items: DataFrame, *, window: int = WINDOW, within: int | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """shard, place, item_id, from_word, to_word: where phrases of `items` (item_id, text) stand in the index's documents, as merged
    spans of words, one row for each document and item (several, where a long item has several pieces). within: proximity instead of
    exact matches; spans then hold the places of rarest words."""
    spark, arrow = index.sparkSession, to_arrow_schema(SPANS)
    pieces = phrases(items, window, block_bytes)
    # a piece's block is the sum of the sizes before it: sums of slices first, then within each slice
    at = F.sum("bytes").over(Window.partitionBy("slice").orderBy("row"))
    placed = written(pieces.withColumn("slice", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    before = placed.groupBy("slice").agg(F.sum("bytes").alias("size"))
    bounded = [(r["slice"], r["size"]) for r in before.orderBy("slice").collect()]  # a row a task
    offsets = spark.createDataFrame([(s, sum(x for _, x in bounded[:k])) for k, (s, _) in enumerate(bounded)], "slice int, before long")
    blocked = written(placed.withColumn("at", at).join(F.broadcast(offsets), "slice").select("item_id", "words", F.floor((F.col("at") + F.col("before") - 1) / block_bytes).alias("block")))
    counts = written(term_counts(index))
    out = spark.createDataFrame([], SPANS)
    for (number,) in blocked.select("block").distinct().orderBy("block").collect():
        here = blocked.where(F.col("block") == number)
        got = [(r["item_id"], [bytes(w) for w in r["words"]]) for r in here.collect()]
        vocabulary = here.select(F.explode("words").alias("term")).distinct()
        n = {bytes(r["term"]): r["n"] for r in counts.join(F.broadcast(vocabulary), "term").collect()}
        shared = spark.sparkContext.broadcast(Phrases(got, n, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            terms = pa.array(block.terms, pa.binary())
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k] for c in ("shard", "starts", "terms", "ends", "positions")}
                    shard = Shard(row, terms)
                    found = shard.exact(block) if within is None else shard.close(block, within)
                    rows = [(row["shard"].as_py(), *x) for x in _spans(shard, block, *found)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        out = out.unionByName(written(index.select("shard", "starts", "terms", "ends", "positions").mapInArrow(run, SPANS)))
        shared.destroy()
    return out


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, within: int | None = None, shard_bytes: int = SHARD, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit (words within any match), n_items, items (ids, sorted as strings) of every document."""
    index = build(docs, shard_bytes)
    found = matches(index, items, window=window, within=within, block_bytes=block_bytes)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("from_word").alias("a"), F.col("to_word").alias("b")))))
    by_doc = found.groupBy("shard", "place").agg(F.array_sort(F.collect_set("item_id")).alias("items"), spans.alias("spans"))
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(s, x):
        return F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"] - 1))).alias("n"))

    hit = F.aggregate("spans", start, step, lambda s: s["n"])
    out = places(index).join(by_doc.select("shard", "place", "items", hit.alias("n_hit")), ["shard", "place"], "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"))
