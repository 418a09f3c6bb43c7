"""Language-model scores by deleted interpolation of word n-grams (bigrams, unigrams and the uniform law).

    p(w | v) = l2(b) c(vw) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1),    b: the bucket of c(v), by powers of two

Training texts fall into two parts by a hash of their id. Expectation-maximisation fits the weights l of each bucket to the
counts of each part under the maximum-likelihood estimates of the other one, from which it is deleted; the model then uses the
counts of both. For the fit, held-out counts are summed over cells of a sixteenth of an octave of the two estimates, which bounds what
reaches the driver (a row a cell) whatever the corpus's size, and moves no weight by more than some ten-thousandths.

How it runs. Texts are packed into chunks of some million tokens where they are read; a chunk keeps its words' 64-bit hashes
and its texts as numbers of those words. Each chunk asks once for each distinct unigram and bigram that it has: sorted keys,
stored as differences, with the chunk's own counts in both training parts, cut by their leading bits into buckets. A bucket sums
the counts of a key over all chunks and answers each chunk with two numbers a key. So a key that stands in every text costs a
row of each chunk, not of each occurrence. Beyond GROUP chunks sums go in two levels: the chunks of a group are summed first, the
groups ask in their place by finer buckets, and the answers go back the same way. So a bucket has at most GROUP chunks, then at
most as many rows as there are groups, even for a key that every text has, and a row holds many keys at any size. Counts are
over every token of the training texts. Bigram keys within a chunk are hashes, too; keys stand for words with an expected error of under
one in 10^8.

Tokens are white-space parts of the text's bytes with A to Z in lower case, then one end, which is also the context of the first
word. Null and empty texts have the end alone. Repeated rows count and are scored each. Without training texts every estimate
is the uniform one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_intdigest

from millrace.llm.common import arrow_rows, columns, texts, written

#: Tokens of a chunk, keys of a bucket (powers of two only bound memory), chunks of a group, cells an octave, and rounds of the fit.
CHUNK, BUCKET, GROUP, CELLS, ROUNDS = 2_500_000, 4_000_000, 1000, 16, 60
#: The cell of an estimate that is the uniform one's; NONE: of an estimate of 0.
ZERO, NONE = 1 << 18, -1
CHUNKS = columns("chunk long,n_tokens long,ids binary,known binary,part binary,lengths binary,words binary,tokens binary")
ASKS = columns("bucket long,chunk long,kind int,n long,keys binary,a binary,b binary")
ANSWERS = columns("chunk long,bucket long,kind int,n long,a binary,b binary")
SCORES = columns("doc_id long,held_out boolean,n_tokens long,n_known long,train_tokens long,base_score double,score double")
_U = np.uint64
#: The end of a text, which no word's bytes can be.
END = b""


def pack(a: np.ndarray) -> bytes:
    """Whole numbers of 0 and more, compressed by their bytes' places."""
    a = np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)
    used = int(np.flatnonzero(a.any(0)).max(initial=-1)) + 1
    return bytes([used]) + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a[:, :used].T).tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if data[0] and n:
        out[:, : data[0]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], n).T
    return out.view("<u8").ravel().astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chunked(docs: DataFrame, folds: int, held: int) -> DataFrame:
    """Rows of CHUNKS. part: 0 and 1 for the two training parts, 2 for the rest. To be written before use: the chunks' numbers
    hold for one run."""
    arrow = to_arrow_schema(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        words: dict[bytes, int] = {}
        ids, parts, lengths, tokens, total = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            stream = np.concatenate(tokens)
            hashes = np.array([xxh3_64_intdigest(w) for w in words], np.uint64)
            values = {
                "chunk": chunk, "n_tokens": len(stream), "ids": np.array([i or 0 for i in ids], np.int64).tobytes(), "known": bytes(i is not None for i in ids),
                "part": bytes(parts), "lengths": pack(np.array(lengths)), "words": hashes.tobytes(), "tokens": pack(stream),
            }
            return arrow_rows({k: [v] for k, v in values.items()}, arrow)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc = doc.as_py()
                found = text.as_py().encode("utf-8", "replace").lower().split()  # of bytes: only A to Z change, only ASCII space parts
                found.append(END)
                tokens.append(np.array([words.setdefault(w, len(words)) for w in found], np.uint32))
                name = ("null" if doc is None else str(doc)).encode()
                ids.append(doc)
                parts.append(2 if zlib.crc32(name) % folds == held else zlib.crc32(b"part of " + name) >> 8 & 1)
                lengths.append(len(found))
                total += len(found)
                if total >= CHUNK:
                    yield row()
                    chunk += 1
                    words, ids, parts, lengths, tokens, total = {}, [], [], [], [], 0
        if ids:
            yield row()

    return texts(docs).mapInArrow(run, CHUNKS)


def cut(chunk: int, kind: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> Iterator[tuple]:
    """Rows of ASKS for sorted keys, one for each of their leading bits."""
    bucket = (keys >> _U(64 - bits)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j > i:
            step = keys[i:j].copy()
            step[1:] -= keys[i : j - 1]
            yield int(bucket[i]), chunk, kind, j - i, pack(step), pack(a[i:j]), pack(b[i:j])


class Chunk:
    """A chunk's keys, in the order in which it asks for them, and where its tokens find their own."""

    def __init__(self, row: dict):
        n_docs = len(row["part"])
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8).astype(bool)
        self.part = np.frombuffer(row["part"], np.uint8)
        self.lengths = unpack(row["lengths"], n_docs).astype(np.int64)
        hashes, stream = np.frombuffer(row["words"], np.uint64), unpack(row["tokens"], row["n_tokens"]).astype(np.int64)
        end = stream[-1] if len(stream) else 0  # every text ends with it
        self.begin = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(stream)
        before[1:] = stream[:-1]
        before[self.begin] = end
        pairs, self.pair_of = np.unique(before * len(hashes) + stream, return_inverse=True)
        self.v, self.w = pairs // len(hashes), pairs % len(hashes)
        self.stream, self.token_part = stream, np.repeat(self.part, self.lengths)
        self.keys = {1: hashes, 2: mix(mix(hashes[self.v]) + hashes[self.w] * _U(0x9E3779B97F4A7C15))}
        self.order = {kind: np.argsort(k, kind="stable") for kind, k in self.keys.items()}

    def own(self, kind: int, part: int) -> np.ndarray:
        of = self.stream if kind == 1 else self.pair_of
        return np.bincount(of[self.token_part == part], minlength=len(self.keys[kind]))

    def asks(self, chunk: int, bits: int) -> Iterator[tuple]:
        for kind, keys in self.keys.items():
            order = self.order[kind]
            yield from cut(chunk, kind, keys[order], self.own(kind, 0)[order], self.own(kind, 1)[order], bits)

    def answered(self, rows: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each kind, the corpus's counts in both parts, in the order of the chunk's keys."""
        out = {}
        for kind, keys in self.keys.items():
            mine = rows[rows["kind"] == kind].sort_values("bucket")
            both = []
            for name in ("a", "b"):
                counts = np.zeros(len(keys), np.int64)
                if len(mine):
                    counts[self.order[kind]] = np.concatenate([unpack(x, n) for x, n in zip(mine[name], mine["n"], strict=True)]).astype(np.int64)
                both.append(counts)
            out[kind] = (both[0], both[1])
        return out


def summed(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of rows of ASKS of one kind, where each row's keys are among them, and both counts of each."""
    size = rows["n"].to_numpy()
    keys, where = np.unique(np.concatenate([np.cumsum(unpack(k, n), dtype=np.uint64) for k, n in zip(rows["keys"], size, strict=True)]), return_inverse=True)
    sums = []
    for name in ("a", "b"):
        own = np.concatenate([unpack(x, n) for x, n in zip(rows[name], size, strict=True)]).astype(np.int64)
        sums.append(np.bincount(where, own, len(keys)).round().astype(np.int64))
    return keys, where, sums


def replies(rows: pd.DataFrame, bucket: int, kind: int, where: np.ndarray, sums: list[np.ndarray]) -> Iterator[tuple]:
    """Rows of ANSWERS for the askers of one kind."""
    ends = np.cumsum(rows["n"].to_numpy())
    for chunk, i, j in zip(rows["chunk"], ends - rows["n"].to_numpy(), ends, strict=True):
        yield chunk, bucket, kind, j - i, pack(sums[0][where[i:j]]), pack(sums[1][where[i:j]])


def answer(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: counts summed over all that ask. Its row for chunk -1 holds the distinct unigrams of training and their tokens."""
    bucket, out = int(rows["bucket"].iloc[0]), []
    for kind, mine in rows.groupby("kind"):
        _, where, sums = summed(mine)
        out += replies(mine, bucket, kind, where, sums)
        if kind == 1:
            out.append((-1, bucket, 0, int((sums[0] + sums[1] > 0).sum()), int(sums[0].sum()).to_bytes(8, "little"), int(sums[1].sum()).to_bytes(8, "little")))
    return pd.DataFrame(out, columns=[f.name for f in ANSWERS])


def answers(asks: DataFrame, groups: int, coarse: int, fine: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ANSWERS: what goes back to the chunks, and the rows for chunk -1. coarse and fine: leading bits of the buckets of
    chunks and of groups of chunks."""
    if groups == 1:
        every = written(asks.groupBy("bucket").applyInPandas(answer, ANSWERS))
        return every.where("chunk >= 0"), every.where("chunk = -1")
    asks = asks.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)))  # made again of the written chunks for each use

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, mine in rows.groupby("kind"):
            keys, _, (a, b) = summed(mine)
            out += cut(int(rows["group"].iloc[0]), kind, keys, a, b, fine)
        return pd.DataFrame(out, columns=[f.name for f in ASKS])

    every = written(asks.groupBy("group", "bucket").applyInPandas(combine, ASKS).groupBy("bucket").applyInPandas(answer, ANSWERS))
    back = every.where("chunk >= 0").select(F.col("chunk").alias("group"), F.shiftright("bucket", fine - coarse).alias("bucket"), F.col("bucket").alias("part"), "kind", "n", "a", "b")

    def hand_out(mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, of in mine.groupby("kind"):
            _, where, _ = summed(of)
            found = rows[rows["kind"] == kind].sort_values("part")  # the group's keys in order
            sums = [np.concatenate([unpack(x, n) for x, n in zip(found[name], found["n"], strict=True)]).astype(np.int64) for name in ("a", "b")]
            out += replies(of, int(of["bucket"].iloc[0]), kind, where, sums)
        return pd.DataFrame(out, columns=[f.name for f in ANSWERS])

    both = asks.groupBy("group", "bucket").cogroup(back.groupBy("group", "bucket"))
    return written(both.applyInPandas(hand_out, ANSWERS)), every.where("chunk = -1")


def octave(c: np.ndarray) -> np.ndarray:
    """The context's bucket: 0 for no count, then by powers of two."""
    return np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))), 0).astype(np.int64)


def ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def cells(chunk: Chunk, counts: dict, size: tuple[int, int], types: int) -> pd.DataFrame:
    """Held-out counts of a chunk by context bucket and the cells of both estimates."""
    out = []
    for kept, held in ((0, 1), (1, 0)):
        mine = chunk.own(2, held)
        at = np.flatnonzero(mine)
        context = counts[1][kept][chunk.v[at]]
        two, one = ratio(counts[2][kept][at], context), ratio(counts[1][kept][chunk.w[at]], size[kept])
        cell = lambda p: np.where(p > 0, np.round(CELLS * np.log2(np.maximum(p, 1e-300) * (types + 1))) + ZERO, NONE).astype(np.int64)
        key = (octave(context) << 40) + ((cell(two) + 1) << 20) + cell(one) + 1
        u, where = np.unique(key, return_inverse=True)
        out.append(pd.DataFrame({"key": u, "n": np.bincount(where, mine[at])}))
    return pd.concat(out)


def maximise(key: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Weights (l0, l1, l2) of each context bucket that has held-out counts. Estimates are relative to the uniform one."""
    bucket = key >> 40
    two, one = ((key >> 20) & 0xFFFFF) - 1, (key & 0xFFFFF) - 1
    p = np.stack([np.ones(len(key)), *(np.where(x != NONE, 2.0 ** ((x - ZERO) / CELLS), 0.0) for x in (one, two))], 1)
    names, at = np.unique(bucket, return_inverse=True)
    weights = np.full((len(names), 3), 1 / 3)
    for _ in range(rounds):
        share = weights[at] * p
        share *= (n / share.sum(1))[:, None]
        weights = np.stack([np.bincount(at, share[:, i], len(names)) for i in range(3)], 1)
        weights = (weights + 1e-3) / (weights + 1e-3).sum(1, keepdims=True)  # no weight becomes 0: every text has a score
    return dict(zip(names.tolist(), weights, strict=True))


def score(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """Rows of SCORES for all of docs (doc_id, text), from a model of those whose crc32(doc_id as text) mod folds is not held."""
    chunks = written(chunked(docs, folds, held))
    total, n_chunks = chunks.agg(F.sum("n_tokens"), F.count("*")).first()
    total, groups = total or 0, max(1, -(-n_chunks // GROUP))
    bits = lambda tokens: max(4, int(np.ceil(np.log2(max(tokens / BUCKET, 1)))))
    coarse, fine = bits(total / groups), bits(total)
    asks_arrow = to_arrow_schema(ASKS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                rows = zip(*Chunk(row).asks(row["chunk"], coarse), strict=True)
                yield arrow_rows({n: list(v) for n, v in zip(asks_arrow.names, rows, strict=True)}, asks_arrow)

    to_chunks, sizes = answers(chunks.mapInArrow(ask, ASKS), groups, coarse, fine)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": b["n"], "a": [int.from_bytes(x, "little") for x in b["a"]], "b": [int.from_bytes(x, "little") for x in b["b"]]})

    found = sizes.select("n", "a", "b").mapInPandas(add, "n long, a long, b long").agg(F.sum("n"), F.sum("a"), F.sum("b")).first()
    types, size = found[0] or 0, (found[1] or 0, found[2] or 0)
    answered = to_chunks.groupBy("chunk")

    def gather(mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(mine.iloc[0].to_dict())
        return cells(chunk, chunk.answered(rows), size, types)

    held_out = chunks.groupBy("chunk").cogroup(answered).applyInPandas(gather, "key long, n double").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    weights = maximise(held_out["key"].to_numpy(), held_out["n"].to_numpy())
    table = np.full((66, 3), 1 / 3)
    for b in range(66):  # a bucket without held-out counts takes the nearest one's weights
        if weights:
            table[b] = weights[min(weights, key=lambda x: (abs(x - b), x))]

    def final(mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(mine.iloc[0].to_dict())
        counts = chunk.answered(rows)
        n = sum(size)
        one, two = (counts[k][0] + counts[k][1] for k in (1, 2))
        context = one[chunk.v]
        lam = table[octave(context)]
        p = lam[:, 0] / (types + 1) + lam[:, 1] * ratio(one[chunk.w], n) + lam[:, 2] * ratio(two, context)
        rest = context == 0  # no context: its share goes to the other two
        p[rest] /= (lam[rest, 0] + lam[rest, 1] * (n > 0)) if rest.any() else 1
        sum_of = lambda x: np.add.reduceat(x, chunk.begin)
        base = np.log10((one + 0.5) / (n + 0.5 * (types + 1)))
        return pd.DataFrame({
            "doc_id": pd.array([int(i) if k else None for i, k in zip(chunk.ids, chunk.known, strict=True)], "Int64"),
            "held_out": chunk.part == 2, "n_tokens": chunk.lengths, "n_known": sum_of((one > 0)[chunk.stream].astype(np.int64)),
            "train_tokens": n, "base_score": sum_of(base[chunk.stream]), "score": sum_of(np.log10(p)[chunk.pair_of]),
        })

    return chunks.groupBy("chunk").cogroup(answered).applyInPandas(final, SCORES)
