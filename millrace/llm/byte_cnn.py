"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks (the last one ends with the text; shorter texts are padded with byte 0).
Learned filters run over each chunk's bytes and are max-pooled; the greatest, the mean and the least of each filter over all of
a text's chunks go through one hidden layer into one probability. Bytes are looked up in tables of filter weights, so that the
convolution is a sum of table rows. Null texts are empty ones; an empty text is one chunk of padding and gets a score too.

The network is fitted on the driver from a bounded sample of labelled rows: at most `rows` of each label, all chunks of each;
this is the only place where a sample is taken. Of texts that share a labelled id one is learned. Scores cover every byte of
every text, and so does the fit; both pool a long text part by part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns, crc_mod, map_texts, texts

CHUNK, HOP, WIDTH, STRIDE, FILTERS, HIDDEN = 512, 448, 8, 2, 24, 16
#: Labelled rows of each label, and passes over them; at least STEPS batches, so that few rows are learned, too.
ROWS, EPOCHS, STEPS = 1500, 8, 160
#: Chunks that are convolved at once.
PART = 256


def starts(n: int) -> np.ndarray:
    """Where the chunks of n bytes begin: every HOP bytes, the last one moved back to end with the text."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - CHUNK, HOP), n - CHUNK)


def chunks(data: bytes) -> np.ndarray:
    """(k, CHUNK) bytes that cover data."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < CHUNK:
        x = np.concatenate([x, np.zeros(CHUNK - len(x), np.uint8)])
    return x[starts(len(x))[:, None] + np.arange(CHUNK)]


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


class ByteCnn:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.w1 = r.normal(0, 0.15, (3 * FILTERS, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = r.normal(0, 0.3, HIDDEN).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)
        self.shift = 0.0

    def pool(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's greatest value over the windows of each chunk, and the window it is in."""
        n = (CHUNK - WIDTH) // STRIDE + 1
        total = self.table[0][x[:, : n * STRIDE : STRIDE]]
        for k in range(1, WIDTH):
            total += self.table[k][x[:, k : k + n * STRIDE : STRIDE]]
        if not where:
            return total.max(1), None
        at = total.argmax(1)
        return np.take_along_axis(total, at[:, None, :], 1)[:, 0], at

    def combine(self, pooled: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(texts, 3 * FILTERS) of each text's chunks, which begin at its row of pooled."""
        size = np.diff(np.append(begin, len(pooled)))[:, None].astype(np.float32)
        return np.concatenate([np.maximum.reduceat(pooled, begin), np.add.reduceat(pooled, begin) / size, np.minimum.reduceat(pooled, begin)], 1)

    def logit(self, features: np.ndarray) -> np.ndarray:
        return np.tanh(features @ self.w1 + self.b1) @ self.w2 + self.b2[0] + self.shift

    def gradient(self, sets: list[bytes], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean log loss of texts (their bytes) with labels y, and its gradient, which goes to the windows that won the pooling."""
        size = np.array([len(starts(len(s))) for s in sets])
        begin, owner = np.cumsum(size) - size, np.repeat(np.arange(len(sets)), size)
        x = np.concatenate([chunks(s) for s in sets])
        found = [self.pool(x[i : i + PART], True) for i in range(0, len(x), PART)]
        pooled, at = np.concatenate([p for p, _ in found]), np.concatenate([a for _, a in found])
        f = self.combine(pooled, begin)
        h = np.tanh(f @ self.w1 + self.b1)
        z = h @ self.w2 + self.b2[0]
        loss = float((np.logaddexp(0, z) - y * z).mean())
        dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        dh = dz[:, None] * self.w2 * (1 - h * h)
        high, mean, low = np.split(dh @ self.w1.T, 3, 1)

        def won(part: np.ndarray, best: np.ndarray) -> np.ndarray:
            """Each text's part, shared by its chunks that have its best value."""
            mine = (pooled == best[owner]).astype(np.float32)
            return part[owner] * mine / np.add.reduceat(mine, begin)[owner]

        dp = won(high, f[:, :FILTERS]) + mean[owner] / size[owner, None] + won(low, f[:, 2 * FILTERS :])
        rows = np.arange(len(x))[:, None]
        cell = [np.bincount(((x[rows, at * STRIDE + k].astype(np.int64)) * FILTERS + np.arange(FILTERS)).ravel(), dp.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in range(WIDTH)]
        return loss, {"table": np.stack(cell).astype(np.float32), "w1": f.T @ dh, "b1": dh.sum(0), "w2": h.T @ dz, "b2": dz.sum(keepdims=True)}

    def fit(self, sets: list[bytes], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.004, seed: int = 11, batch: int = 48) -> ByteCnn:
        """sets: each text's bytes; y: 0 or 1. Adam on the log loss."""
        r = np.random.default_rng(seed)
        m = {n: np.zeros_like(getattr(self, n)) for n in ("table", "w1", "b1", "w2", "b2")}
        v = {n: np.zeros_like(x) for n, x in m.items()}
        epochs = max(epochs, -(-STEPS * batch // len(sets)))
        step, total = 0, epochs * -(-len(sets) // batch)
        for _ in range(epochs):
            order = r.permutation(len(sets))
            for i in range(0, len(sets), batch):
                pick = order[i : i + batch]
                _, grad = self.gradient([sets[j] for j in pick], y[pick])
                step += 1
                speed = rate * min(1, step / 20) * (1 - step / (total + 1)) ** 0.5
                for n, g in grad.items():
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.99 * v[n] + 0.01 * g * g
                    value = getattr(self, n)
                    value -= (speed * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def scores(self, values: list[str], at_once: int = 128) -> np.ndarray:
        """Probability of label 1 of each text; long texts are pooled part by part, so memory does not grow with them."""
        found = []
        block: list[np.ndarray] = []
        pooled: list[np.ndarray] = []
        begin, held, total = [], 0, 0

        def flush() -> None:
            nonlocal block, held
            if block:
                pooled.append(self.pool(np.concatenate(block))[0])
                block, held = [], 0

        for text in values:
            c = chunks(utf8(text))
            begin.append(total)
            total += len(c)
            for i in range(0, len(c), at_once):
                block.append(c[i : i + at_once])
                held += len(block[-1])
                if held >= at_once:
                    flush()
        flush()
        if not begin:
            return np.zeros(0)
        found = self.logit(self.combine(np.concatenate(pooled), np.array(begin)))
        return 1 / (1 + np.exp(-np.clip(found.astype(np.float64), -500, 500)))


class Constant:
    """Stands in where the labels that may be learned from are all alike."""

    def __init__(self, value: float):
        self.value = value

    def scores(self, values: list[str]) -> np.ndarray:
        return np.full(len(values), self.value)


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int = ROWS) -> tuple[DataFrame, dict[int, int]]:
    """Labelled texts to learn from: doc_id, text, y; at most `rows` of each label, those with the least hash of doc_id. Also
    how many rows of each label there are. Ids whose rows of labels differ are left out, as are null ids and labels; of texts that
    share an id, the one of least hash is learned, found by partial aggregation, so that copies stay where they are."""
    clean = labels.where(f"doc_id IS NOT NULL AND {label} IN (0, 1)").where(crc_mod("doc_id", folds) != held)
    clean = clean.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top")).where("y = top").select("doc_id", F.col("y").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in clean.groupBy("y").count().collect()}
    least = lambda y: clean.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = least(0).unionByName(least(1))
    labelled = texts(docs).join(F.broadcast(ids), "doc_id")  # at most 2 * rows ids
    return labelled.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), counts


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, rows: int = ROWS) -> ByteCnn | Constant:
    """A network fitted on rows of `labels` whose crc32(doc_id as text) mod folds is not held."""
    labelled, counts = sample(docs, labels, label, folds, held, rows)
    got = sorted((r["doc_id"], r["y"], utf8(r["text"])) for r in labelled.select("doc_id", "y", "text").collect())
    y = np.array([r[1] for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        return Constant((counts.get(1, 0) + 1) / (sum(counts.values()) + 2))
    model = ByteCnn().fit([r[2] for r in got], y)
    model.shift = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))  # back to the labels' shares
    return model


def score_texts(docs: DataFrame, model) -> DataFrame:
    """doc_id, score of every text; model has scores(texts)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(ids: list, values: list[str]) -> dict[str, list]:
        return {"doc_id": ids, "score": shared.value.scores(values).tolist()}

    return map_texts(texts(docs), columns("doc_id long,score double"), work, bytes_a_batch=1 << 20)
