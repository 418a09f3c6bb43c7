"""Best-fit packing by length patterns and non-negative least squares.

Documents become pieces of at most `capacity` tokens (only longer documents are cut). The histogram of piece lengths has at
most `capacity` bars, whatever the input's size; the driver fits how often each pattern of one, two or three lengths that fill
a sequence is used (non-negative least squares, an accelerated projected gradient over sparse patterns; of all patterns of three lengths
those are enumerated that the fit lacks most, round by round, until it stands still), rounds the counts to what the histogram holds, and packs the residual lengths best-fit, longest first, over counts of lengths and never over single
pieces. The plan maps the n-th piece of a length to a sequence and an offset; pieces get their number from a count for each
task and length, so no piece passes through the driver and no group through one task.

Null texts count as empty ones, which hold the end id alone. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.common import arrow_rows, columns, slices, texts, written
from millrace.llm.word_tokens import word_ids

#: Shares of the fitted repeat counts that are tried.
SHARES = (1.0, 0.95, 0.8, 0.5)
PIECES = columns("doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece; task and nth number the pieces of each length within the task that made them.

    The rows have to be written before they are used twice: another run can number them otherwise.
    """
    arrow = to_arrow_schema(PIECES)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, encoder = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), word_ids(tokenizer)
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for a, b in slices(column, 4 << 20):
                rows: dict[str, list] = {f.name: [] for f in arrow}
                for doc, packed in zip(ids[a:b].to_pylist(), encoder.pack(column[a:b].to_pylist()), strict=True):
                    packed += end
                    for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                        part = packed[at : at + 4 * capacity]
                        n = len(part) // 4
                        for name, value in zip(rows, (doc, k, at // 4, n, zlib.crc32(part), task, int(seen[n])), strict=True):
                            rows[name].append(value)
                        seen[n] += 1
                yield arrow_rows(rows, arrow)

    return texts(docs).mapInArrow(run, PIECES)


def pairs(capacity: int) -> np.ndarray:
    """All patterns [a, b] that fill a sequence."""
    a = np.arange(1, capacity // 2 + 1)
    return np.stack([a, capacity - a], 1)


def priced(miss: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length the pattern [a, b, c] with it that fills a sequence and of which the histogram lacks most, and how much that
    is: of all patterns, those that bring the fit nearer."""
    best, worth = [], []
    for a in range(1, capacity - 1):
        rest = capacity - a
        both = miss[1 : rest // 2 + 1] + miss[rest - rest // 2 : rest][::-1]
        b = int(both.argmax()) + 1
        best.append(sorted((a, b, rest - b)))
        worth.append(miss[a] + both[b - 1])
    return np.array(best, np.int64).reshape(-1, 3), np.array(worth)


def fit(counts: np.ndarray, forms: list[np.ndarray], rounds: int = 2000, still: float = 1e-4) -> list[np.ndarray]:
    """Repeat counts x >= 0 of each pattern that bring the patterns' lengths near the histogram: min |A x - counts|^2. Ends when 20
    rounds have not made the miss smaller by a share of `still`, or after `rounds`."""
    n = len(counts)
    times = lambda xs: sum((np.bincount(f.ravel(), np.repeat(x, f.shape[1]), n) for f, x in zip(forms, xs, strict=True)), np.zeros(n))
    back = lambda r: [r[f].sum(1) for f in forms]
    probe = [np.ones(len(f)) for f in forms]
    scale = 1.0
    for _ in range(12):  # the largest eigenvalue of A'A, for the step
        y = back(times(probe))
        scale = max(float(np.sqrt(sum((v * v).sum() for v in y))), 1e-9)
        probe = [v / scale for v in y]
    x = [np.zeros(len(f)) for f in forms]
    z, t, least = x, 1.0, np.inf
    for turn in range(rounds):
        miss = times(z) - counts
        if turn % 20 == 0:
            now = float(miss @ miss)
            if now >= least * (1 - still):
                break
            least = now
        g = back(miss)
        new = [np.maximum(0, v - d / scale) for v, d in zip(z, g, strict=True)]
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = [v + (t - 1) / u * (v - w) for v, w in zip(new, x, strict=True)]
        x, t = new, u
    return x


def fit_by_need(counts: np.ndarray, capacity: int, rounds: int = 40, still: float = 0.01) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Patterns of two and three lengths with their repeat counts. Of the patterns of three, those enter that the fit lacks most, one
    for each length in a round, and those that the fit does not use leave again; so few are held, and each gets many repeats. Ends when
    no pattern is lacking or five rounds have not made the miss smaller by a share of `still`."""
    forms, least, since = [pairs(capacity), np.empty((0, 3), np.int64)], np.inf, 0
    best: tuple[list[np.ndarray], list[np.ndarray]] = (forms, [np.zeros(len(f)) for f in forms])
    for _ in range(rounds):
        xs = fit(counts, forms)
        miss = counts - sum(np.bincount(f.ravel(), np.repeat(x, f.shape[1]), capacity + 1) for f, x in zip(forms, xs, strict=True))
        now = float(miss @ miss)
        since = 0 if now < least * (1 - still) else since + 1
        if since == 5:
            break
        if now < least:
            least, best = now, (forms, xs)
        found, worth = priced(miss, capacity)
        new = found[worth > 1e-6 * max(counts.max(), 1.0)]
        if not len(new):
            break
        used = forms[1][xs[1] > 1e-9]
        forms = [forms[0], np.unique(np.concatenate([used, new]), axis=0)]
    return best


def pack_counts(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how many sequences use each; every counted length is placed. Some shares of the fitted
    counts are tried, as what is left to the residual must be able to fill up, too; the plan of fewest sequences counts."""
    left, whole = counts.astype(np.int64).copy(), []
    if left[capacity]:
        whole.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    forms, xs = fit_by_need(left.astype(float), capacity)
    plans = (_rounded(left, forms, [x * share for x in xs], capacity) for share in SHARES)
    return whole + min(plans, key=lambda plan: sum(n for _, n in plan))


def _rounded(counts: np.ndarray, forms: list[np.ndarray], xs: list[np.ndarray], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns by their counts, rounded down and held to what there is; the rest best-fit."""
    left, plan = counts.copy(), []
    for form, x in zip(forms, xs, strict=True):
        for i in np.argsort(-x, kind="stable"):
            want = int(x[i])  # what a fit leaves goes to the residual
            if not want:
                break
            need = np.bincount(form[i])
            at = np.flatnonzero(need)
            if n := int(min(want, (left[at] // need[at]).min())):
                left[at] -= need[at] * n
                plan.append((tuple(sorted(form[i].tolist(), reverse=True)), n))
    return plan + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal open sequences are one entry, split only where a length fills part of them."""
    open_by: dict[int, list[list]] = {}  # room left -> [lengths, how many]
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        room = capacity - sum(lengths)
        if not room:
            done.append((lengths, n))
        elif room in open_by:
            open_by[room].append([lengths, n])
        else:
            open_by[room] = [[lengths, n]]
            bisect.insort(rooms, room)

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            entry = open_by[room := rooms[i]][-1]
            each = min(room // length, n)
            used = min(entry[1], n // each)
            entry[1] -= used
            if not entry[1]:
                open_by[room].pop()
                if not open_by[room]:
                    del open_by[room]
                    rooms.pop(i)
            put(entry[0] + (length,) * each, used)
            n -= used * each
    return done + [(tuple(x), n) for entries in open_by.values() for x, n in entries]


def runs(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length: rows (first number of a run, its first sequence, offset); the n-th piece of a length is in one run."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    nth, base = np.zeros(capacity + 1, np.int64), 0
    for lengths, n in plan:
        offset = 0
        for x in lengths:
            found.setdefault(x, []).append((int(nth[x]), base, offset))
            nth[x] += n
            offset += x
        base += n
    return {k: np.array(v, np.int64) for k, v in found.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text)."""
    made = written(pieces(docs, tokenizer, capacity, end_id))
    by_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    plan = docs.sparkSession.sparkContext.broadcast(runs(pack_counts(counts, capacity), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = made.join(base, ["task", "length"]).withColumn("nth", F.col("nth") + F.col("base"))
    schema = columns("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    arrow = to_arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for x in np.unique(length):
                at, run = np.flatnonzero(length == x), plan.value[int(x)]
                k = np.searchsorted(run[:, 0], nth[at], "right") - 1
                sequence[at], offset[at] = run[k, 1] + nth[at] - run[k, 0], run[k, 2]
            kept = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema=arrow)

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "nth").mapInArrow(place, schema)
