"""Toxicity: a word classifier with counterfactual regularisation.

A text's features are its distinct words and their beginnings of four and five letters. The classifier is a logistic regression
whose loss has, besides the log loss, a penalty on score changes between a labelled text and its counterfactuals: the text with
an identity term swapped for another one of the same kind, and, since neutral mentions may be rare among the labelled rows,
labelled texts with a neutral mention put in. A pair changes what the rewritten text's features change: a beginning that another word
of the text still has does not go. Swaps and mentions are two means of equal weight, over all pairs of the sample, so that many of one
kind do not outweigh the other. So the mention of a group alone does not move a score. Every feature enters whose share of label 1 is
further from the whole sample's than chance explains; the identity terms always enter, so that the penalty can hold them down.

The model is fitted on the driver from at most `rows` labelled texts of each label (ROWS); that is the only sample taken. Texts of the
same words are one row of weight 1, labelled by their mean, so copies count as one text, and no row is left out. Scores look at every
word of every text. Null texts are empty; an empty text gets the score that no word moves. Of texts that share a labelled id one is
learned.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.byte_cnn import Constant, sample
from millrace.llm.common import columns

#: The penalty's weight is a common one for all terms' mentions, of which each is one part in some hundred.
ROWS, SQUARE, SWAP = 2000, 0.00003, 5.0
#: Groups of people, by kind; terms of one kind are swapped for each other. English, French, German and Spanish.
IDENTITIES: dict[str, str] = {
    "gender": "woman women man men girl girls boy boys female male femme femmes homme hommes frau frauen mann männer mujer mujeres hombre hombres",
    "orientation": "gay lesbian straight bisexual queer heterosexual transgender trans homosexuel lesbienne schwul lesbisch homosexual lesbiana",
    "religion": "muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists atheist atheists catholic sikh musulman chrétien juif juive muslimisch christlich jüdisch musulmán cristiano judío",
    "origin": "african african-american asian european american mexican chinese indian arab black white latino immigrant immigrants refugee refugees africain asiatique européen arabe noir noire blanc étranger afrikaner asiatisch europäer araber schwarz weiß ausländer africano asiático europeo negro negra blanco inmigrante",
    "body": "deaf blind disabled old young elderly autistic sourd aveugle handicapé taub blind behindert sordo ciego discapacitado",
}
#: A neutral mention.
MENTION = ("the", "{}", "people", "here")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


class Toxicity:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[str, ...]] = {}

    def scores(self, values: list[str]) -> np.ndarray:
        z, known = np.full(len(values), self.bias), self.known
        if len(known) > 100_000:  # what is remembered only saves time
            known.clear()
        for i, t in enumerate(values):
            found: set[str] = set()
            for w in words(t):
                if (f := known.get(w)) is None:
                    f = known[w] = tuple(x for x in features(w) if x in self.weights)
                if f:
                    found.update(f)
            z[i] += sum(self.weights[x] for x in sorted(found))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Rows:
    """Sparse rows of features and bias: what is not 0 of each."""

    def __init__(self, rows: list[dict[int, float]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)
        self.value = np.array([v for r in rows for v in r.values()], float)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * v[self.row], self.width)

    def squares(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value**2 * v[self.row], self.width)


def _minimise(x: Rows, y: np.ndarray, moved: list[Rows], square: float, swap: float, rounds: int = 100) -> np.ndarray:
    """Newton's method, its steps by conjugate gradients, on the mean log loss, plus square * |w|^2, plus swap * the mean square of the
    score changes of each list of counterfactual pairs. The last weight is the bias, which no penalty holds."""
    hold = np.append(np.full(x.width - 1, 2 * square), 1e-9)
    one = [np.full(m.n, 2 * swap / m.n) for m in moved]

    def fixed(w: np.ndarray) -> np.ndarray:
        return hold * w + sum((m.back(k * m.dot(w)) for m, k in zip(moved, one, strict=True)), np.zeros(x.width))

    def loss(w: np.ndarray) -> float:
        z = x.dot(w)
        return float((np.logaddexp(0, z) - y * z).mean() + w @ fixed(w) / 2)

    w = np.zeros(x.width)
    held = hold + sum((m.squares(k) for m, k in zip(moved, one, strict=True)), np.zeros(x.width))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w), -500, 500)))
        g = x.back((p - y) / len(y)) + fixed(w)
        curve = p * (1 - p) / len(y)
        scale = 1 / (held + x.squares(curve))
        step, left = np.zeros(x.width), g.copy()
        way = scale * left
        size = left @ way
        if size < 1e-10:
            break
        goal = size * 1e-6
        for _ in range(500):
            along = x.back(curve * x.dot(way)) + fixed(way)
            a = size / (way @ along)
            step += a * way
            left -= a * along
            was, size = size, left @ (scale * left)
            if size < goal:
                break
            way = scale * left + size / was * way
        length, now = 1.0, loss(w)
        while loss(w - length * step) > now - 1e-4 * length * (g @ step) and length > 1e-4:
            length /= 2
        w = w - length * step
    return w


def swaps(sets: list[set[str]]) -> Iterator[tuple[set[str], set[str]]]:
    """Pairs of word sets that should score alike: each text, and it with an identity term turned into another of its kind, for each
    of its terms; and each term, alone, and the next."""
    kinds = {k: v.split() for k, v in IDENTITIES.items()}
    kind_of = {t: k for k, terms in kinds.items() for t in terms}
    for i, s in enumerate(sets):
        for term in sorted(s & kind_of.keys()):
            terms = kinds[kind_of[term]]
            other = terms[(terms.index(term) + 1 + i % (len(terms) - 1)) % len(terms)]
            yield s, s - {term} | {other}
    every = sorted(kind_of)
    for i, term in enumerate(every):
        yield {term}, {every[(i + 1) % len(every)]}


def mentions(sets: list[set[str]]) -> Iterator[tuple[set[str], set[str]]]:
    """The same for each text and it with a term put in, and for each term's neutral mention and nothing."""
    every = sorted(t for v in IDENTITIES.values() for t in v.split())
    for i, s in enumerate(sorted((s for s in sets if s), key=lambda s: (len(s), sorted(s)))):
        yield s, s | {every[i % len(every)]}
    for term in every:
        yield set(), {w.format(term) for w in MENTION}


def one_each(sets: list[set[str]], y: np.ndarray) -> tuple[list[set[str]], np.ndarray]:
    """Different sets, with the mean of their labels: copies would count as evidence many times."""
    found: dict[frozenset[str], list[float]] = {}
    for s, label in zip(sets, y, strict=True):
        found.setdefault(frozenset(s), []).append(float(label))
    return [set(s) for s in found], np.array([sum(v) / len(v) for v in found.values()])


def fit(sets: list[set[str]], y: np.ndarray, least_texts: int = 4, chance: float = 4.5, swap: float = SWAP, square: float = SQUARE) -> Toxicity:
    """A classifier for word sets with labels 0 or 1. chance: how many standard deviations a feature's count of label 1 has to
    be from what the sample's share of it leads one to expect, in least_texts texts or more; swap: the penalty's weight."""
    sets, y = one_each(sets, y)
    known: dict[str, list[str]] = {}  # each word's features are made and held once

    def expand(s: Iterable[str]) -> set[str]:
        return {f for w in s for f in (known.get(w) or known.setdefault(w, features(w)))}

    seen: dict[str, list[float]] = {}
    for s, label in zip(sets, y, strict=True):
        for f in expand(s):
            e = seen.setdefault(f, [0, 0.0])
            e[0] += 1
            e[1] += label
    share = float(y.mean())
    standing = {f for f, (n, ones) in seen.items() if n >= least_texts and 0 < share < 1 and abs(ones - n * share) >= chance * (share * (1 - share) * n) ** 0.5}
    at = {f: i for i, f in enumerate(sorted(standing.union(*(v.split() for v in IDENTITIES.values()))))}
    width = len(at) + 1

    def changes(pairs: Iterator[tuple[set[str], set[str]]]) -> Rows:
        """Features that the first of a pair has and the second one has not, as 1, and the other way round, as -1."""
        rows = []
        for a, b in pairs:
            gone, come = expand(a - b), expand(b - a)  # all other features are those of words of both
            both = expand(w for w in a & b if any(f in gone or f in come for f in features(w)))
            row = {at[f]: 1.0 for f in gone - both - come if f in at} | {at[f]: -1.0 for f in come - both - gone if f in at}
            if row:
                rows.append(row)
        return Rows(rows, width)

    x = Rows([{at[f]: 1.0 for f in expand(s) if f in at} | {width - 1: 1.0} for s in sets], width)
    w = _minimise(x, y, [m for m in (changes(swaps(sets)), changes(mentions(sets))) if m.n], square, swap)
    return Toxicity({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-6}, float(w[-1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, rows: int = ROWS) -> Toxicity | Constant:
    """A classifier fitted on rows of `labels` whose crc32(doc_id as text) mod folds is not held."""
    labelled, counts = sample(docs, labels, label, folds, held, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(sorted(words(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.string())], ["doc_id", "y", "words"])

    got = sorted({tuple(r) for r in labelled.mapInArrow(run, columns("doc_id long,y int,words string")).collect()})
    y = np.array([r[1] for r in got], float)
    if len(set(y.tolist())) < 2:
        return Constant((counts.get(1, 0) + 1) / (sum(counts.values()) + 2))
    model = fit([{sys.intern(w) for w in r[2].split()} for r in got], y)
    model.bias += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))  # back to the labels' shares
    return model
