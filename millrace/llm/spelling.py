"""Spelling variants: words within one edit of each other, found by forward and backward minimal acyclic automata.

Words are counted by chunks of text before any shuffle. Two words are near if they differ by one inserted, deleted or replaced code
point. Cut a word in two halves: the one edit leaves one half as it is. So with the first half matched exactly by a forward automaton
the second one is completed with one error, and with the second half matched exactly by a backward one, the first is. The automata
are minimal and count the words behind each state, so the way through one gives a word's number, and numbers give counts of words.
What both directions would find is left to the forward one: a backward match that shares the word's first half is left out.

Words meet by the half that is matched: a word stands in the dictionaries of each half that a near word may have (two lengths in each
direction) and asks in that of its own half. Groups of one half are put together on shelves of some SHELF words, with one automaton
each; a group of more words is dealt to several shelves, and its questions go to each of them. So no group is held whole, whatever its
size, and only matches are put out, one row a word and shelf.

Null texts have no words; a null doc_id is hashed as "null". Rows that repeat an id are counted each. Other columns are left behind.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.common import columns, texts, written

LEAST_LENGTH, LEAST_COUNT, TIMES, ODDS, SHELF, HELD = 6, 5, 5, 199, 20_000, 300_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Texts of more characters are gone through run by run; others at once.
LONG = 8 << 20
FOUND = columns("word string,n_near long,near string,near_n long")


def noisy(run: str, doc_id: str, odds: int) -> str:
    """The run, or without one code point where a hash of it and the document's id says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % odds:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, odds: int = ODDS) -> DataFrame:
    """word, n: the words of docs (doc_id, text) that are long and frequent enough."""
    schema = columns("word string,n long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=arrow)

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                value, name = text.as_py(), "null" if i is None else str(i)
                own = Counter(_RUN.findall(value) if len(value) < LONG else (m.group() for m in _RUN.finditer(value)))
                for word, n in own.items():
                    word = word.lower() if word.isascii() else word.translate(_LOWER)
                    if len(word) >= least_length and len(word := noisy(word, name, odds)) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        yield rows()

    return texts(docs).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """A minimal acyclic automaton of sorted words, with the number of words behind each state. A state is a list of its letters'
    ends, whether a word ends there, and the number of words that pass before each letter."""

    def __init__(self, words: list[str]):
        self.letters: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]  # the states of the last word, which may still grow
        last = ""

        def frozen(state: tuple[dict[str, int], list[bool]]) -> int:
            letters, (final,) = state
            sign = (final, tuple(letters.items()))
            if (number := known.get(sign)) is None:
                number = known[sign] = len(self.letters)
                self.letters.append(letters)
                self.final.append(final)
                self.size.append(final + sum(self.size[s] for s in letters.values()))
            return number

        def close(depth: int) -> None:
            for i in range(len(path) - 1, depth, -1):
                path[i - 1][0][last[i - 1]] = frozen(path[i])
            del path[depth + 1 :]

        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close(common)
            path.extend(({}, [False]) for _ in word[common:])
            path[-1][1][0] = True
            last = word
        close(0)
        self.start = frozen(path[0])
        # the number of words before those that go on by a letter: perfect-hash numbers are sums of these
        self.before: list[dict[str, int]] = []
        for letters, final in zip(self.letters, self.final, strict=True):
            n, before = int(final), {}
            for c, s in letters.items():
                before[c] = n
                n += self.size[s]
            self.before.append(before)

    def walk(self, text: str, state: int, number: int = 0) -> tuple[int, int] | None:
        """The state after a text, and the number of words before the first one there; null if no word goes that way."""
        for c in text:
            if c not in self.letters[state]:
                return None
            number += self.before[state][c]
            state = self.letters[state][c]
        return state, number

    def _ends(self, text: str, state: int, number: int) -> int | None:
        at = self.walk(text, state, number)
        return at[1] if at and self.final[at[0]] else None

    def one_error(self, exact: str, rest: str) -> set[int]:
        """The numbers of the words that begin with `exact` and go on with what is one edit from `rest`."""
        out: set[int | None] = set()
        if (at := self.walk(exact, self.start)) is None:
            return set()
        state, number = at
        for i in range(len(rest) + 1):
            letters, before = self.letters[state], self.before[state]
            for c, s in letters.items():
                there = number + before[c]
                out.add(self._ends(rest[i:], s, there))  # inserted
                if i < len(rest) and c != rest[i]:
                    out.add(self._ends(rest[i + 1 :], s, there))  # replaced
            if i == len(rest):
                break
            out.add(self._ends(rest[i + 1 :], state, number))  # deleted
            if rest[i] not in letters:
                break
            state, number = letters[rest[i]], number + before[rest[i]]
        out.discard(None)
        return out


def _placed(words: DataFrame) -> DataFrame:
    """back, half, text, n, asks: a row for each dictionary that a word stands in; text is reversed for the backward ones."""
    sides = []
    for back in (False, True):
        text, length = F.reverse("word") if back else F.col("word"), F.length("word")
        half = lambda n, back=back: (F.ceil(n / 2) if back else F.floor(n / 2)).cast("int")
        for k in (-1, 0, 1):  # near words are longer or shorter by one at most
            sides.append(F.struct(F.lit(back).alias("back"), F.left(text, half(length + k)).alias("half"), text.alias("text"), (half(length + k) == half(length)).alias("asks")))
    return words.select("n", F.explode(F.array_distinct(F.array(*sides))).alias("s")).select("s.*", "n")


class Shelf:
    """Some groups' words and questions of one direction, or a part of one large group's words with all of its questions."""

    def __init__(self, back: bool):
        self.back, self.words, self.asked = back, {}, []
        self.automaton: Automaton | None = None

    def answers(self) -> Iterator[tuple[str, int, str, int]]:
        """A row for each question that has near words here: word, how many, the best one and its n."""
        asked, self.asked = self.asked, []
        if not self.words or not asked:
            return
        if self.automaton is None:
            self.sorted = sorted(self.words)
            self.automaton = Automaton(self.sorted)
        turn = (lambda t: t[::-1]) if self.back else (lambda t: t)
        for text, cut in asked:
            word, found = turn(text), []
            for i in self.automaton.one_error(text[:cut], text[cut:]):
                near = turn(self.sorted[i])
                if not self.back or near[: len(text) - cut] != word[: len(text) - cut]:  # else the forward automata find it
                    found.append((near, self.words[self.sorted[i]]))
            if found:
                near, n = min(found, key=lambda x: (-x[1], x[0]))
                yield word, len(found), near, n


def near_words(words: DataFrame, shelf: int = SHELF) -> DataFrame:
    """word, n_near, near, near_n of the words (word, n; each once) that have near ones: how many, and the most frequent of them
    (ties: the first in code-point order)."""
    arrow = to_arrow_schema(FOUND)
    placed = written(_placed(words))
    by, key = ["back", "half"], ["back", "half", "shelf"]
    # a large group's words are dealt to shelves, and its questions asked on each of them
    sizes = placed.groupBy(*by).agg(F.count("*").alias("size")).where(F.col("size") > shelf).select(*by, F.ceil(F.col("size") / shelf).cast("int").alias("shelves"))
    shelved = placed.join(sizes, by, "left")
    mine = F.coalesce(F.pmod(F.xxhash64("text"), "shelves"), F.lit(0)).cast("int")
    large = F.col("shelves").isNotNull().alias("large")
    stands = shelved.select(*by, mine.alias("shelf"), large, "text", "n")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("shelves", F.lit(1)) - 1))
    asks = shelved.where("asks").select(*by, every.alias("shelf"), large, "text", F.lit(None).cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now, alone = None, Shelf(False), False
        for batch in batches:
            rows: list[tuple[str, int, str, int]] = []
            for back, half, number, split, text, n in zip(*(batch.column(c).to_pylist() for c in (*key, "large", "text", "n")), strict=True):
                if (back, half, number) != group:
                    group = back, half, number
                    # a large group's shelf holds nothing else, as other groups may hold its words, too, and find them twice
                    if alone or split or back != now.back or len(now.words) >= shelf:
                        rows.extend(now.answers())
                        now = Shelf(back)
                    alone = split
                if n is None:  # questions come after the group's words
                    now.asked.append((text, len(half)))
                    if alone and len(now.asked) >= HELD:
                        rows.extend(now.answers())
                else:
                    now.words[text] = n
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)
        rows = list(now.answers())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    dealt = stands.unionByName(asks).repartition(*key).sortWithinPartitions(*key, F.col("n").isNull(), "text")
    found = dealt.mapInArrow(run, FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form or null), which make no circle: the last word that forms lead to. Each round doubles the way,
    so a chain of k words takes log2(k) rounds, and a form is some times as frequent as its word, so k is small."""
    now = written(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(step, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, odds: int = ODDS, shelf: int = SHELF) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word. A word's form is its most frequent near word, if that is `times` as frequent."""
    words = written(count_words(docs, least_length, least_count, odds))
    near = near_words(words, shelf)
    full = F.col("near_n") >= times * F.col("n")
    out = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(full, F.col("near")).alias("form"), F.when(full, F.col("near_n")).alias("form_n")))
    return out.join(roots(out), "word")
