"""Token counts of whole texts under a unigram vocabulary, by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches in one pass; dynamic programming carries the best score and its
number of pieces to each position, and no path is kept. At equal score the piece that starts first stays, as the tokenizers
have it (a later candidate has to be better); a character without a piece of its own scores the lowest piece's score less 10
and counts as its UTF-8 bytes, each a byte piece.

Spaces become U+2581 and one stands before the text. No piece has that mark behind another character, so a best path never
crosses the place before such a mark, and scores are whole numbers, which add without rounding; so equal parts of texts are
counted once. A vocabulary without these properties is run over whole texts. Null and empty texts have no tokens.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from millrace.llm.common import columns, map_texts, texts

SPACE, PENALTY = "▁", 10.0
#: Parts that a worker remembers; only speed depends on it.
REMEMBERED = 800_000


class Counter:
    def __init__(self, pieces: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - PENALTY
        self.parts = all(re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) for p in pieces) and all(float(s).is_integer() for s in pieces.values())
        self.known: dict[str, tuple[float, int, int]] = {}

    def viterbi(self, text: str) -> tuple[float, int, int]:
        """Best score, its pieces, and how many of its characters have no piece."""
        if not text:
            return 0.0, 0, 0
        n, single, unknown = len(text), self.single, self.unknown
        worst = float("-inf")
        score, count, odd = [0.0] + [worst] * n, [0] * (n + 1), [0] * (n + 1)
        done = 0  # positions up to here are final

        def close(upto: int) -> None:
            """Characters without a piece come last among the candidates of a position, as they start last."""
            nonlocal done
            while done < upto:
                done += 1
                c = text[done - 1]
                if c not in single and score[done - 1] + unknown > score[done]:
                    score[done] = score[done - 1] + unknown
                    count[done] = count[done - 1] + len(c.encode("utf-8", "surrogatepass"))
                    odd[done] = odd[done - 1] + 1

        for last, (length, worth) in self.automaton.iter(text) if single or len(self.automaton) else ():  # longest first at each end
            if last > done:
                close(last)
            start, end = last + 1 - length, last + 1
            if (s := score[start] + worth) > score[end]:
                score[end], count[end], odd[end] = s, count[start] + 1, odd[start]
        close(n)
        return score[n], count[n], odd[n]

    def count(self, text: str) -> tuple[float, int, int]:
        if not text:
            return 0.0, 0, 0
        if not self.parts:
            return self.viterbi(SPACE + text.replace(" ", SPACE))
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        total, pieces, odd = 0.0, 0, 0
        words = text.split(" ")
        try:
            if SPACE in text or "" in words:
                raise KeyError
            found = [known[w] for w in words]
        except KeyError:
            found = []
            for part in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + SPACE.join(words)):
                key = part[1:]
                if (got := known.get(key)) is None:
                    got = self.viterbi(part)
                    if len(part) <= 64:
                        known[key] = got
                found.append(got)
        for a, b, c in found:
            total += a
            pieces += b
            odd += c
        return total, pieces, odd


def read_pieces(path: str) -> dict[str, float]:
    """Ordinary pieces of a model file and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read_pieces(path))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_unknown (characters counted by their bytes), score of each text of docs."""

    def work(ids: list, values: list[str]) -> dict[str, list]:
        count = counter(path).count
        rows = [count(t) for t in values]
        return {"doc_id": ids, "n_tokens": [r[1] for r in rows], "n_unknown": [r[2] for r in rows], "score": [r[0] for r in rows]}

    return map_texts(texts(docs), columns("doc_id long,n_tokens long,n_unknown long,score double"), work)
