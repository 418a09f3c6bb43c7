"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding by an incremental UTF-8 machine.

A sequence of tokens is what the merges make of its bytes exactly if each two neighbours are what the merges make of their
joined bytes. So the vocabulary's trie, with an edge back to its root wherever a token ends that may follow the one before,
is a transducer with one accepting path for each input. It is determinised on demand: a state is the set of open paths (trie
node, and the tokens since the paths' common start); a step emits the tokens that all open paths share, so no token waits
longer than the vocabulary's longest one. States are built when an input first needs them and kept in a table of bounded size;
when it is full, in the middle of a match too, it starts anew from the open paths. Work is linear in a match's length.

Decoding runs a UTF-8 machine whose state is the kind of byte that may follow and the character's bits so far; what one token's
bytes do from one state is remembered.

A match of the splitting pattern that is a token as a whole is that token, as the reference implementation has it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from millrace.llm.common import columns, map_texts, texts

#: Steps, pieces and parts that a worker remembers; only speed depends on them.
STEPS, PIECES, PARTS = 500_000, 600_000, 600_000


class Transducer:
    """bytes -> token ids for a rank table {token bytes: rank}."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.together: dict[tuple[int, int], bool] = {}
        # what stands at a token's left and right edge, from its first byte to itself, as its merges happen
        self.left: list[list[int]] = [[] for _ in range(max(ranks.values(), default=0) + 1)]
        self.right: list[list[int]] = [[] for _ in self.left]
        self.in_order = True  # each token is joined from tokens of lower rank
        for word, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self.merged(word, 2)
            if len(parts) == 2 and ranks.get(word) == rank:
                a, b = parts
                self.in_order &= a < rank > b
                self.left[rank], self.right[rank] = [*self.left[a], rank], [*self.right[b], rank]
            elif len(parts) == 1:
                self.left[rank] = self.right[rank] = [rank]
            else:  # no merges lead to it: only a match as a whole can be it
                continue
            node = 0
            for b in word:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.token)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][b]
            self.token[node] = rank
        self.reset()

    def reset(self) -> None:
        """Only the start state: no open path but the empty one. A state's number is a multiple of 256, for the next byte."""
        self.states: list[tuple] = [(((), -1, 0),)]  # open paths: tokens not yet emitted, token before the open one, trie node
        self.number = {self.states[0]: 0}
        self.final = [b""]  # what an input that ends here still emits
        self.steps: dict[int, tuple[int, bytes]] = {}

    def merged(self, piece: bytes, until: int = 1) -> list[int]:
        """The definition: join the neighbours of lowest rank, leftmost first, until none can be joined, or `until` are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Do the merges leave a and b as they are, side by side? Only a merge over their border could change that."""
        if a < 0:
            return True
        if (ok := self.together.get((a, b))) is None:
            if len(self.together) > STEPS:
                self.together.clear()
            ok = self.together[a, b] = self.apart(a, b) if self.in_order else self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def apart(self, a: int, b: int) -> bool:
        """Follow the edges at the border as merges happen in the order of ranks; at equal rank the left one goes first."""
        right, left, i, j, never = self.right[a], self.left[b], 0, 0, 1 << 60
        while True:
            nx, ny = (right[i + 1] if i + 1 < len(right) else never), (left[j + 1] if j + 1 < len(left) else never)
            over = self.ranks.get(self.bytes_of[right[i]] + self.bytes_of[left[j]], never)
            if over < nx and over <= ny and over < never:
                return False
            if nx == ny == never:
                return True
            if nx <= ny:
                i += 1
            else:
                j += 1

    def step(self, at: int) -> tuple[int, bytes]:
        """The next state and the packed ids emitted, for a state's number plus a byte; determinised now."""
        paths, byte, children, token, together = [], at & 255, self.children, self.token, self.together
        for held, last, node in self.states[at >> 8]:
            if (child := children[node].get(byte)) is None:
                continue
            if children[child]:
                paths.append((held, last, child))
            t = token[child]
            if t >= 0 and (last < 0 or (self.follows(last, t) if (ok := together.get((last, t))) is None else ok)):
                paths.append(((*held, t), t, 0))
        out = b""
        if paths and paths[0][0]:  # the oldest path comes first and holds the fewest tokens
            first = paths[0][0]
            shared = len(first)
            for held, _, _ in paths:
                while held[:shared] != first[:shared]:
                    shared -= 1
            if shared:
                out = b"".join([self.packed[t] for t in first[:shared]])
                paths = [(held[shared:], last, node) for held, last, node in paths]
        found = self.steps[at] = self.enter(tuple(paths)), out
        return found

    def enter(self, paths: tuple) -> int:
        """The number of the state of these open paths."""
        if (number := self.number.get(paths)) is None:
            number = self.number[paths] = len(self.states) << 8
            self.states.append(paths)
            self.final.append(next((b"".join([self.packed[t] for t in held]) for held, _, node in paths if not node), b""))
        return number

    def encode(self, piece: bytes) -> bytes:
        """Packed ids (little-endian unsigned 32-bit) of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return self.packed[whole]
        state, out, steps = 0, [], self.steps
        for byte in piece:
            found = steps.get(state + byte)
            if found is None:
                if len(steps) >= STEPS:
                    paths = self.states[state >> 8]
                    self.reset()
                    state, steps = self.enter(paths), self.steps
                found = self.step(state + byte)
            state, ids = found
            if ids:
                out.append(ids)
        out.append(self.final[state >> 8])
        return b"".join(out)


class Encoder:
    """Whole texts, split by the pattern; equal parts of texts are encoded once. spaced: a space between two other characters begins
    a match of the pattern, whatever stands around them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, spaced: bool = False):
        import regex

        self.spaced = spaced
        self.transducer, self.split = Transducer(ranks), regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if (packed := self.pieces.get(piece)) is None:
            packed = self.transducer.encode(piece.encode())
            if len(piece) <= 64:
                if len(self.pieces) > PIECES:
                    self.pieces.clear()
                self.pieces[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed ids. With `spaced` the parts of the text from one space to the next stand alone, and are remembered."""
        if not self.spaced:
            return self._pieces(text)
        first, *rest = text.split(" ")
        known = self.parts
        out = list(map(known.get, rest))
        if None in out:
            if len(known) > PARTS:
                known.clear()
            for i in [i for i, packed in enumerate(out) if packed is None]:
                part = rest[i]
                if not part or part[0].isspace() or part[-1].isspace():  # the pattern looks past such a space
                    return self._pieces(text)
                if (packed := known.get(part)) is None:
                    packed = self._pieces(" " + part)
                    if len(part) <= 64:
                        known[part] = packed
                out[i] = packed
        if first and first[-1].isspace():
            return self._pieces(text)
        return self._pieces(first) + b"".join(out)

    def _pieces(self, text: str) -> bytes:
        return b"".join([self._piece(p) for p in self.split(text)])


#: The machine's states: no open character; one, two or three bytes to follow; the same after leads whose second byte is narrower.
START, ONE, TWO, THREE, E0, ED, F0, F4 = range(8)
#: From START: first and last byte, the state it leads to, and the byte's bits of the character.
LEADS = [(0x00, 0x7F, START, 0x7F), (0xC2, 0xDF, ONE, 0x1F), (0xE0, 0xE0, E0, 0x0F), (0xE1, 0xEC, TWO, 0x0F), (0xED, 0xED, ED, 0x0F), (0xEE, 0xEF, TWO, 0x0F), (0xF0, 0xF0, F0, 0x07), (0xF1, 0xF3, THREE, 0x07), (0xF4, 0xF4, F4, 0x07)]
#: From the others: first and last byte that may follow, and the state it leads to.
TAILS = {ONE: (0x80, 0xBF, START), TWO: (0x80, 0xBF, ONE), THREE: (0x80, 0xBF, TWO), E0: (0xA0, 0xBF, ONE), ED: (0x80, 0x9F, ONE), F0: (0x90, 0xBF, TWO), F4: (0x80, 0x8F, TWO)}
#: What stands for bytes that are no character.
BROKEN = "\ufffd"


def _transitions() -> list[list[tuple[int, int] | None]]:
    """By state and byte: the next state and the byte's bits; None where the byte may not stand."""
    table: list[list[tuple[int, int] | None]] = [[None] * 256 for _ in range(8)]
    for low, high, state, bits in LEADS:
        for byte in range(low, high + 1):
            table[START][byte] = state, byte & bits
    for at, (low, high, state) in TAILS.items():
        for byte in range(low, high + 1):
            table[at][byte] = state, byte & 0x3F
    return table


_STEP = _transitions()


class Utf8:
    """Bytes in any cuts -> text; a character that a cut parts waits for its rest, and what can't be UTF-8 becomes U+FFFD."""

    def __init__(self) -> None:
        self.state, self.bits = START, 0

    @staticmethod
    def run(state: int, bits: int, data: bytes) -> tuple[str, int, int]:
        """The text that data completes, and the state and bits after it."""
        out = []
        for byte in data:
            to = _STEP[state][byte]
            if to is None and state != START:  # the open character is broken off, and the byte begins another one
                out.append(BROKEN)
                state, bits, to = START, 0, _STEP[START][byte]
            if to is None:
                out.append(BROKEN)
                continue
            state, bits = to[0], bits << 6 | to[1]
            if state == START:
                out.append(chr(bits))
                bits = 0
        return "".join(out), state, bits

    def feed(self, data: bytes) -> str:
        text, self.state, self.bits = self.run(self.state, self.bits, data)
        return text

    def close(self) -> str:
        broken, self.state, self.bits = self.state != START, START, 0
        return BROKEN if broken else ""


class Decoder:
    """ids -> text. For each state of the machine, what the tokens met in it do: their text, and the next state's own table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, i in ranks.items():
            self.table[i] = word
        self.forget()

    def forget(self) -> None:
        self.first: dict = {"state": (START, 0)}
        self.known, self.size = {(START, 0): self.first}, 0

    def step(self, at: dict, token: int) -> tuple[str, dict]:
        if self.size >= STEPS:
            self.forget()
            at = self.known.setdefault(at["state"], at)
        text, *state = Utf8.run(*at["state"], self.table[token])
        state = tuple(state)
        found = at[token] = text, self.known.setdefault(state, {"state": state})
        self.size += 1
        return found

    def stream(self, packed: bytes, ids_a_step: int = 4096) -> Iterator[str]:
        """Text as its ids come in."""
        at, step = self.first, self.step
        for i in range(0, len(packed), 4 * ids_a_step):
            out = []
            for token in np.frombuffer(packed[i : i + 4 * ids_a_step], "<u4").tolist():
                text, at = at.get(token) or step(at, token)
                out.append(text)
            yield "".join(out)
        if at["state"][0] != START:
            yield BROKEN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    import public_tokenizers

    ranks = read_ranks(path)
    return Encoder(ranks, pattern, pattern == public_tokenizers.PATTERN), Decoder(ranks)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit). Null and empty texts have no ids."""

    def work(ids: list, values: list[str]) -> dict[str, list]:
        encoder = coder(path, pattern)[0]
        return {"doc_id": ids, "ids": [encoder.encode(t) for t in values]}

    return map_texts(texts(docs), columns("doc_id long,ids binary"), work)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of encode()'s rows."""
    from pyspark.sql import functions as F

    def work(ids: list, values: list[bytes]) -> dict[str, list]:
        decoder = coder(path, pattern)[1]
        return {"doc_id": ids, "text": ["".join(decoder.stream(v)) for v in values]}

    return map_texts(encoded.select("doc_id", F.col("ids").alias("text")), columns("doc_id long,text string"), work)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, without the ids leaving the task."""

    def work(ids: list, values: list[str]) -> dict[str, list]:
        encoder, decoder = coder(path, pattern)
        packed = [encoder.encode(t) for t in values]
        return {
            "doc_id": ids,
            "n_tokens": [len(p) // 4 for p in packed],
            "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
            "decoded_sha256": [_sha(part.encode() for part in decoder.stream(p)) for p in packed],
        }

    return map_texts(texts(docs), columns("doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string"), work)


def _sha(parts: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()
