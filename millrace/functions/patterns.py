"""Sets of patterns: what each match of a pattern has to hold is derived from the pattern, found in one pass, and only patterns whose
needs a text meets are looked for.

Needs are clauses of atoms: of each clause a text that has a match holds one atom at least. An atom is a piece of text in lower case
(with the words' edges that it has to have), or a number of digits in a row (DIGITS followed by it). They only ever rule patterns out, so results are those of the bare patterns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_
from re import _constants as K
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Begins an atom that is a number of digits; no text atom begins with it.
DIGITS = "\0"
#: Stands before and behind each atom that was found; in no atom.
MARK = "\1"
#: In an atom, a word's edge.
EDGE = "\2"
#: Letters from rare to frequent ones in texts of Latin letters; digits and signs count as rarer still.
RARE = "zqjxkvbywgpfmculdhrsinoate"
MOST_TEXTS, MOST_CLAUSES = 24, 2
Clause = frozenset[str]


def _crossed(a: set[str], b: Iterable[str]) -> set[str] | None:
    out = {x + y for x in a for y in b}
    return out if len(out) <= MOST_TEXTS else None


def _least(texts: Iterable[str]) -> Clause:
    """Without texts that hold another one of them."""
    return frozenset(t for t in texts if not any(o != t and o in t for o in texts))


def _bare(atom: str) -> str:
    return atom.replace(EDGE, "")


def _useful(clause: Clause) -> bool:
    """Single letters and digits are in nearly every text."""
    enough = lambda x: len(x) > 1 or (len(x) == 1 and not x.isalnum() and not x.isspace())
    return bool(clause) and all(a.startswith(DIGITS) or enough(_bare(a)) for a in clause)


def _weight(clause: Clause) -> float:
    return min((1 + int(a[1:])) / 2 if a.startswith(DIGITS) else len(_bare(a)) for a in clause) - len(clause) / 100


def _letter(code: int) -> set[str] | None:
    return {chr(code).lower()} if code < 128 else None


def _is_digit(part: tuple) -> bool:
    return part[0] is K.IN and list(part[1]) in ([(K.CATEGORY, K.CATEGORY_DIGIT)], [(K.RANGE, (48, 57))])


def _texts(part: tuple) -> set[str] | None:
    """All texts that a part of a pattern can match, in lower case; null if they are many or unknown."""
    kind, value = part
    if kind is K.LITERAL:
        return _letter(value)
    if kind in (K.AT, K.ASSERT, K.ASSERT_NOT):  # of no width
        return {EDGE if value is K.AT_BOUNDARY else ""}
    if kind is K.IN:
        found = [_letter(v) if k is K.LITERAL else None for k, v in value]
        return None if None in found or len(found) > 6 else set().union(*found)
    if kind is K.SUBPATTERN:
        return _sequence_texts(value[3])
    if kind is K.BRANCH:
        found = [_sequence_texts(x) for x in value[1]]
        return None if None in found or sum(map(len, found)) > MOST_TEXTS else set().union(*found)
    if kind in (K.MAX_REPEAT, K.MIN_REPEAT) and value[1] <= 2:
        one = _sequence_texts(value[2])
        every = [_crossed(x, one) for x in ({""}, one)][: value[1]] if one is not None else [None]
        if None in every:
            return None
        return set().union(*([{""}] if value[0] == 0 else []), *(every[n - 1] for n in range(max(value[0], 1), value[1] + 1)))
    return None


def _sequence_texts(parts: Iterable[tuple]) -> set[str] | None:
    out: set[str] | None = {""}
    for part in parts:
        found = _texts(part)
        if found is None or (out := _crossed(out, found)) is None:
            return None
    return out


def _clauses(parts: Iterable[tuple]) -> list[Clause]:
    """Clauses of parts that follow each other."""
    out: list[Clause] = []
    run: set[str] = {""}

    def close() -> None:
        nonlocal run
        out.append(_least(run))
        run = {""}

    for part in parts:
        found = _texts(part)
        if found is not None and (longer := _crossed(run, found)) is not None:
            run = longer
            continue
        kind, value = part
        if found is not None:  # too many together: they begin a run of their own
            close()
            run = found
            continue
        close()
        if _is_digit(part):
            out.append(frozenset({f"{DIGITS}1"}))
        elif kind is K.SUBPATTERN:
            out += _clauses(value[3])
        elif kind is K.BRANCH:
            every = [[c for c in _clauses(x) if _useful(c)] for x in value[1]]
            if all(every):  # one of the branches is there, so one atom of their best clauses is
                out.append(frozenset().union(*(max(c, key=_weight) for c in every)))
        elif kind in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] >= 1:
            inner = list(value[2])
            if len(inner) == 1 and _is_digit(inner[0]):
                out.append(frozenset({f"{DIGITS}{value[0]}"}))
            else:
                out += _clauses(inner)
    close()
    return out


def needs(pattern: str) -> list[Clause]:
    """The clauses that each match of a pattern meets, whatever its case, the rarest first; none if nothing is known."""
    found = {c for c in _clauses(_parser.parse(pattern)) if _useful(c)}
    return sorted(found, key=lambda c: (-_weight(c), sorted(c)))[:MOST_CLAUSES]


def _rarity(letter: str) -> int:
    return RARE.find(letter)


def _rarest(atom: str) -> str:
    return min(_bare(atom), key=_rarity)


def _pattern(atom: str) -> str:
    return "".join(r"\b" if x == EDGE else re.escape(x) for x in atom)


def _places(atoms: Iterable[str], rare: set[str]) -> dict[str, int]:
    """For each atom the place that it is looked for by: of a rare character, and one from where on it reads like no other atom, if
    there is one."""
    options = {a: sorted((i for i, x in enumerate(a) if x in rare), key=lambda i: _rarity(a[i])) for a in atoms}
    out: dict[str, int] = {}
    for a in sorted(atoms, key=lambda a: (len(options[a]), a)):
        taken = {_bare(b[k:]) for b, k in out.items()}
        out[a] = next((k for k in options[a] if _bare(a[k:]) not in taken), options[a][0])
    return out


def finder(atoms: Iterable[str], rare: set[str]) -> tuple[str, dict[str, list[str]]]:
    """One pattern for all atoms, in any case, that looks closer only at rare characters, of which each atom has one, and uses no text
    up, so atoms may overlap. Group 1: what the longest atom of a place has from there on. And for each atom what group 1 may be, in
    lower case, where the atom is: its own, or that of a longer one that can be there as well."""
    places = _places(atoms, rare)
    ways: dict[str, list[str]] = {}
    said: dict[str, list[str]] = {}
    halves = lambda a: (_bare(a[: places[a]]), _bare(a[places[a] :]))
    order = sorted(atoms, key=lambda a: (-len(_bare(a)), a))
    for n, a in enumerate(order):
        (before, x), k = halves(a), places[a]
        ways.setdefault(a[k], []).append(_pattern(a[k + 1 :]) + (f"(?<={_pattern(a)})" if k else ""))
        both = [y for p, y in map(halves, order[:n]) if (y.startswith(x) or x.startswith(y)) and (p.endswith(before) or before.endswith(p))]
        said[a] = sorted({x, *both})
    first = sorted(ways, key=lambda x: (-_rarity(x), x))
    return f"(?i)(?=[{''.join(map(re.escape, first))}])(?=(" + "|".join(f"{re.escape(x)}(?:{'|'.join(ways[x])})" for x in first) + "))", said


def guarded(text: Column, patterns: list[str], build: Callable[[Column, list[Column]], Column]) -> Column:
    """build(text, may): a Column of a text and of, for each pattern, whether the text can have a match. The text is bound; one pass
    finds the atoms of the patterns' first clauses, and of the others those that it need not look closer for; the rest are looked for
    only where the first ones are found. What is built should test `may` before it looks for a pattern."""
    wanted = [needs(p) for p in patterns]
    every = [{a for c in cs for a in c} for cs in ([c for clauses in wanted for c in clauses[:1]], [c for clauses in wanted for c in clauses[1:]])]
    runs = sorted(int(a[1:]) for a in every[0] | every[1] if a.startswith(DIGITS))
    firsts, others = ({a for a in x if not a.startswith(DIGITS)} for x in every)
    rare = {_rarest(a) for a in firsts}
    atoms = firsts | {a for a in others if rare & set(a)}
    pattern, said = finder(atoms, rare)

    def held(t: Column) -> Column:
        """What was found, each between two marks."""
        return F.concat(F.lit(MARK), F.lower(F.array_join(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), MARK * 2)), F.lit(MARK)) if atoms else F.lit("")

    def run(t: Column) -> Column:
        """The largest of the wanted numbers of digits in a row that a text has."""
        out = F.lit(runs[-1] if runs else 0)
        for shorter, n in reversed(list(zip([0, *runs], runs, strict=False))):
            out = F.when(t.rlike(f"[0-9]{{{n}}}"), out).otherwise(shorter)
        return out

    def holds(b: Column, atom: str) -> Column:
        if atom.startswith(DIGITS):
            return b["run"] >= int(atom[1:])
        if atom in atoms:
            return reduce(or_, (F.contains(b["held"], F.lit(MARK + x + MARK)) for x in said[atom]))
        return b["text"].rlike(f"(?i){_pattern(atom)}")

    def may(b: Column, clauses: list[Clause]) -> Column:
        return reduce(and_, (reduce(or_, (holds(b, a) for a in sorted(c))) for c in clauses), F.lit(True))

    found = F.transform(F.array(text), lambda t: F.struct(t.alias("text"), held(t).alias("held"), run(t).alias("run")))
    return F.transform(found, lambda b: build(b["text"], [may(b, c) for c in wanted]))[0]
