"""What a text says of itself: revision, date, standards, kind, trade, section; and the names of files."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import lexicon as L
from millrace.functions.patterns import guarded
from millrace.functions.text import bound, col, collapse, first_match, strip


def revision(name: Column | str, text: Column | str | None = None) -> Column:
    """The first revision mark of the file's name, else of the text's first 2000 characters."""
    own = first_match([(F.coalesce(col(name), F.lit("")), p) for p in L.REVISION_PATTERNS])
    return own if text is None else F.coalesce(own, _first(F.coalesce(F.substring(col(text), 1, 2000), F.lit("")), L.REVISION_PATTERNS))


def _first(sample: Column, patterns: list[str], flags: str = "") -> Column:
    """first_match of patterns that the sample can have; null for null."""
    return guarded(sample, patterns, lambda t, may: _first_of(t, patterns, may, flags))


def _first_of(sample: Column, patterns: list[str], may: list[Column], flags: str = "") -> Column:
    return F.coalesce(*(F.when(m, first_match([(sample, flags + p)])) for m, p in zip(may, patterns, strict=True)))


def document_date(text: Column | str) -> Column:
    return _first(F.substring(col(text), 1, 3000), L.DATE_PATTERNS, "(?i)")


def garbled_ratio(text: Column | str) -> Column:
    """Marks of bad character recognition by words, in the first 5000 characters; patterns may count one place twice."""
    sample = F.substring(F.coalesce(col(text), F.lit("")), 1, 5000)

    def count(t: Column, words: Column, pattern: str, may: Column) -> Column:
        if long := re.fullmatch(r"\[\^\\s\]\{(\d+),\}", pattern):  # words of a length, of which each is one match
            return F.size(F.filter(words, lambda x: F.length(x) >= int(long[1])))
        return F.when(may, F.regexp_count(t, F.lit(pattern))).otherwise(0)

    def ratio(t: Column, may: list[Column]) -> Column:
        issues = lambda words: sum((count(t, words, p, m) for p, m in zip(L.GARBLED_PATTERNS, may, strict=True)), F.lit(0))
        n = lambda words: F.size(F.filter(words, lambda x: x != ""))
        return bound(F.split(t, r"\s+"), lambda words: F.coalesce(F.try_divide(issues(words), n(words)), F.lit(0.0)))

    return guarded(sample, L.GARBLED_PATTERNS, ratio)


def is_drawing(text: Column | str, name: Column | str) -> Column:
    sample = F.substring(F.coalesce(col(text), F.lit("")), 1, 2000)
    named = F.coalesce(col(name), F.lit("")).rlike(L.DRAWING_NAME)

    def any_of(t: Column, may: list[Column]) -> Column:
        out = F.lit(False)
        for m, p in zip(may, L.DRAWING_PATTERNS, strict=True):
            out = out | (m & t.rlike(f"(?i){p}"))
        return out

    return named | guarded(sample, L.DRAWING_PATTERNS, any_of)


def base_name(name: Column | str) -> Column:
    """A file's name without extension and revision."""
    out = col(name)
    for suffix in L.NAME_SUFFIXES:
        out = F.regexp_replace(out, suffix, "")
    return strip(out)


def standards(text: Column | str) -> Column:
    """Distinct standards that a text names, in one spelling, sorted."""
    return guarded(F.coalesce(col(text), F.lit("")), L.STANDARD_PATTERNS, _standards)


def _standards(t: Column, may: list[Column]) -> Column:
    none = F.array().cast("array<string>")
    found = F.flatten(F.array(*(F.when(m, F.regexp_extract_all(t, F.lit(f"(?i)({p})"), 1)).otherwise(none) for m, p in zip(may, L.STANDARD_PATTERNS, strict=True))))
    spelt = F.transform(found, lambda s: F.replace(F.regexp_replace(F.upper(strip(s)), r"\s+", " "), F.lit("/ "), F.lit("/")))
    return F.when(reduce(or_, may), F.array_sort(F.array_distinct(spelt))).otherwise(none)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def standard_title(standard: Column | str) -> Column:
    """A standard's title; without its year, and if need be without its last part number. Null if unknown."""
    key = F.regexp_replace(collapse(F.upper(col(standard))), r":\d{4}$", "")
    return F.coalesce(_lookup(L.STANDARDS, key), _lookup(L.STANDARDS, F.regexp_replace(key, r"\.\d+$", "")))


def abbreviation(short: Column | str) -> Column:
    """An abbreviation's full name, whatever its case; null if unknown."""
    return _lookup(L.ABBREVIATIONS, F.upper(col(short)))


def expand_query(query: Column | str) -> Column:
    """A query with the full name of the first listed abbreviation that it has as a word."""
    q = col(query)
    return F.coalesce(*(F.when(q.rlike(rf"(?i)\b{a}\b"), F.concat(q, F.lit(f" ({L.ABBREVIATIONS[a]})"))) for a in L.QUERY_ABBREVIATIONS), q)


def _best(table: dict[str, list[str]], finish: Callable[[Column], Column]) -> Callable[[Column, list[Column]], Column]:
    """Of a sample and of which patterns it can have, finish() of a struct: name of the key whose patterns are found most often,
    ignoring case (the first one of equals; null if none is found), that number, and the sum. One fold, so that each pattern is looked
    for once."""
    start = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("score"), F.lit(0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        better = x["score"] > acc["score"]
        return F.struct(F.when(better, x["name"]).otherwise(acc["name"]).alias("name"), F.greatest(acc["score"], x["score"]).alias("score"), (acc["total"] + x["score"]).alias("total"))

    def scores(t: Column, may: list[Column]) -> Column:
        left = iter(may)
        count = lambda p: F.when(next(left), F.regexp_count(t, F.lit(f"(?i){p}"))).otherwise(0)
        pairs = [F.struct(F.lit(n).alias("name"), sum((count(p) for p in patterns), F.lit(0)).cast("int").alias("score")) for n, patterns in table.items()]
        return F.aggregate(F.array(*pairs), start, step, finish)

    return scores


def _kind(best: Column) -> Column:
    share = F.when(best["total"] > 0, F.round(best["score"] / best["total"], 3)).otherwise(F.lit(0.0))
    return F.struct(F.coalesce(best["name"], F.lit("general")).alias("doc_type"), share.alias("confidence"))


TYPE_SAMPLE, TRADE_SAMPLE, SECTION_SAMPLE = 5000, 10000, 500
TYPE_PATTERNS, TRADE_PATTERNS = ([p for patterns in table.values() for p in patterns] for table in (L.DOCUMENT_TYPES, L.DISCIPLINES))


def _sample(text: Column | str, n: int) -> Column:
    return F.substring(F.coalesce(col(text), F.lit("")), 1, n)


def document_type(text: Column | str) -> Column:
    """Struct doc_type ("general" without a match) and confidence (its share of all matches, 3 places), of 5000 characters."""
    return guarded(_sample(text, TYPE_SAMPLE), TYPE_PATTERNS, _best(L.DOCUMENT_TYPES, _kind))


def discipline(text: Column | str) -> Column:
    """The trade that most patterns speak for, in the first 10000 characters; null if none does."""
    return guarded(_sample(text, TRADE_SAMPLE), TRADE_PATTERNS, _best(L.DISCIPLINES, lambda best: best["name"]))


def section_reference(text: Column | str) -> Column:
    """The first section mark of the first 500 characters; ^ is a line's beginning."""
    return _first(_sample(text, SECTION_SAMPLE), L.SECTION_REFERENCES, "(?imd)")


def is_section_line(line: Column | str) -> Column:
    return strip(line).rlike("(?i)^(?:" + "|".join(L.SECTION_LINES) + ")")


def metadata(text: Column | str) -> Column:
    """Struct of what a chunk's record says of its text. One pass over the text finds what all of them need; that a text has it beyond
    a sample rules nothing out."""
    sets = (TYPE_PATTERNS, TRADE_PATTERNS, L.STANDARD_PATTERNS, L.SECTION_REFERENCES)

    def first(t: Column, n: int) -> Column:
        return F.when(F.octet_length(t) <= n, t).otherwise(F.left(t, F.lit(n)))

    def said(t: Column, may: list[Column]) -> Column:
        left = iter(may)
        kinds, trades, named, marks = ([next(left) for _ in patterns] for patterns in sets)
        kind = bound(first(t, TYPE_SAMPLE), lambda x: _best(L.DOCUMENT_TYPES, _kind)(x, kinds))
        trade = bound(first(t, TRADE_SAMPLE), lambda x: _best(L.DISCIPLINES, lambda best: best["name"])(x, trades))
        mark = bound(first(t, SECTION_SAMPLE), lambda x: _first_of(x, L.SECTION_REFERENCES, marks, "(?imd)"))
        rest = (trade.alias("discipline"), _standards(t, named).alias("standards_referenced"), mark.alias("section_reference"))
        return bound(kind, lambda k: F.struct(k["doc_type"].alias("doc_type"), k["confidence"].alias("doc_type_confidence"), *rest))

    return guarded(F.coalesce(col(text), F.lit("")), [p for patterns in sets for p in patterns], said)


def error_message(event: Column | str) -> Column:
    """The message of a failed job's error (JSON text): a plain string, the cause's message, the cause, the error's name, or a
    default."""
    e = col(event)
    cause = F.get_json_object(e, "$.Cause")
    plain = F.when(~e.rlike(r"^\s*\{"), F.regexp_replace(e, '^"|"$', ""))
    return F.coalesce(plain, F.get_json_object(cause, "$.errorMessage"), cause, F.get_json_object(e, "$.Error"), F.lit("Pipeline failed"))
