"""Text: white space, hyphens, lines, snippets, tokens and hashes, as native Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.lexicon import PROTECTED, STANDARD_WORDS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: ASCII's white space, which patterns call \\s.
SPACE = " \t\n\x0b\f\r"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column | str) -> Column:
    """Without ASCII white space at both ends; trim() alone would only take spaces."""
    return F.trim(col(c), F.lit(SPACE))


def normalize_whitespace(c: Column | str) -> Column:
    """Line feeds for all line ends, one space for runs of spaces and tabs, at most one blank line, no ends of white space. Patterns
    match only what changes."""
    lines = F.when(F.contains(col(c), F.lit("\r")), F.regexp_replace(col(c), r"\r\n?", "\n")).otherwise(col(c))
    spaced = F.regexp_replace(lines, r"[ \t]{2,}|\t", " ")
    return strip(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def kept_hyphens() -> str:
    """A pattern for hyphens at a line's end that stay: after a standard's prefix, or between two letters that stand side by
    side in a protected word."""
    pairs: dict[str, set[str]] = {}
    for word in PROTECTED:
        for a, b in zip(word, word[1:], strict=False):
            pairs.setdefault(a, set()).add(b)
    inside = "|".join(f"{a}-\\n[{''.join(sorted(b))}]" for a, b in sorted(pairs.items()))
    return rf"(?i:\b(?:{'|'.join(STANDARD_WORDS)})-\n[A-Z]|{inside})"


#: The kept hyphens come first and use up their letters, so that matches never overlap.
HYPHENS = rf"({kept_hyphens()})|([A-Za-z])-\n([A-Za-z])"


def dehyphenate(c: Column | str) -> Column:
    """Words that a hyphen and a line's end part are joined, but for protected abbreviations."""
    return F.when(F.contains(col(c), F.lit("-\n")), F.regexp_replace(col(c), HYPHENS, "$1$2$3")).otherwise(col(c))


def split_lines(c: Column | str) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(col(c), "\n"), strip), lambda x: x != "")


def remove_lines(c: Column | str, lines: Column | str) -> Column:
    """Text without the lines of an array; untouched if the array is empty or null, else its lines are stripped, too."""
    rest = F.array_join(F.filter(split_lines(c), lambda x: ~F.array_contains(col(lines), x)), "\n")
    return F.when(F.coalesce(F.size(col(lines)), F.lit(0)) <= 0, col(c)).otherwise(rest)


def collapse(c: Column | str) -> Column:
    """One space for each run of white space, none at the ends. The pattern leaves single spaces alone, and begins with one class of
    characters, which is quicker to test than two ways to match."""
    return strip(F.regexp_replace(col(c), r"\s(?:\s+|(?<! ))", " "))


def snippet(c: Column | str, length: int) -> Column:
    """Collapsed text, cut to a length with "..." behind."""
    text = collapse(F.coalesce(col(c), F.lit("")))
    return F.when(F.length(text) <= length, text).otherwise(F.concat(strip(F.left(text, F.lit(length))), F.lit("...")))


def tokens(c: Column | str) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]+)"), 1)


def token_hash(c: Column | str) -> Column:
    """The low 64 bits of a token's MD5, as a bit pattern in a long."""
    return F.conv(F.substring(F.md5(col(c)), 17, 16), 16, -10).cast("long")


def unsigned(c: Column | str) -> Column:
    """A long's bits as an unsigned decimal string."""
    return F.conv(F.hex(col(c)), 16, 10)


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def first_match(candidates: list[tuple[Column, str]]) -> Column:
    """The whole match of the first pattern that is found, stripped; null if none is. Patterns go before places in the text."""
    return F.coalesce(*(bound(strip(F.regexp_extract(c, p, 0)), lambda x: F.when(x != "", x)) for c, p in candidates))


def content_hash(doc_id: Column | str, page: Column | str, index: Column | str, text: Column | str) -> Column:
    parts = [col(doc_id).cast("string"), F.coalesce(col(page), F.lit(0)).cast("string"), col(index).cast("string"), collapse(text)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def chunk_id(doc_id: Column | str, page: Column | str, index: Column | str) -> Column:
    return F.concat(col(doc_id).cast("string"), F.lit("#p"), F.coalesce(col(page), F.lit(0)).cast("string"), F.lit("#c"), col(index).cast("string"))


def non_alpha_ratio(c: Column | str) -> Column:
    """Characters that are no ASCII letter, digit or white space, by all; 1 for an empty text."""
    n = F.length(col(c))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(col(c), r"[A-Za-z0-9\s]+", "")) / n)


def repeated_line_ratio(c: Column | str) -> Column:
    """1 less distinct lines by lines; 0 without lines."""
    return bound(split_lines(c), lambda lines: F.when(F.size(lines) == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(lines)) / F.size(lines)))


def extraction_stats(c: Column | str, pages: Column | None = None) -> Column:
    """Struct text_length, page_count, non_alpha_ratio and repeated_line_ratio (rounded to 4 places)."""
    return F.struct(
        F.length(col(c)).alias("text_length"), (pages if pages is not None else F.lit(1)).alias("page_count"),
        F.round(non_alpha_ratio(c), 4).alias("non_alpha_ratio"), F.round(repeated_line_ratio(c), 4).alias("repeated_line_ratio"),
    )
