"""Fill-in-the-middle: texts cut into prefix, middle and suffix at random units, and put together with sentinels.

A unit is a match of a pattern. The tokenizers library's Split pre-tokenizer with isolated matches gives the units' offsets in code
points; nothing is trained. The offsets' number is n; the cuts are the offsets ranked by two draws of 0 to n, so that a prefix, middle
or suffix may be empty. Draws are 32-bit groups of the sha256 of `<seed>:<doc_id>`, so a row's cut depends on its id and text alone,
whatever task makes it. A long text is split a window at a time, and only offsets are held.

Null texts are empty; empty texts and those that hold a sentinel stay plain. A null id is drawn for as "null". Rows that repeat an id
are each cut by their own text. Other columns of the input are left behind.
"""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns, map_texts, texts

#: White space goes with the word behind it.
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SENTINELS = ("<P>", "<S>", "<M>")
FORMS = columns("doc_id long,n long,form string,prefix_chars long,middle_chars long,output string")


def unit_ends(text: str, splitter, window: int = 1 << 20) -> array:
    """The code-point offsets at which units end. The text is split by windows: a window's last unit may go on, so the next window
    begins there; one that is all a single unit is made longer."""
    ends, start, size = array("q"), 0, window
    while start < len(text):
        found = splitter.pre_tokenize_str(text[start : start + size])
        if start + size < len(text):
            if len(found) < 2:
                size *= 2
                continue
            found.pop()
        ends.extend(start + end for _, (_, end) in found)
        start, size = ends[-1], window
    return ends


def draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that cannot overlap each other, so that those put in are the only ones found in an output."""
    if len(set(sentinels)) < 3 or not all(sentinels) or any(a[0] in b[1:] for a in sentinels for b in sentinels) or any(a != b and a.startswith(b) for a in sentinels for b in sentinels):
        raise ValueError("sentinels have to differ, none beginning another, and their first characters may stand nowhere else in them")
    return sentinels


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80, units: str = UNITS, sentinels: tuple[str, str, str] = SENTINELS, window: int = 1 << 20) -> DataFrame:
    """doc_id, n (units), form ("plain", "psm" or "spm"), prefix_chars and middle_chars (code points; null if plain) and output.
    rate: how many in a hundred texts are cut; spm: of those, how many in a hundred have the suffix first. units has to match every
    character, and its matches may not depend on what was matched before."""
    p, s, m = _checked(sentinels)
    splitters: list = []  # made once in each worker

    def work(ids: list, values: list) -> dict[str, list]:
        if not splitters:
            from tokenizers import Regex
            from tokenizers.pre_tokenizers import Split

            splitters.append(Split(Regex(units), "isolated"))
        out: dict[str, list] = {f.name: [] for f in FORMS}
        for doc_id, text in zip(ids, values, strict=True):
            ends, (h1, h2, h3, h4) = unit_ends(text, splitters[0], window), draws(seed, doc_id)
            a = b = None
            form, made = "plain", text
            if text and h3 % 100 < rate and not any(x in text for x in sentinels):
                a, b = (ends[k - 1] if k else 0 for k in sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1))))
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                form = "spm" if h4 % 100 < spm else "psm"
                made = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"
            for name, value in zip(out, (doc_id, len(ends), form, a, None if a is None else b - a, made), strict=True):
                out[name].append(value)
        return out

    return map_texts(texts(docs), FORMS, work)


def restored(output: Column | str = "output", form: Column | str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    p, s, m = _checked(sentinels)
    out, kind = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        at, mid = F.locate(second, out), F.locate(m, out)
        between = lambda a, b: F.substring(out, a, b - a)
        return between(F.lit(len(first) + 1), at), between(at + len(second), mid), F.substring(out, mid + len(m), F.length(out))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(kind == "psm", psm).when(kind == "spm", F.concat(prefix, middle, suffix)).otherwise(out)
