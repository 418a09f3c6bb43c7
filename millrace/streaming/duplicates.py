"""The duplicate rules as files arrive: what operators.duplicates gives with visibility "as_of", by a stream of any batches.

Files come batch by batch; within a batch they are taken by created_at, ties by file_id, nulls first. If batches are cut along that
order, all rows together are those of the whole table; a file that comes late is taken when it comes. A tenant's state is its newest
files' fingerprints and names; the rule of equal bytes is keyed by tenant and hash, so that a tenant's files are spread by their hash,
and holds a number and the first ids of each, in tables (held.py). A task holds a tenant's slim rows of one batch, and sorts a hash's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.construction import base_name, revision
from millrace.operators.duplicates import NEWEST
from millrace.streaming.held import Held, by_keys


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["created_at", "file_id"], na_position="first", kind="stable")


def exact_duplicates(files: DataFrame, shown: int = 5) -> Held:
    """tenant_id, file_id, group_id (the first file of these bytes), matches (how many came before), match_ids (the first `shown`)."""
    by, most = ["tenant_id", "raw_sha256"], max(shown, 1)
    slim = files.where("raw_sha256 IS NOT NULL AND raw_sha256 <> ''").select(*by, "created_at", "file_id")
    kind = files.schema["file_id"].dataType.simpleString()
    order = [F.col(c).asc_nulls_first() for c in ("created_at", "file_id")]

    def numbered(batch: DataFrame) -> DataFrame:
        return batch.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))

    def fold(batch: DataFrame, states: DataFrame) -> DataFrame:
        first = F.array_sort(F.collect_list(F.when(F.col("i") <= most, F.struct("i", "file_id"))))
        groups = numbered(batch).groupBy(*by).agg(F.count("*").alias("size"), F.transform(first, lambda x: x["file_id"]).alias("new"))
        known = by_keys(groups, states, by, "left")
        before, held = F.coalesce("n", F.lit(0).cast("long")), F.coalesce("first", F.array().cast(f"array<{kind}>"))
        return known.select(*by, (before + F.col("size")).alias("n"), F.slice(F.concat(held, "new"), 1, most).alias("first"), before.alias("before"))

    def rows(batch: DataFrame, folded: DataFrame) -> DataFrame:
        found = by_keys(numbered(batch), folded.where("n > 1"), by, "inner").withColumn("matches", F.col("before") + F.col("i") - 1).where("matches > 0")
        return found.select("tenant_id", "file_id", F.col("first")[0].alias("group_id"), "matches", F.slice("first", F.lit(1), F.least(F.lit(shown), F.col("matches")).cast("int")).alias("match_ids"))

    return Held(slim, by, {"n": "bigint", "first": f"array<{kind}>"}, fold, rows)


_FOUND = "tenant_id string, file string, near array<string>, distances array<int>, matches int, revision string, other string, other_revision string"
_STATE = "files array<string>, prints array<long>, printed array<boolean>, bases array<string>, revisions array<string>"


def _codes(values: list[str | None]) -> np.ndarray:
    """Equal values as equal numbers, null as -1."""
    return pd.factorize(np.array(values, object))[0]


def recent_duplicates(files: DataFrame, text: str | None = None, distance: int = 3, limit: int = NEWEST, shown: int = 5) -> DataFrame:
    """tenant_id, file_id, matches, near (file_id, distance of the `shown` newest), revision, other_file_id, other_revision: near
    fingerprints and other revisions among the tenant's newest files when each came (itself counts as one of `limit`). Files with
    neither have no row."""
    kind = files.schema["file_id"].dataType
    marks = {"own": revision("filename", text), "named": revision("filename"), "base": F.lower(base_name("filename"))}
    slim = files.withColumns(marks).select(
        "tenant_id", "created_at", "file_id", F.col("file_id").cast("string").alias("file"), F.col("simhash").isNotNull().alias("printed"), F.coalesce("simhash", F.lit(0).cast("long")).alias("print"), *marks
    )

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [list(x) for x in state.get] if state.exists else [[] for _ in range(5)]
        new = _in_order(frames)
        old = len(held[0])
        text_of = lambda c: [x if isinstance(x, str) else None for x in new[c]]
        every = [a + list(b) for a, b in zip(held, (new["file"], new["print"], new["printed"], text_of("base"), text_of("named")), strict=True)]
        own, total = [None] * old + text_of("own"), len(every[0])
        prints, printed, file, base = np.array(every[1], np.int64), np.array(every[2], bool), _codes(every[0]), _codes(every[3])
        marks = _codes(every[4] + own)
        named, mine = marks[:total], marks[total:]
        asks = (mine >= 0) & (base >= 0) & np.array([bool(b) for b in every[3]], bool)
        near: dict[int, list[tuple[str, int]]] = {}
        other: dict[int, int] = {}
        for back in range(1, min(limit, total)):  # the newest first; all files at once
            a = np.arange(max(back, old), total)
            b = a - back
            apart = file[a] != file[b]
            bits = np.bitwise_count((prints[a] ^ prints[b]).view(np.uint64))  # of a negative number it would count its absolute value's
            for i in np.flatnonzero(apart & printed[a] & printed[b] & (bits <= distance)).tolist():
                near.setdefault(int(a[i]), []).append((every[0][b[i]], int(bits[i])))
            for i in np.flatnonzero(apart & asks[a] & (base[a] == base[b]) & (named[b] >= 0) & (named[b] != mine[a])).tolist():
                other.setdefault(int(a[i]), int(b[i]))
        out = []
        for i in sorted(near.keys() | other.keys()):
            n, j = near.get(i, []), other.get(i)
            rest = (None,) * 3 if j is None else (own[i], every[0][j], every[4][j])
            out.append((key[0], every[0][i], [f for f, _ in n[:shown]], [d for _, d in n[:shown]], len(n), *rest))
        kept = slice(max(0, total - limit + 1), total)
        state.update(([*every[0][kept]], [int(x) for x in every[1][kept]], [bool(x) for x in every[2][kept]], [*every[3][kept]], [*every[4][kept]]))
        yield pd.DataFrame(out, columns=["tenant_id", "file", "near", "distances", "matches", "revision", "other", "other_revision"])

    found = slim.groupBy("tenant_id").applyInPandasWithState(fold, _FOUND, _STATE, "append", GroupStateTimeout.NoTimeout)
    near = F.zip_with("near", "distances", lambda f, d: F.struct(f.cast(kind).alias("file_id"), d.alias("distance")))
    return found.select("tenant_id", F.col("file").cast(kind).alias("file_id"), "matches", near.alias("near"), "revision", F.col("other").cast(kind).alias("other_file_id"), "other_revision")
