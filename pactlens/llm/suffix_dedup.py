"""Repeated byte strings, by a logarithmic family of sparse suffix arrays.

A suffix array holds the suffixes of a batch that start a run of windows. In each window of ``length`` bytes the smallest
hash of a ``gram``-byte string is picked; consecutive windows with the same picked place are a run. Equal windows pick equal
strings, so a long match always meets in one key. An array is sorted by that key; each entry also has a code of
all bytes that its run spans, and where it starts. Suffixes with unequal keys are ordered by hash and not by bytes: a
scan only asks which are equal. A new batch is sorted into an array of its own and merge-scanned with the arrays of all
levels for shared keys. Two arrays of one level merge into the next level when a further batch comes.

Shared keys are then settled exactly. Runs with the same code are copies: all but the first are removed. Runs with the
same key and unequal codes agree in part; their windows are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactlens.llm.common import keyed, remove, save, whole_text, work_folder

LENGTH = 100
GRAM = 40
BATCHES = 3
SLICE = 1 << 20  # windows that are hashed at a time
POOL = 1 << 21  # windows that are compared inside a task before the shuffle

_BASE = {"key": 0x9E3779B97F4A7C15, "code": 0xD6E8FEB86659FD93}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: str) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for slices of any place in a text."""
    if base not in _POWERS:
        b, n = _BASE[base], SLICE + 4 * LENGTH
        both = []
        for x in (b, pow(b, -1, 1 << 64)):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(data: np.ndarray, base: str) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base)[0][:len(data)], out=out[1:])
    return out


def _hashes(prefix: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice, base: str) -> np.ndarray:
    """Hash of data[start:end] for each start and end: the difference of prefix sums, moved to place 0."""
    return _mix((prefix[ends] - prefix[starts]) * _powers(base)[1][:len(prefix)][starts])


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    n = len(data) - length + 1
    return _hashes(_prefix(data, "code"), slice(0, n), slice(length, length + n), "code")


def picks(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window the smallest hash of its grams, by doubling; and where the picked place changes."""
    n, wide = len(data) - gram + 1, length - gram + 1
    own = _hashes(_prefix(data, "key"), slice(0, n), slice(gram, gram + n), "key")
    low, size = own, 1
    while 2 * size <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < wide:
        low = np.minimum(low[:size - wide], low[wide - size:])
    # A window that starts with its pick loses it in the next one; in periodic text the same hash follows again.
    change = (low[1:] != low[:-1]) | (own[:len(low) - 1] == low[:-1])
    return low, np.flatnonzero(change) + 1


def slices(size: int, length: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the windows of a text, a bounded number at a time."""
    for first in range(0, size - length + 1, SLICE):
        yield first, min(first + SLICE, size - length + 1)


def runs(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, code, at) of the runs of a text; ``at`` is start * 256 + windows - 1. A run has at most
    length - gram + 1 windows. A slice ends a run: that costs comparisons of windows, not matches."""
    out = []
    whole = np.frombuffer(text, np.uint8)
    for first, end in slices(len(text), length):
        data = whole[first:end + length - 1]
        low, change = picks(data, length, gram)
        cut = np.concatenate([[0], change, [len(low)]])
        starts, stops = cut[:-1], cut[1:]
        code = _hashes(_prefix(data, "code"), starts, stops + length - 1, "code") ^ (stops - starts).astype(np.uint64)
        out.append((low[starts], code, (first + starts) * 256 + (stops - starts - 1)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, code, row, at) of all runs of (_row, text)."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, parts, size = [], [], 0
            for row, text in zip(batch["_row"], batch["text"], strict=True):
                parts.append(runs(text.encode(), length, gram))
                rows.append(row)
                size += len(parts[-1][0])
                if size > POOL:
                    yield frame(rows, parts)
                    rows, parts, size = [], [], 0
            yield frame(rows, parts)

    def frame(rows: list, parts: list) -> pd.DataFrame:
        if not parts:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("key", "code", "row", "at")})
        key, code, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        row = np.repeat(np.array(rows, np.int64), [len(p[0]) for p in parts])
        return pd.DataFrame({"key": key.view(np.int64), "code": code.view(np.int64), "row": row, "at": at})

    return docs.mapInPandas(extract, "key long, code long, row long, at long")


class SuffixLevels:
    """The family of arrays: at most a few of each level, a level twice the size of the one before."""

    def __init__(self, spark: SparkSession, folder: str, length: int = LENGTH, gram: int = GRAM):
        self.spark, self.folder, self.length, self.gram = spark, folder, length, gram
        self.levels: list[tuple[int, str, DataFrame]] = []
        self.shared: list[DataFrame] = []
        self.written = 0

    def _write(self, entries: DataFrame) -> tuple[str, DataFrame]:
        self.written += 1
        path = f"{self.folder}/array{self.written}"
        return path, save(entries.repartition("key").sortWithinPartitions("key", "row", "at"), path)

    def add(self, batch: DataFrame) -> None:
        """Sort a batch of (_row, text) into an array and scan it with all levels for shared keys."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (level, old, a), (_, new, b) = self.levels[-2:]
            path, merged = self._write(a.unionByName(b))
            self.levels[-2:] = [(level + 1, path, merged)]
            remove(self.spark, old)
            remove(self.spark, new)
        path, array = self._write(suffixes(batch, self.length, self.gram))
        entries = array.select("key", F.lit(1).alias("new"))
        for _, _, other in self.levels:
            entries = entries.unionByName(other.select("key", F.lit(0).alias("new")))
        # Entries of one key are summed before the shuffle, so a hot key is a row for each task.
        scan = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("new"))
        self.shared.append(save(scan.filter("n > 1 AND new = 1").select("key"), f"{self.folder}/shared{self.written}"))
        self.levels.append((0, path, array))

    def matches(self) -> DataFrame:
        """All entries whose key is found more than once."""
        entries, keys = self.levels[0][2], self.shared[0]
        for _, _, array in self.levels[1:]:
            entries = entries.unionByName(array)
        for more in self.shared[1:]:
            keys = keys.unionByName(more)
        keys = save(keys.distinct(), f"{self.folder}/keys{self.written}")
        return save(entries.join(keys, "key", "left_semi"), f"{self.folder}/matches{self.written}")

    def drop(self) -> None:
        for _, path, _ in self.levels:
            remove(self.spark, path)


def _compare_windows(length: int):
    """From (_row, text, ats): windows of the runs at ``ats``, those with an earlier equal in the same pool marked."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, size = [], 0
        for batch in batches:
            for row, text, ats in zip(batch["_row"], batch["text"], batch["ats"], strict=True):
                whole, ats = np.frombuffer(text.encode(), np.uint8), np.sort(np.asarray(ats, np.int64))
                first, count = ats >> 8, (ats & 255) + 1
                place = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                for a, b in slices(len(whole), length):
                    here = place[(place >= a) & (place < b)]
                    if len(here):
                        code = window_hashes(whole[a:b + length - 1], length)[here - a]
                        pool.append((code, np.full(len(here), row, np.int64), here))
                        size += len(here)
                if size > POOL:
                    yield settle(pool)
                    pool, size = [], 0
        yield settle(pool)

    def settle(pool: list) -> pd.DataFrame:
        if not pool:
            return pd.DataFrame({"code": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "pos": np.zeros(0, np.int64), "again": np.zeros(0, bool)})
        code, row, pos = (np.concatenate(x) for x in zip(*pool, strict=True))
        order = np.lexsort((pos, row))
        code, row, pos = code[order], row[order], pos[order]
        again = np.ones(len(code), bool)
        again[np.unique(code, return_index=True)[1]] = False
        return pd.DataFrame({"code": code.view(np.int64), "row": row, "pos": pos, "again": again})

    return compare


def repeated_windows(docs: DataFrame, index: SuffixLevels, folder: str) -> DataFrame:
    """(row, ats): starts of windows that also start earlier, as start * 256 + windows - 1."""
    length, found = index.length, index.matches()
    index.drop()
    place = F.struct("row", "at")
    codes = save(found.groupBy("key", "code").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), f"{folder}/codes")
    several = codes.filter("n > 1").select(F.col("key").alias("key2"), F.col("code").alias("code2"), "first")
    same = (F.col("key") == F.col("key2")) & (F.col("code") == F.col("code2")) & (place != F.col("first"))
    copies = found.join(several, same).select("row", "at")
    mixed = save(codes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("key2")), f"{folder}/mixed")
    partial = codes.join(mixed, F.col("key") == F.col("key2")).select("first.row", "first.at")
    asked = partial.groupBy(F.col("row").alias("_row")).agg(F.collect_list("at").alias("ats"))
    windows = docs.join(save(asked, f"{folder}/asked"), "_row").select("_row", "text", "ats").mapInPandas(
        _compare_windows(length), "code long, row long, pos long, again boolean")
    windows = save(windows, f"{folder}/windows")
    rank = F.row_number().over(W.partitionBy("code").orderBy("row", "pos"))  # a hot window is one row for each pool
    later = windows.filter("NOT again").withColumn("rank", rank).filter("rank > 1").select("row", "pos")
    starts = later.unionByName(windows.filter("again").select("row", "pos")).select("row", F.shiftleft("pos", 8).alias("at"))
    marks = copies.unionByName(starts)
    return save(marks.groupBy(F.col("row").alias("_row")).agg(F.collect_list("at").alias("ats")), f"{folder}/marks")


def cut(text: bytes, ats: Sequence[int], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed spans, and the bytes that stay."""
    if ats is None or not len(ats):
        return [], text
    ats = np.sort(np.asarray(ats, np.int64))
    start = ats >> 8
    end = np.maximum.accumulate(start + (ats & 255) + length)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first, last = start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]
    kept, at = [], 0
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        kept.append(text[at:a])
        at = b
    return list(zip(first.tolist(), last.tolist(), strict=True)), b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, with_kept: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier.

    Earlier: in a document with a smaller doc_id, or earlier in the same one. A null doc_id comes first; documents with
    equal ids are ordered by text hash. Texts are UTF-8 bytes, null is empty, matches never cross documents, and all
    strings are judged on the input. Returns one row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of
    byte offsets [start, end)) and, with ``with_kept``, the kept bytes. An empty table gives an empty result; further
    columns are ignored.
    """
    folder = work_folder(docs.sparkSession, "suffix")
    rows = keyed(docs.select("doc_id", "text"), f"{folder}/keyed").select("_row", "doc_id", whole_text().alias("text"))
    index = SuffixLevels(docs.sparkSession, f"{folder}/index", length, gram)
    for b in range(batches):
        index.add(rows.filter(F.pmod(F.xxhash64("_row"), F.lit(batches)) == b).select("_row", "text"))
    marks = repeated_windows(rows, index, folder)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text, ats in zip(frame["doc_id"], frame["text"], frame["ats"], strict=True):
                data = text.encode()
                spans, kept = cut(data, ats, length)
                row = (doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans])
                out.append((*row, kept) if with_kept else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * with_kept
            yield pd.DataFrame(out, columns=names)

    # Ids travel as text: pandas has no integer column with nulls.
    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    named = rows.join(marks, "_row", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "ats")
    out = named.mapInPandas(apply, schema + ", kept binary" * with_kept)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
