"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch that repeats with a smallest period and can't be extended. The last square of a run, two copies of its period, is a
branching one: its two halves continue differently. So both halves start suffixes of one LCP interval whose depth is the period, on
different sides of one of its boundaries. For every boundary the suffixes of the smaller side look up, in the inverse suffix array,
whether the suffix ``depth`` words before or after lies on the other side. The squares found are rotated to the
left as far as they go and merged into runs. There are no tree nodes: intervals are bounds in the LCP array.

Spark deals out the documents; a task handles some documents at a time as arrays, in which no interval crosses documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import whole_text

MIN_LENGTH = 6
MIN_EXPONENT = 4
POOL_WORDS = 1 << 17  # words of the documents that share one array; a longer document is handled by itself
PAIRS = 1 << 20  # suffixes of smaller sides that are tested at a time

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
RESULT = f"struct<n_words:bigint,runs:{RUN},collapsed:string>"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array and, for k = 0, 1, .., the classes of all places by their next 2**k codes.

    Classes double until every place has its own; only places that still share one are sorted again. Each document must
    end in a code that occurs once.
    """
    sa = np.argsort(codes, kind="stable")
    ordered = codes[sa]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.arange(len(codes))
    rank = np.empty(len(codes), np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, at, 0))
    classes, h = [rank.astype(np.int32)], 1
    alone = head & np.concatenate([head[1:], [True]])
    open_ = np.flatnonzero(~alone)
    while len(open_):
        places = sa[open_]
        key = rank[places] * len(codes) + rank[places + h]
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
        sa[open_] = places
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[places] = np.maximum.accumulate(np.where(head, open_, 0))
        classes.append(rank.astype(np.int32))
        open_ = open_[~(head & np.concatenate([head[1:], [True]]))]
        h *= 2
    return sa, classes


def lcp_array(sa: np.ndarray, classes: list[np.ndarray]) -> np.ndarray:
    """Common codes of each suffix with the one before it in the suffix array; 0 for the first."""
    lcp = np.zeros(len(sa), np.int64)
    near = np.flatnonzero(classes[0][sa[1:]] == classes[0][sa[:-1]]) + 1
    a, b = sa[near - 1].copy(), sa[near].copy()
    for k in range(len(classes) - 1, -1, -1):
        step = np.where(classes[k][a] == classes[k][b], 1 << k, 0)
        a += step
        b += step
    lcp[near] = a - sa[near - 1]
    return lcp


def nearest_below(lcp: np.ndarray, at: np.ndarray, strict: bool) -> np.ndarray:
    """For each boundary of ``at`` the closest one before it with a smaller (or, if not ``strict``, equal) value.

    Steps of doubling width over window minima, then back in halves. lcp[0] is 0, so there is one for every positive value.
    """
    value, place = lcp[at] + (0 if strict else 1), at - 1
    minima, reached = [lcp], np.zeros(len(at), np.int64)
    active = np.flatnonzero(minima[0][place] >= value)
    while len(active):
        k = len(minima) - 1
        place[active] -= 1 << k
        reached[active] = k + 1
        wide = minima[-1].copy()
        wide[1 << k:] = np.minimum(wide[1 << k:], minima[-1][:-(1 << k)])
        wide[:(1 << (k + 1)) - 1] = -1  # a window over the border holds a smaller value
        minima.append(wide)
        active = active[wide[place[active]] >= value[active]]
    for k in range(len(minima) - 1, -1, -1):
        active = np.flatnonzero(reached > k)
        go = active[minima[k][place[active]] >= value[active]]
        place[go] -= 1 << k
    return place


def branching_squares(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of the squares whose halves continue differently."""
    n = len(sa)
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    at = np.flatnonzero(lcp)
    left = nearest_below(lcp, at, strict=False)
    back = np.concatenate([[0], lcp[:0:-1]])  # boundaries from the other end
    right = n - nearest_below(back, n - at, strict=True)
    smaller_left = at - left <= right - at
    first = np.where(smaller_left, left, at)
    size = np.minimum(at - left, right - at)
    low, high = np.where(smaller_left, at, left), np.where(smaller_left, right, at)
    starts, halves = [], []
    ends = np.cumsum(size)
    begin = 0
    while begin < len(at):
        stop = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right")), begin + 1)
        for a in range(0, int(size[begin]) if stop == begin + 1 else 1, PAIRS):  # one side may be longer than a part
            one = slice(begin, stop)
            count = np.minimum(size[one] - a, PAIRS)
            node = np.repeat(np.arange(begin, stop), count)
            offset = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count) + a
            place, depth = sa[first[node] + offset], lcp[at[node]]
            for shift in (depth, -depth):
                other = place + shift
                inside = (other >= 0) & (other < n)
                rank = isa[np.where(inside, other, 0)]
                hit = np.flatnonzero(inside & (rank >= low[node]) & (rank < high[node]))
                starts.append(np.minimum(place[hit], other[hit]))
                halves.append(depth[hit])
        begin = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(halves)


def rotate_left(start: np.ndarray, half: np.ndarray, first: np.ndarray, classes: list[np.ndarray]) -> np.ndarray:
    """The start of the longest stretch with period ``half`` that ends with each square, not before ``first``."""
    start = start.copy()
    for k in range(len(classes) - 1, -1, -1):
        before = start - (1 << k)
        at = np.maximum(before, 0)
        start = np.where((before >= first) & (classes[k][at] == classes[k][at + half]), before, start)
    return start


def runs_of(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period. ``bounds`` holds the first place of each document in ``codes``."""
    sa, classes = suffix_array(codes)
    start, half = branching_squares(sa, lcp_array(sa, classes))
    # Squares that end in one place: the shortest gives a run; multiples of its period inside the run are the same run.
    order = np.lexsort((half, start + 2 * half))
    start, half = start[order], half[order]
    end = start + 2 * half
    parts = [[], [], []]
    while len(start):
        lead = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        first = bounds[np.searchsorted(bounds, start[lead], side="right") - 1]
        begin = rotate_left(start[lead], half[lead], first, classes)
        for part, values in zip(parts, (begin, end[lead], half[lead]), strict=True):
            part.append(values)
        group = np.cumsum(np.concatenate([[True], end[1:] != end[:-1]])) - 1
        rest = (half % half[lead][group] != 0) | (start < begin[group])
        start, half, end = start[rest], half[rest], end[rest]
    if not parts[0]:
        return tuple(np.zeros(0, np.int64) for _ in parts)
    begin, end, period = (np.concatenate(p) for p in parts)
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


def _pools(texts: list[str], limit: int) -> Iterator[list[list[bytes]]]:
    """Word lists of some texts at a time."""
    pool, size = [], 0
    for text in texts:
        words = text.encode().split()  # bytes are split at exactly space and 9 to 13
        if pool and size + len(words) > limit:
            yield pool
            pool, size = [], 0
        pool.append(words)
        size += len(words)
    if pool:
        yield pool


def describe(texts: list[str], min_length: int, min_exponent: int, limit: int = POOL_WORDS) -> pa.StructArray:
    """n_words, runs and collapsed text of each text."""
    n_words, counts, columns, collapsed = [], [], [[], [], []], []
    for pool in _pools(texts, limit):
        names = {}
        for words in pool:
            for w in words:
                if w not in names:
                    names[w] = len(names) + 1
        # Codes are ordered by document first; 0 ends a document.
        bounds = np.cumsum([0] + [len(words) + 1 for words in pool])
        codes = np.zeros(bounds[-1], np.int64)
        for i, words in enumerate(pool):
            codes[bounds[i]:bounds[i + 1] - 1] = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
            codes[bounds[i]:bounds[i + 1]] += i * (len(names) + 1)
        start, end, period = runs_of(codes, bounds)
        kept = end - start >= np.maximum(min_length, min_exponent * period)
        start, end, period = start[kept], end[kept], period[kept]
        cuts = np.searchsorted(start, bounds)
        for i, words in enumerate(pool):
            own = slice(cuts[i], cuts[i + 1])
            n_words.append(len(words))
            counts.append(cuts[i + 1] - cuts[i])
            if counts[-1]:
                drop = np.zeros(len(words) + 1, np.int64)
                np.add.at(drop, start[own] + period[own] - bounds[i], 1)
                np.add.at(drop, end[own] - bounds[i], -1)
                words = [words[j] for j in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
            collapsed.append(b" ".join(words).decode())
        for column, values in zip(columns, (start - bounds[np.searchsorted(bounds, start, side="right") - 1], end - start, period), strict=True):
            column.append(values)
    start, length, period = (np.concatenate([np.zeros(0, np.int64), *c]) for c in columns)
    rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], fields=list(_RUN_TYPE))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), pa.int32())
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(offsets, rows), pa.array(collapsed, pa.string())], ["n_words", "runs", "collapsed"]
    )


def runs_column(text: Column, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> Column:
    """Struct of n_words, runs and collapsed for a column of texts without nulls."""

    @F.arrow_udf(RESULT)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield describe(batch.to_pylist(), min_length, min_exponent)

    return find(text)


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Runs of every document: (_doc, n_words, runs, collapsed), where ``_doc`` is the whole row.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``runs`` has start, length and smallest period in words, by start and period, of
    the runs with ``min_length`` words and ``min_exponent`` periods (2 or more). ``collapsed`` has the words that no run holds after its first
    period, joined by one space. Null and empty texts have no words, no runs and an empty collapsed text. Every row is
    returned, repeated rows and null ids too; an empty table gives an empty result. Texts are handled whole: a text of any length is one
    array in one task, of some 150 bytes for each of its words. Further columns travel in the struct, so names cannot clash.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    found = docs.select(F.struct("*").alias("_doc"), runs_column(whole_text(), min_length, min_exponent).alias("_r"))
    return found.select("_doc", "_r.n_words", "_r.runs", "_r.collapsed")
