"""SimHash near-dedup with multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within the radius agree, up to a few bits, in one segment at least,
so each enumerates the small Hamming ball of its segments, fetches the rows of those buckets and verifies the complete
distance. Equal fingerprints are one row throughout. Before that search, every bucket links its rows to one leader, so
that large groups of copies are single components and their pairs are not made again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import save, work_folder
from pactlens.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
LEADER_ROUNDS = 2
STRIDE = 1 << 16  # shingles whose bits are counted at a time

_GOLDEN = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _remix(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 bits from a hash (the finaliser of splitmix64)."""
    x = h + np.uint64(_GOLDEN * lane % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    data, digest, size = b" ".join(words), xxhash.xxh64_intdigest, len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, size) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, size - shingle + 1)
    last = ends[min(shingle, size) - 1:]
    spans = zip(starts[:n].tolist(), last.tolist(), strict=True)
    return np.fromiter((digest(data[s:e], SEED) for s, e in spans), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE, lanes: int = 1) -> list[int]:
    """Signed 64-bit lanes of a text's shingles, repeats included."""
    return print_of(shingle_hashes(text, shingle), lanes)


def print_of(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """Signed 64-bit lanes. A bit is set if it is set in over half the hashes; no hashes: all zero."""
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), STRIDE):
            h = hashes[at:at + STRIDE]
            h = _remix(h, lane) if lane else h
            bits = np.unpackbits(np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(text: Column, shingle: int = SHINGLE, lanes: int = 1) -> Column:
    """array<long> of the lanes."""

    @F.pandas_udf("array<long>")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, shingle, lanes) for t in batch])

    return prints(text)


class Segments:
    """Segments of ``lanes`` x 64 bits, each inside one lane: (lane, offset, bits, ball radius)."""

    def __init__(self, parts: Sequence[tuple[int, int, int, int]]):
        self.parts = list(parts)

    @classmethod
    def exact(cls, rows: int, radius: int) -> Segments:
        """For one lane: the number of segments with the least work for ``rows`` fingerprints, losing no pair.

        With m segments and radius = m q + a, the first a + 1 segments need balls of radius q and the others of q - 1.
        """
        best = None
        for m in range(1, 9):
            q, a = divmod(radius, m)
            cuts = [64 * i // m for i in range(m + 1)]
            parts = [(0, cuts[i], cuts[i + 1] - cuts[i], q if i <= a else q - 1) for i in range(m) if i <= a or q]
            cost = sum(ball_size(b, r) * (1 + rows / 2.0**b) for _, _, b, r in parts)
            best = min(best or (cost, parts), (cost, parts))
        return cls(best[1])

    @classmethod
    def wide(cls, lanes: int, bits: int, ball: int) -> Segments:
        return cls([(lane, at, bits, ball) for lane in range(lanes) for at in range(0, 64, bits)])

    def of_lane(self, lane: int) -> Segments:
        return Segments([p for p in self.parts if p[0] == lane])

    def _value(self, i: int, fp: str) -> Column:
        lane, at, bits, _ = self.parts[i]
        word = F.get(F.col(fp), F.lit(lane))
        return word if bits == 64 else F.shiftrightunsigned(word, at).bitwiseAND(F.lit((1 << bits) - 1))

    def _shifted(self, i: int, fp: str):
        own = self._value(i, fp)
        return lambda mask: F.struct(F.lit(i).alias("seg"), own.bitwiseXOR(mask).alias("val"))

    def rows(self, fp: str = "fp") -> Column:
        """Own bucket in each segment."""
        return F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), self._value(i, fp).alias("val")) for i in range(len(self.parts))]))

    def probes(self, fp: str = "fp") -> Column:
        """Every bucket in the balls of the own segments."""
        per = []
        for i, (_, _, bits, ball) in enumerate(self.parts):
            masks = [sum(1 << b for b in c) for n in range(ball + 1) for c in combinations(range(bits), n)]
            masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
            per.append(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), self._shifted(i, fp)))
        return F.explode(F.flatten(F.array(*per)))


def ball_size(bits: int, radius: int) -> int:
    return sum(math.comb(bits, n) for n in range(radius + 1))


def distance(a: str, b: str, lanes: int) -> Column:
    each = [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(lanes)]
    return sum(each[1:], each[0])


def _relabel(nodes: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    found = components(edges, folder).select(F.col("node").alias("_n"), "root")
    return save(nodes.join(found, F.col("comp") == F.col("_n"), "left").select(
        "id", "fp", F.coalesce("root", "comp").alias("comp")), f"{folder}/nodes")


def link_prints(
    nodes: DataFrame, segments: Segments, radius: int, lanes: int, folder: str, rounds: int = LEADER_ROUNDS,
    check: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """(id, comp) from fingerprints (id, fp): comp is the smallest id linked to it by steps within the radius.

    ``check`` takes pairs (id, comp, id2, comp2) within the radius and a folder, and gives the edges (a, b) between components that count.
    Without it all do; equal fingerprints should be one row then.
    """
    nodes, ids = nodes.withColumn("comp", F.col("id")), ["id"] if check else []

    def counted(pairs: DataFrame, at: str) -> DataFrame:
        return check(pairs, at) if check else pairs.select(F.col("comp").alias("a"), F.col("comp2").alias("b"))

    for turn in range(rounds):
        rows = nodes.select("id", "fp", "comp", segments.rows().alias("s")).select("id", "fp", "comp", "s.*")
        first = rows.groupBy("seg", "val").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("o"), "fp", "comp", *ids)).alias("f"))
        first = save(first.select(F.col("seg").alias("seg2"), F.col("val").alias("val2"), *[F.col(f"f.{c}").alias(f"{c}2") for c in ("fp", "comp", *ids)]), f"{folder}/leaders{turn}")
        near = (F.col("seg") == F.col("seg2")) & (F.col("val") == F.col("val2")) & (F.col("comp") != F.col("comp2")) & (distance("fp", "fp2", lanes) <= radius)
        nodes = _relabel(nodes, counted(rows.join(first, near), f"{folder}/checked{turn}"), f"{folder}/round{turn}")
    # One lane's segments at a time: the probes of a pass leave the disk before the next one, and find what it has linked.
    words = [F.get("fp", F.lit(i)) for i in range(lanes)]
    for lane in range(lanes):
        part = segments.of_lane(lane)
        table = nodes.select(part.rows().alias("s"), F.col("comp").alias("comp2"), *[F.col(c).alias(f"{c}2") for c in ids], *[w.alias(f"other{i}") for i, w in enumerate(words)])
        table = table.withColumns({"seg2": F.col("s.seg"), "val2": F.col("s.val")}).drop("s")
        probes = nodes.select(part.probes().alias("s"), "comp", *ids, *[w.alias(f"word{i}") for i, w in enumerate(words)]).select("s.*", "*").drop("s")
        # Either side of a pair finds it; the side with the larger component reports it.
        near = (F.col("seg") == F.col("seg2")) & (F.col("val") == F.col("val2")) & (F.col("comp2") < F.col("comp"))
        differing = [F.bit_count(F.col(f"word{i}").bitwiseXOR(F.col(f"other{i}"))) for i in range(lanes)]
        edges = probes.join(table, near & (sum(differing[1:], differing[0]) <= radius))
        nodes = _relabel(nodes, counted(edges, f"{folder}/found{lane}"), f"{folder}/lane{lane}")
    return nodes.select("id", "comp")


def near_groups(
    docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS, lanes: int = 1,
    segment_bits: int | None = None, ball: int = 1, folder: str | None = None,
) -> DataFrame:
    """Fingerprint documents and group those linked, by any number of steps, within ``radius`` differing bits.

    Returns one row per input row: ``key``, fp (array of signed 64-bit lanes), component_id (smallest key of the group; a
    null key is smaller than none, so a group of null keys alone has a null id). With one lane no link is lost. With
    more lanes, segments of ``segment_bits`` with balls of ``ball`` bits are searched: distances up to
    (ball + 1) * segments - 1 are always found, larger ones mostly. Null texts are empty, and empty texts have
    the fingerprint zero. Repeated rows share a fingerprint. An empty table gives an empty result; further columns of
    ``docs`` are ignored.
    """
    folder = folder or work_folder(docs.sparkSession, "simhash")
    prints = docs.select(F.col(key).alias("key"), fingerprints(F.col("text"), shingle, lanes).alias("fp"))
    prints = save(prints, f"{folder}/prints")
    nodes = prints.groupBy("fp").agg(F.min("key").alias("first"))
    # One lane is its own integer name; more lanes are named by position.
    name = F.get("fp", F.lit(0)) if lanes == 1 else F.monotonically_increasing_id()
    nodes = save(nodes.sortWithinPartitions("fp").withColumn("id", name), f"{folder}/nodes")
    segments = Segments.exact(nodes.count(), radius) if segment_bits is None else Segments.wide(lanes, segment_bits, ball)
    linked = link_prints(nodes.select("id", "fp"), segments, radius, lanes, f"{folder}/links")
    named = nodes.join(linked, "id")
    groups = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_print = save(named.join(groups, "comp").select(F.col("fp").alias("fp2"), "component_id"), f"{folder}/groups")
    return prints.join(by_print, F.col("fp") == F.col("fp2")).select(F.col("key").alias(key), "fp", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.get(fp, F.lit(0))), 16, "0"))
