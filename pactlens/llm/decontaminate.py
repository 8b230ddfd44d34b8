"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; up to three names or numbers in a row are one placeholder. Windows of the
templates are made in tasks and written as tables. Those of the documents pass a Bloom filter of the benchmark's windows and
meet them in a hash join; windows of one alignment are read in order and become a match, whose slots must be consistent: one
value of the item stands for one value of the document and the other way round. So questions with other numbers and names are
caught, and texts that only share a pattern are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import remove, save, whole_text, work_folder

WINDOW = 8
LEAST = 13  # template tokens of a match; a shorter item must match whole
LITERALS = 0.5  # share of a match that must be words and not placeholders, where any slot has another value
WHOLE = 0.8  # share of the item that a stretch must cover if its slots clash with the ones beside it
SHORT = 5  # an item of fewer tokens is found only where it is the whole text
RUN = 3  # names or numbers in a row that are one placeholder; longer runs, as in headings and tables, stay apart
FILTER_WORDS = 1 << 20  # 64-bit words of the Bloom filter at most: 8 MB on the driver and in each worker
PIECE = 20_000  # windows that leave a worker at a time
CACHE_WORDS = 200_000

UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb ml cl l s sec min h hr hrs ms km/h mph hz khz mhz ghz w kw mw v a ma pa kpa bar "
    "j kj cal kcal c f k % $ usd eur gbp percent dollars dollar euros euro cents cent pounds pound meters meter metres metre "
    "kilometers kilometer miles mile feet foot inches inch grams gram kilograms kilogram tons ton liters liter litres litre "
    "seconds second minutes minute hours hour days day weeks week months month years year degrees degree"
).split()
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:[eE][+-]?\d+)?(%|[^\W\d_]{0,3})")
_EDGE = "\"'`.,;:!?()[]{}<>«»“”‘’*_"
NUMBER, NAME, UNIT, START = 1, 2, 3, 4  # START: a capitalised word at a sentence start, a name or not
_CODES = {NUMBER: np.uint64(0x5851F42D4C957F2D), NAME: np.uint64(0x14057B7EF767814F), UNIT: np.uint64(0x2545F4914F6CDD1D), START: np.uint64(0x632BE59BD9B4E019)}
_KINDS = {int(code): kind for kind, code in _CODES.items()}
_B = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)  # a run's values are added up, each times its place's factor


class Words:
    """What is known of a word by itself, computed once for each word and worker."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.at.clear()
        self.value, self.flags = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)

    def look(self, word: str) -> int:
        import xxhash

        bare = word.strip(_EDGE)
        low = bare.lower()
        number = _NUMBER.fullmatch(bare)
        flags = (1 if number and (number[1] in ("", "%") or number[1].lower() in UNITS) else 0)
        flags |= 2 * (low in UNITS) | 4 * bare[:1].isupper() | 8 * (word[-1] in ".,;:!?)") | 16 * (word.rstrip("\"'”’)»")[-1:] in tuple(".!?:"))
        at = self.at[word] = len(self.at)
        if at == len(self.value):
            self.value, self.flags = np.resize(self.value, 2 * at), np.resize(self.flags, 2 * at)
        self.value[at], self.flags[at] = xxhash.xxh64_intdigest(low.encode()), flags
        return at

    def template(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(codes, values) of the template's tokens. A name is a capitalised word; a unit follows a number."""
        words = text.split()
        if len(self.at) > CACHE_WORDS:
            self.clear()
        known, look = self.at, self.look
        at = np.fromiter((known[w] if w in known else look(w) for w in words), np.int64, len(words))
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        value, flags = self.value[at], self.flags[at]
        number = flags & 1 > 0
        unit = (flags & 2 > 0) & np.append(False, number[:-1]) & ~number
        name = (flags & 4 > 0) & ~number & ~unit
        start = name & np.append(True, flags[:-1] & 16 > 0)
        codes = np.where(number, _CODES[NUMBER], np.where(unit, _CODES[UNIT], np.where(start, _CODES[START], np.where(name, _CODES[NAME], value))))
        # A run of one type goes on unless a mark ends the word before.
        goes_on = np.append(False, ((number[1:] & number[:-1]) | (name[1:] & name[:-1])) & (flags[:-1] & 24 == 0))
        starts = np.flatnonzero(~goes_on)
        lengths = np.diff(np.append(starts, len(at)))
        longer = lengths > 1
        if not longer.any():
            return codes, value
        split = np.repeat(lengths > RUN, lengths)
        starts = np.flatnonzero(~goes_on | split)
        place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        return codes[starts], np.add.reduceat(value * _POWERS[place], starts)


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _B + codes[i:i + n]
    return out ^ (out >> np.uint64(29))


def filter_bits(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits) of keys in a Bloom filter whose blocks are words of 64 bits; ``words`` is a power of two."""
    mixed = (keys ^ (keys >> np.uint64(32))) * _B
    bits = np.zeros(len(keys), np.uint64)
    for shift in (40, 46, 52):
        bits |= np.uint64(1) << (mixed >> np.uint64(shift) & np.uint64(63))
    return (mixed & np.uint64(words - 1)).astype(np.int64), bits


_WINDOWS = "uid long, id string, n int, size int, key long, place int, codes binary, vals binary"


def template_windows(texts: DataFrame, filters: dict[int, np.ndarray] | None = None) -> DataFrame:
    """Windows of (uid, id, text): the size that the text's length sets, or, with ``filters``, all of each size that pass."""
    names = [c.split()[0] for c in _WINDOWS.split(", ")]

    def frame(parts: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: list(chain.from_iterable(x)) for c, x in zip(names, zip(*parts, strict=True), strict=True)})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, parts, held = Words(), [], 0
        for batch in batches:
            for uid, key, text in zip(batch["uid"], batch["id"], batch["text"], strict=True):
                codes, values = words.template(text)
                n = len(codes)
                for size in filters if filters is not None else [min(WINDOW, n)] if n else []:
                    if filters is not None and size < SHORT and size != n:
                        continue
                    keys = windows(codes, size)
                    at = np.arange(len(keys))
                    if filters is not None and len(keys):
                        word, bits = filter_bits(keys, len(filters[size]))
                        at = np.flatnonzero(filters[size][word] & bits == bits)
                    for i in range(0, len(at), PIECE):
                        part = at[i:i + PIECE]
                        each = part[:, None] + np.arange(size)
                        cells = ([x.tobytes() for x in m[each]] for m in (codes, values))
                        parts.append(([uid] * len(part), [key] * len(part), [n] * len(part), [size] * len(part), keys[part].view(np.int64).tolist(), part.tolist(), *cells))
                        held += len(part)
                        if held >= PIECE:
                            yield frame(parts)
                            parts, held = [], 0
        if parts:
            yield frame(parts)

    return texts.mapInPandas(cut, _WINDOWS)


def window_filters(items: DataFrame) -> dict[int, np.ndarray]:
    """A Bloom filter for each window size of the benchmark; three bits a key, and no more than ``FILTER_WORDS`` words in each."""
    out = {}
    for size, n in sorted(items.groupBy("size").agg(F.approx_count_distinct("key")).collect()):
        words = 64
        while words < FILTER_WORDS and 4 * words < n:
            words *= 2

        def mark(batches: Iterator[pd.DataFrame], words=words) -> Iterator[pd.DataFrame]:
            for batch in batches:
                word, bits = filter_bits(batch["key"].to_numpy(np.int64).view(np.uint64), words)
                yield pd.DataFrame({"word": word, "bits": bits.view(np.int64)})

        marks = items.filter(F.col("size") == size).select("key").mapInPandas(mark, "word long, bits long")
        marks = marks.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        table = np.zeros(words, np.uint64)
        table[marks["word"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64).view(np.uint64)
        out[int(size)] = table
    return out


class Alignment:
    """A document and an item laid side by side, read from left to right, and the best stretch whose slots map one to one."""

    def __init__(self, n_item: int, least: int, share: float):
        self.n_item, self.least, self.share = n_item, least, share
        self.best: tuple[int, int, int] | None = None
        self.start(False)

    def start(self, torn: bool) -> None:
        self.there, self.back, self.torn = {}, {}, torn
        self.length = self.slots = self.changed = self.literals = 0

    def add(self, code: int, item: int, doc: int) -> None:
        kind = _KINDS.get(code)
        if kind:
            first, kind = kind == START, NAME if kind == START else kind
            if first and item != doc and not self.changed:
                self.close(False)  # another sentence may begin here
            if self.there.get((kind, item), doc) != doc or self.back.get((kind, doc), item) != item:
                self.close(not first)
                self.start(not first)
            self.there[kind, item], self.back[kind, doc] = doc, item
            self.changed += item != doc
        if kind and not (first and item == doc):
            self.slots += 1
        else:
            self.literals += 1
        self.length += 1

    def close(self, torn: bool) -> None:
        need = max(min(self.least, self.n_item), WHOLE * self.n_item if torn or self.torn else 0)
        if self.length >= max(need, 1) and (not self.changed or self.literals >= self.share * self.length):
            self.best = max(self.best or (0, 0, 0), (self.length, self.slots, self.changed))


def matches(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = LITERALS) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_slots, n_changed): the longest match of each benchmark item in each document.

    A capitalised word at a sentence start counts as a plain word where it is unchanged, and as a name where it is not; if it clashes
    with the names so far, another sentence begins there and the match ends. A match has ``least`` template tokens (or is the whole item, if that is shorter); where slots have other values, ``share`` of
    it must be plain words. Where slots clash, the stretch up to there counts only if it covers ``WHOLE`` of the item. Items of
    fewer than ``SHORT`` tokens match only a document that is nothing else. Null and empty texts match nothing, null items are skipped. Of equally long
    matches the one with more slots, then more changed ones, is given. Repeated rows give repeated results; null ids are returned
    as null; long texts are compared whole; further columns are ignored; an empty table or benchmark gives no rows.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "templates")
    uid = F.monotonically_increasing_id().alias("uid")
    kept = benchmark.filter("text IS NOT NULL").select(uid, F.col("item_id").cast("string").alias("id"), "text")
    items = save(template_windows(kept), f"{folder}/items")
    shared = window_filters(items)
    texts = docs.select(uid, F.col("doc_id").cast("string").alias("id"), whole_text().alias("text"))
    # The ids of rows hold once they are written.
    own = save(template_windows(texts, shared), f"{folder}/documents")
    right = items.select("size", "key", F.col("codes").alias("_codes"), F.col("uid").alias("item"), F.col("id").alias("item_id"), F.col("n").alias("n_item"), F.col("place").alias("at"), F.col("vals").alias("item_vals"))
    met = own.join(right, ["size", "key"]).filter((F.col("codes") == F.col("_codes")) & ((F.col("size") >= SHORT) | (F.col("n") == F.col("n_item"))))
    met = met.select("uid", "item", (F.col("place") - F.col("at")).alias("diagonal"), "place", "id", "item_id", "n_item", "codes", "vals", "item_vals")
    columns = ["doc_id", "item_id", "n_tokens", "n_slots", "n_changed"]

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = ids = diagonal = end = now = None
        out = []
        for batch in batches:
            for u, item, d, place, key, item_id, n_item, codes, vals, item_vals in batch.itertuples(index=False, name=None):
                if pair != (u, item):
                    if now is not None:
                        now.close(False)
                        if now.best:
                            out.append((*ids, *now.best))
                    pair, ids, diagonal, now = (u, item), (key, item_id), None, Alignment(n_item, least, share)
                if d != diagonal or place > end:
                    if diagonal is not None:
                        now.close(False)
                    now.start(False)
                    diagonal, end = d, place
                c, b, a = (np.frombuffer(x, np.uint64).tolist() for x in (codes, vals, item_vals))
                for i in range(end - place, len(c)):
                    now.add(c[i], a[i], b[i])
                end = place + len(c)
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if now is not None:
            now.close(False)
            if now.best:
                yield pd.DataFrame([(*ids, *now.best)], columns=columns)

    ordered = met.repartition("uid").sortWithinPartitions("uid", "item", "diagonal", "place")
    found = save(ordered.mapInPandas(align, "doc_id string, item_id string, n_tokens long, n_slots long, n_changed long"), f"{folder}/found")
    for name in ("items", "documents"):
        remove(spark, f"{folder}/{name}")
    return found.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "item_id")})
