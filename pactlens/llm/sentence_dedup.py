"""Substring dedup by sliding sentence spans.

From every sentence on, the shortest run of consecutive sentences that has enough words is hashed. Runs meet globally by hash; all
but the first of equal runs are marked, and each sentence that a marked run covers is removed.

Where a sentence ends depends on the words just before only, so copies of a passage are cut alike whatever stands around them. A
stretch without full stops is cut after words that a hash picks; where no spaces part the words, each character is a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactlens.llm.common import keyed, save, whole_text, work_folder

WORDS = 20  # a run goes on until it has this many words; one long sentence can be a run
CALM = 12  # after this many words without a sentence's end, every word that the hash picks ends a piece
PICK = 4  # one word in so many is picked
POOL = 1 << 20  # runs that are compared inside a task before the shuffle
CACHE_WORDS = 300_000

_STOPS, _CLOSERS = tuple(".!?\u3002\uff01\uff1f\u2026"), "\"'`)]}\u00bb\u201d\u2019\u300d\u300f"
_SOLID = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"  # kana and ideographs, written without spaces
_HAS_SOLID = re.compile(f"[{_SOLID}]")
_SPACED_WORD, _SOLID_WORD = re.compile(r"\S+"), re.compile(rf"[{_SOLID}][^\w\s]*|[^\s{_SOLID}]+")
_BASE = 0x9E3779B97F4A7C17  # odd; hashes of runs are polynomials in it, modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


class Words(dict):
    """Word to its hash, A-Z lower-cased, whose last bits say that it ends a sentence (1) or may end a piece (2); with a bounded memory."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word.encode().lower(), 1)
        self[word] = value = h >> 2 << 2 | word.rstrip(_CLOSERS).endswith(_STOPS) | 2 * ((h >> 32) % PICK == 0)
        return value


def _split(text: str) -> list[str]:
    return text.split() if text.isascii() or not _HAS_SOLID.search(text) else _SOLID_WORD.findall(text)


def _ends(words: list[str], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words up to the end of each piece)."""
    n = len(words)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    stop, may = hashes & np.uint64(1) > 0, hashes & np.uint64(2) > 0
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(stop, at, -1)) if n else at
    end = stop | (may & (at - last > CALM))
    end[n - 1:] = True
    return hashes, np.flatnonzero(end) + 1


def sentences(text: str, known: Words | None = None) -> list[str]:
    """Pieces that end after a word with a stop, or after a picked word where no stop came for ``CALM`` words.

    White space after a piece belongs to it, white space at the start to the first one; joined, the pieces are the text.
    """
    matches = list((_SOLID_WORD if _HAS_SOLID.search(text) else _SPACED_WORD).finditer(text))
    _, ends = _ends([m[0] for m in matches], Words() if known is None else known)
    starts = [0] + [matches[e].start() for e in ends[:-1]]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)] if text else []


def run_hashes(text: str, known: Words, least: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first piece, pieces) of the shortest run of ``least`` words from each piece on.

    White space is not hashed, so line breaks inside a passage don't hide it.
    """
    hashes, ends = _ends(_split(text), known)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.concatenate([[0], ends])
    stops = np.searchsorted(bounds, bounds[:-1] + least)
    firsts = np.flatnonzero(stops < len(bounds))
    a, b = bounds[firsts], bounds[stops[firsts]]
    power = np.full(len(hashes) + 1, _BASE, np.uint64)
    back = np.full(len(hashes) + 1, _INVERSE, np.uint64)
    power[0] = back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(power)[:-1], dtype=np.uint64)])
    code = (sums[b] - sums[a]) * np.cumprod(back)[a] + (b - a).astype(np.uint64)
    return code, firsts.astype(np.int64), stops[firsts] - firsts


def spans(docs: DataFrame, least: int) -> DataFrame:
    """(code, row, pos, n, again) of all runs; again: an equal run comes earlier in the same pool."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, size, known = [], 0, Words()
        for batch in batches:
            for row, text in zip(batch["_row"], batch["text"], strict=True):
                code, pos, n = run_hashes(text, known, least)
                pool.append((code, np.full(len(code), row, np.int64), pos, n))
                size += len(code)
                if size > POOL:
                    yield settle(pool)
                    pool, size = [], 0
        if pool:
            yield settle(pool)

    def settle(pool: list) -> pd.DataFrame:
        code, row, pos, n = (np.concatenate(x) for x in zip(*pool, strict=True))
        order = np.lexsort((pos, row))
        code, row, pos, n = code[order], row[order], pos[order], n[order]
        again = np.ones(len(code), bool)
        again[np.unique(code, return_index=True)[1]] = False
        return pd.DataFrame({"code": code.view(np.int64), "row": row, "pos": pos, "n": n, "again": again})

    return docs.mapInPandas(extract, "code long, row long, pos long, n long, again boolean")


def remove_spans(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """Remove every sentence that a repeated, non-first run of sentences with ``least`` words or more covers.

    The first of equal runs is the one in the smallest doc_id (null first; equal ids in the order of text hashes), then
    at the earliest place; runs of one document can repeat as well. Null texts stay null, empty ones empty. Returns one row per
    row: _doc (the whole row as a struct, with the kept text), n_sentences, n_removed. An empty table gives an empty result.
    """
    folder = work_folder(docs.sparkSession, "sentences")
    rows = keyed(docs, f"{folder}/keyed")
    found = save(spans(rows.select("_row", whole_text().alias("text")), least), f"{folder}/spans")
    rank = F.row_number().over(W.partitionBy("code").orderBy("row", "pos"))  # a hot run is one row for each pool
    later = found.filter("NOT again").withColumn("rank", rank).filter("rank > 1").select("row", "pos", "n")
    marked = later.unionByName(found.filter("again").select("row", "pos", "n"))
    marks = marked.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("pos", "n")).alias("marks"))

    @F.pandas_udf("kept string, n_sentences long, n_removed long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = Words()
        for texts, lists in batches:
            out = []
            for text, spans in zip(texts, lists, strict=True):
                if spans is None:  # nothing goes
                    out.append((text, max(len(_ends(_split(text), known)[1]), int(text != "")), 0))
                    continue
                pieces = sentences(text, known)
                gone = np.zeros(len(pieces) + 1, np.int64)
                for m in spans:
                    gone[m["pos"]] += 1
                    gone[m["pos"] + m["n"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                kept = "".join(p for p, g in zip(pieces, gone.tolist(), strict=True) if not g)
                out.append((kept, len(pieces), int(gone.sum())))
            yield pd.DataFrame(out, columns=["kept", "n_sentences", "n_removed"])

    joined = rows.select("_row", "_doc", whole_text().alias("text")).join(save(marks, f"{folder}/marks"), "_row", "left")
    done = joined.select("_doc", cut("text", "marks").alias("c"))
    text = F.when(F.col("_doc.text").isNotNull(), F.col("c.kept"))
    return done.select(F.col("_doc").withField("text", text).alias("_doc"), "c.n_sentences", "c.n_removed")
