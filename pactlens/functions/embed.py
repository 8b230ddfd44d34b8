"""Tokens, hashed embeddings and vector arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.constants import HASH_DIMENSION, NGRAM_DIMENSION, NGRAM_SIZES
from pactlens.packs.model import WS

Encoder = Callable[[list[str]], Sequence[Sequence[float]]]

# What a token is, and which tokens get character grams.
TOKEN = "[가-힣A-Za-z0-9]+"
HANGUL = "^[가-힣]+$"
GRAM_WIDTHS = (2, 3)


def _grams(word: Column, width: int, prefix: str) -> Column:
    cuts = F.transform(
        F.sequence(F.lit(1), F.length(word) - width + 1),
        lambda i: F.concat(F.lit(prefix), F.substring(word, i, F.lit(width))),
    )
    return F.when(F.length(word) >= width, cuts).otherwise(F.array().cast("array<string>"))


def tokenize(text: Column) -> Column:
    """Lower-case words in order, duplicates kept, then the Hangul grams of each Hangul word."""
    words = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.lower(w))
    grams = F.flatten(
        F.transform(
            F.filter(words, lambda w: w.rlike(HANGUL)),
            lambda w: F.concat(*[_grams(w, n, f"ko{n}:") for n in GRAM_WIDTHS]),
        )
    )
    return F.when(text.rlike("[가-힣]"), F.concat(words, grams)).otherwise(words)


def _hex(digest: Column, start: int, size: int) -> Column:
    return F.conv(F.substring(digest, start, size), 16, 10).cast("long")


def signed_codes(tokens: Column, dimension: int = HASH_DIMENSION) -> Column:
    """Each token as ``2 * bucket + sign bit`` from its SHA-256."""
    digests = F.transform(tokens, lambda t: F.substring(F.sha2(t, 256), 1, 10))
    return F.transform(digests, lambda d: ((_hex(d, 1, 8) % dimension) * 2 + _hex(d, 9, 2) % 2).cast("int"))


def ngram_codes(text: Column, dimension: int = NGRAM_DIMENSION) -> Column:
    """Unsigned bucket codes of the 2-, 3- and 4-grams of the lower-cased, whitespace-free text."""
    compact = F.lower(F.regexp_replace(text, WS, ""))

    def codes(width: int) -> Column:
        cuts = F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(compact) - width + 1, F.lit(1))),
            lambda i: (_hex(F.sha2(F.substring(compact, i, F.lit(width)), 256), 1, 8) % dimension * 2).cast("int"),
        )
        return F.when(F.length(compact) >= width, cuts).otherwise(F.array().cast("array<int>"))

    return F.concat(*[codes(n) for n in NGRAM_SIZES])


VECTORS_AT_A_TIME = 1024


def unit_matrix(codes: np.ndarray, sizes: np.ndarray, dimension: int) -> np.ndarray:
    """Unit vectors of code lists laid end to end, one flat count for many lists (an empty list gives zeros)."""
    sizes = np.nan_to_num(np.asarray(sizes, dtype=float)).astype(np.int64)
    ends, out = np.concatenate([[0], np.cumsum(sizes)]), np.zeros((len(sizes), dimension))
    for at in range(0, len(sizes), VECTORS_AT_A_TIME):
        part = sizes[at:at + VECTORS_AT_A_TIME]
        c = np.asarray(codes[ends[at]:ends[at + len(part)]], dtype=np.int64)
        flat = np.repeat(np.arange(len(part)) * dimension, part) + c // 2
        v = np.bincount(flat, weights=1.0 - 2.0 * (c % 2), minlength=len(part) * dimension).reshape(len(part), dimension)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        out[at:at + len(part)] = v / np.where(norm > 0, norm, 1.0)
    return out


def unit_vectors(lists, dimension: int) -> np.ndarray:
    """Unit vectors of code lists."""
    lists = [np.asarray(c, dtype=np.int64) for c in lists]
    return unit_matrix(np.concatenate([np.zeros(0, np.int64), *lists]), np.array([len(c) for c in lists], dtype=np.int64), dimension)


def dense(dimension: int) -> Callable[[Column], Column]:
    """Arrow UDF: code lists to unit vectors of ``dimension``."""

    @F.pandas_udf("array<double>")
    def to_vector(codes: pd.Series) -> pd.Series:
        return pd.Series(list(unit_vectors(codes, dimension)))

    return to_vector


def embed(text: Column, encoder: Encoder | None = None) -> Column:
    """Retrieval embedding: signed token hashing, or a user-supplied encoder."""
    return encoded(text, encoder) if encoder else dense(HASH_DIMENSION)(signed_codes(tokenize(text)))


def embed_ngrams(text: Column, encoder: Encoder | None = None) -> Column:
    """Candidate embedding: character n-gram hashing, or a user-supplied encoder."""
    return encoded(text, encoder) if encoder else dense(NGRAM_DIMENSION)(ngram_codes(text))


def encoded(text: Column, encoder: Encoder) -> Column:
    """Run a user-supplied encoder over Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype=float) for v in encoder(batch.tolist())])

    return run(text)


def dot(left: Column, right: Column) -> Column:
    """Dot product, summed left to right in double precision."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
