"""Exact nearest rows by dot product, keeping only the best few per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.constants import HASH_DIMENSION
from pactlens.functions.embed import unit_matrix
from pactlens.operators.grid import block_count, meet
from pactlens.operators.prefix import top_rows

# Index rows that a task holds, and queries that are scored at a time.
TILE_ROWS = 8_192
QUERY_ROWS = 256
ORDER_DIGITS = 9


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix of doubles."""
    lists = _one(column)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _body(rows: pa.Table | pa.RecordBatch, dimension: int) -> np.ndarray:
    if "codes" not in rows.schema.names:
        return vectors(rows.column("vec"))
    lists = _one(rows.column("codes"))
    return unit_matrix(lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False), dimension)


class Postings:
    """Posting lists of a block's tokens: for each token the items that hold it, and how often."""

    def __init__(self, tokens: pa.ListArray):
        self.length = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        self.at = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        item = np.repeat(np.arange(len(tokens)), self.length)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, self.often = np.unique(code * max(len(tokens), 1) + item, return_counts=True)
        self.item = pairs % max(len(tokens), 1)
        self.begin = np.searchsorted(pairs // max(len(tokens), 1), np.arange(len(self.at) + 1))
        self.row = np.full(len(tokens), -1)

    def shared(self, tokens: list[str], items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``items``, place in ``tokens``, frequency) of the query's tokens in its items, by row."""
        known = [(i, self.at[t]) for i, t in enumerate(tokens) if t in self.at]
        if not known or not len(items):
            return (np.zeros(0, np.int64),) * 3
        place, code = np.array(known).T
        size = self.begin[code + 1] - self.begin[code]
        at = np.repeat(self.begin[code] - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.row[items] = np.arange(len(items))
        row = self.row[self.item[at]]
        self.row[items] = -1
        hit = np.flatnonzero(row >= 0)
        order = hit[np.argsort(row[hit], kind="stable")]
        return row[order], np.repeat(place, size)[order], self.often[at[order]]


class Block:
    """Index rows of one block in the order of their items."""

    def __init__(self, rows: pa.Table, dimension: int, carry: Sequence[str] = ()):
        self.carried = [_one(rows.column(c)) for c in carry]
        self.items, self.grp = _one(rows.column("item_id")), _one(rows.column("grp"))
        groups = self.grp.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        self.groups = [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]
        self.matrix = _body(rows, dimension)
        self.postings = Postings(_one(rows.column("tokens"))) if "tokens" in rows.schema.names else None

    def best(self, q: np.ndarray, top_n: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item place, score) of the best ``top_n`` items for each query and group, by query."""
        scores = q @ self.matrix.T
        keys = np.round(scores, ORDER_DIGITS)
        picked = [c[np.argsort(-keys[:, c], axis=1, kind="stable")[:, :top_n]] for c in self.groups]
        place = np.concatenate(picked, axis=1)
        flat = np.take_along_axis(scores, place, axis=1).ravel()
        query, place = np.repeat(np.arange(len(q)), place.shape[1]), place.ravel()
        if floor is not None:
            keep = flat >= floor
            query, place, flat = query[keep], place[keep], flat[keep]
        return query, place, flat


_SHARED = pa.struct([("t", pa.int32()), ("f", pa.int32())])


def _lists(rows: list[tuple[np.ndarray, ...]], counts: list[np.ndarray]) -> pa.ListArray:
    place, often = (np.concatenate([np.zeros(0, np.int64), *[r[i] for r in rows]]) for i in (1, 2))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))])
    pairs = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(often, pa.int32())], fields=list(_SHARED))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


def nearest(
    queries: DataFrame, index: DataFrame, top_n: int, floor: float | None = None,
    tile_rows: int | None = None, dimension: int = HASH_DIMENSION, carry: Sequence[str] = (),
) -> DataFrame:
    """Top ``top_n`` index rows per query and group: (query_id, item_id, grp, score).

    ``queries`` has (query_id, vec) and ``index`` (item_id, grp, vec). Instead of ``vec`` both may carry
    hash ``codes``, which are much smaller to move and become vectors only inside the scoring task. Ties at nine digits go to
    the lower item. The index is dealt into blocks of about ``tile_rows`` rows and every query meets every block in
    the cells of :func:`~pactlens.operators.grid.meet`; the best rows of several blocks are merged exactly.

    With ``tokens`` on both sides (different ones in a query) each row also has ``length``, the tokens of its item, and ``shared``, the place in the
    query's tokens and the frequency in the item of what both have. It is read off the block's posting lists for the
    best rows only, so token lists never travel with pairs; the rows of a query come together then. Columns of the index named in
    ``carry`` come with its rows.
    """
    coded, lexical = "codes" in index.columns, "tokens" in index.columns and "tokens" in queries.columns
    body = ["codes" if coded else "vec"] + ["tokens"] * lexical
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema, *index.schema]}
    schema = f"query_id {types['query_id']}, item_id {types['item_id']}, grp {types['grp']}, score double"
    schema += "".join(f", `{c}` {types[c]}" for c in carry) + ", length bigint, shared array<struct<t:int,f:int>>" * lexical
    names = ["query_id", "item_id", "grp", "score", *carry] + ["length", "shared"] * lexical

    def score(block: Block, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, rows.num_rows, QUERY_ROWS):
            part = rows.slice(at, QUERY_ROWS)
            query, place, scores = block.best(_body(part, dimension), top_n, floor)
            columns = [part.column("query_id").take(pa.array(query)), block.items.take(pa.array(place)), block.grp.take(pa.array(place)), pa.array(scores)]
            columns += [c.take(pa.array(place)) for c in block.carried]
            if lexical:
                cuts = np.searchsorted(query, np.arange(part.num_rows + 1))
                found = [block.postings.shared(t or [], place[a:z]) for t, a, z in zip(part.column("tokens").to_pylist(), cuts[:-1], cuts[1:], strict=True)]
                counts = [np.bincount(f[0], minlength=z - a) for f, a, z in zip(found, cuts[:-1], cuts[1:], strict=True)]
                columns += [pa.array(block.postings.length[place]), _lists(found, counts)]
            yield pa.RecordBatch.from_arrays(columns, names)

    blocks = block_count(index.count(), tile_rows or TILE_ROWS)
    out = meet(
        index.select("item_id", "grp", *body, *carry), queries.select("query_id", *body), F.pmod(F.xxhash64("item_id"), F.lit(blocks)), blocks,
        ["item_id", "grp"], ["query_id"], lambda rows: Block(rows, dimension, carry), score, schema,
    )
    order = [F.round("score", ORDER_DIGITS).desc(), F.col("item_id")]
    if blocks == 1:
        return out
    merged = top_rows(out, ["query_id", "grp"], order, top_n, "_r").drop("_r")
    return merged.repartition("query_id").sortWithinPartitions("query_id") if lexical else merged
