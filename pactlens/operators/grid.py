"""Every streamed row meets every block of another table: a grid of cells, dealt out by Spark.

For scores that have no join key. The blocked side is cut into blocks that fit in a task. Each block meets the whole streamed side, in
several cells where there are fewer blocks than tasks. The same plan serves one block and thousands; nothing passes through
the driver and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Build = Callable[[pa.Table], Any]
Score = Callable[[Any, pa.RecordBatch], Iterator[pa.RecordBatch]]


def block_count(rows: int, block_rows: int) -> int:
    return max(1, -(-rows // block_rows))


def meet(
    blocked: DataFrame, streamed: DataFrame, block: Column, blocks: int, order: Sequence[str], stream_key: Sequence[str],
    build: Build, score: Score, schema: str,
) -> DataFrame:
    """Run ``score(build(block), rows)`` for every block and every batch of streamed rows.

    ``block`` numbers the rows of ``blocked`` from 0 to ``blocks`` - 1; they arrive in ``build`` sorted by ``order``. Streamed rows
    are dealt by a hash of ``stream_key`` and pass by in batches in its order, so a cell holds one block and one batch. A streamed row is
    copied once for each block, a blocked row once for each of a block's cells.
    """
    tasks = int(blocked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, tasks // blocks)
    sides = {"b": F.struct(*blocked.columns), "s": F.struct(*streamed.columns)}
    left = blocked.select(sides["b"].alias("b"), block.cast("int").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_l"))
    lane = F.pmod(F.xxhash64(*stream_key), F.lit(lanes)).cast("int")
    right = streamed.select(sides["s"].alias("s"), lane.alias("_l"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    cell = (F.col("_b") * lanes + F.col("_l")).alias("cell")
    rows = left.select(cell, F.lit(0).alias("kind"), "b").unionByName(right.select(cell, F.lit(1).alias("kind"), "s"), allowMissingColumns=True)
    dealt = rows.repartitionById(blocks * lanes, "cell").sortWithinPartitions("cell", "kind", *[f"b.{c}" for c in order], *[f"s.{c}" for c in stream_key])
    return dealt.mapInArrow(_by_cell(build, score), schema)


def runs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The number of each row's run of equal values."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    codes = whole.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(np.diff(codes) != 0)]) if len(codes) else codes


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows as tables that cut no run of equal ``key``; one run must fit in memory."""
    held = None
    for batch in batches:
        if batch.num_rows:
            part = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, part]) if held is not None else part
            number = runs(rows.column(key))
            last = int(np.searchsorted(number, number[-1]))
            if last:
                yield rows.slice(0, last)
            held = rows.slice(last)
    if held is not None:
        yield held


def _fields(column: pa.StructArray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(column.flatten(), [f.name for f in column.type])


def _by_cell(build: Build, score: Score) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ready = None, [], None
        for batch in batches:
            at = batch.column("cell").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if at[a] // 2 != cell:
                    cell, held, ready = at[a] // 2, [], None
                part = batch.slice(a, z - a)
                if at[a] % 2 == 0:
                    held.append(_fields(part.column("b")))
                elif held:
                    if ready is None:
                        ready = build(pa.Table.from_batches(held).combine_chunks())
                    yield from score(ready, _fields(part.column("s")))

    return run
