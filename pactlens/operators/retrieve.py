"""Hybrid evidence retrieval: vector pool, pool-local BM25, authority, then a final ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from pactlens.constants import (
    AUTHORITY_WEIGHT, BM25_B, BM25_K1, DEFAULT_AUTHORITY, LEXICAL_WEIGHT, VECTOR_WEIGHT,
)
from pactlens.functions.embed import Encoder, embed, signed_codes, tokenize
from pactlens.operators.grid import runs, whole_runs
from pactlens.operators.similar import nearest


def shared_tokens(pool: DataFrame, query_tokens: DataFrame, item_tokens: DataFrame) -> DataFrame:
    """Add ``length`` and ``shared`` to (query_id, item_id, ...) pairs that did not come from ``nearest``; here ``t`` is the token itself.

    ``query_tokens`` and ``item_tokens`` carry array columns; pass only items that pairs may name.
    """
    counts = item_tokens.select("item_id", F.explode_outer("tokens").alias("_t")).groupBy("item_id", "_t").agg(F.count("_t").cast("int").alias("_f"))
    # Token frequencies once per item; an item's own text bounds its map.
    items = counts.groupBy("item_id").agg(
        F.sum("_f").cast("long").alias("length"),
        F.map_from_entries(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_t", "_f")))).alias("_freq"),
    )
    wanted = query_tokens.select("query_id", F.array_distinct("tokens").alias("_qt"))
    pairs = pool.join(items, "item_id").join(wanted, "query_id", "left")
    both = F.array_intersect(F.coalesce("_qt", F.array().cast("array<string>")), F.map_keys("_freq"))
    return pairs.withColumn("shared", F.transform(both, lambda t: F.struct(t.alias("t"), F.element_at("_freq", t).alias("f")))).drop("_freq", "_qt")


def bm25(pool: DataFrame, gathered: bool = False) -> DataFrame:
    """Turn ``length`` and ``shared`` into ``lexical``: BM25 within each (query_id, grp) pool, divided by the pool's best score.

    ``pool`` rows are (query_id, grp, item_id, length, shared, ...), already cut to the pool size. Pools pass through the task in batches, so it
    never holds more than a batch and the rows of one query. ``gathered`` says that the rows of a query already come together, as
    :func:`~pactlens.operators.similar.nearest` gives them with tokens; others are brought together first.
    """
    base = [c for c in pool.columns if c not in ("length", "shared")]
    schema = StructType([StructField(f.name, f.dataType) for f in pool.schema if f.name in base] + [StructField("lexical", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "query_id"):
            first, lexical = _lexical(rows)
            yield from rows.select(base).take(pa.array(first)).append_column("lexical", pa.array(lexical)).to_batches()

    together = pool if gathered else pool.repartition("query_id").sortWithinPartitions("query_id")
    return together.mapInArrow(run, schema)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * (int(b.max(initial=0)) + 1) + b


def _lexical(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each item in its pool, and its share of the pool's best BM25 score."""
    pool = np.unique(_pairs(runs(rows.column("query_id")), _codes(rows.column("grp"))), return_inverse=True)[1]
    length = rows.column("length").to_numpy().astype(float)
    n = np.bincount(pool)
    average = np.bincount(pool, length) / n
    lists = rows.column("shared").combine_chunks()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    token, often = lists.flatten().flatten()
    held = _pairs(pool[row], _codes(pa.chunked_array([token])))
    _, at, counts = np.unique(held, return_inverse=True, return_counts=True)
    weight = bm25_term(often.to_numpy(zero_copy_only=False).astype(float), length[row], average[pool[row]], n[pool[row]], counts[at])
    _, first, item = np.unique(_pairs(pool, _codes(rows.column("item_id"))), return_index=True, return_inverse=True)
    total = np.bincount(item[row], weight, minlength=len(first))
    best = np.zeros(len(n))
    np.maximum.at(best, pool[first], total)
    top = best[pool[first]]
    order = np.argsort(first)
    return first[order], np.where(top > 0, total / np.where(top > 0, top, 1.0), 0.0)[order]


def bm25_term(tf: np.ndarray, length: np.ndarray, average: np.ndarray, n: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Weights of tokens in documents."""
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / average))


def best_of_query(scored: DataFrame, top_k: int) -> DataFrame:
    """(query_id, rank, item_id, grp, relevance_score): the ``top_k`` items of each query whose rows come together; an item counts in its last group.

    Order: relevance_score, then grp, then the vector score at nine digits, then item_id.
    """
    kinds = {f.name: f.dataType for f in scored.schema}
    schema = StructType([StructField(c, kinds.get(c, IntegerType())) for c in ("query_id", "rank", "item_id", "grp", "relevance_score")])
    order = [("_q", "ascending"), ("relevance_score", "descending"), ("grp", "ascending"), ("_near", "descending"), ("item_id", "ascending")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "query_id"):
            rows = rows.append_column("_q", pa.array(runs(rows.column("query_id"))))
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("_q", "ascending"), ("item_id", "ascending"), ("grp", "descending")], null_placement="at_start"))
            item = runs(pa.array(_pairs(rows.column("_q").to_numpy(), _codes(rows.column("item_id")))))
            rows = rows.take(pa.array(np.flatnonzero(np.diff(item, prepend=-1))))
            rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
            query = rows.column("_q").to_numpy()
            rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
            ranked = rows.append_column("rank", pa.array(rank, pa.int32())).select(schema.names)
            yield from ranked.filter(pa.array(rank <= top_k)).to_batches()

    return scored.withColumn("_near", F.round("vector_score", 9)).mapInArrow(run, schema)


def pool_size(top_k: int) -> int:
    """How many vector neighbours are re-ranked per collection."""
    return max(4 * top_k, 20)


def hybrid_search(
    queries: DataFrame, index: DataFrame, top_k: int = 5,
    weights: tuple[float, float, float] = (VECTOR_WEIGHT, LEXICAL_WEIGHT, AUTHORITY_WEIGHT),
    encoder: Encoder | None = None, tile_rows: int | None = None,
) -> DataFrame:
    """Ranked evidence per query over all collections.

    ``queries`` is (query_id, text). ``index`` has evidence_id, collection, collection_ord, text,
    authority_weight and any metadata columns; an ``embedding`` column is used when present.
    The same evidence id in several collections counts once, with the last collection's values.
    """
    def body(text: Column) -> Column:
        return embed(text, encoder).alias("vec") if encoder else signed_codes(tokenize(text)).alias("codes")

    stored = "embedding" in index.columns
    vec = F.col("embedding").alias("vec") if stored else body(F.col("text"))
    wanted_vec = embed(F.col("text"), encoder).alias("vec") if stored else body(F.col("text"))
    tokens = tokenize(F.col("text"))
    keys = [F.col("evidence_id").alias("item_id"), F.col("collection_ord").alias("grp")]
    # Ranks need one number of an item, which comes with the pool; what is shown joins the few rows that stay.
    weight = F.coalesce("authority_weight", F.lit(DEFAULT_AUTHORITY)).alias("_auth")
    pool = nearest(
        queries.select("query_id", wanted_vec, F.array_distinct(tokens).alias("tokens")), index.select(*keys, vec, tokens.alias("tokens"), weight),
        pool_size(top_k), tile_rows=tile_rows, carry=["_auth"],
    ).withColumnRenamed("score", "vector_score")
    wv, wl, wa = weights
    scored = bm25(pool, gathered=True).withColumn(
        "relevance_score",
        F.round(
            F.lit(wv) * F.greatest("vector_score", F.lit(0.0)) + F.lit(wl) * F.col("lexical") + F.lit(wa) * F.col("_auth"), 6
        ),
    )
    ranked = best_of_query(scored, top_k)
    shown = [c for c in index.columns if c not in ("evidence_id", "collection", "collection_ord", "authority_weight", "embedding", "text")]
    meta = index.select(*keys, "collection", *shown, F.col("text").alias("quoted_excerpt"))
    return ranked.join(meta, ["item_id", "grp"]).select(
        "query_id", "rank", F.col("item_id").alias("evidence_id"), "collection", *shown, "quoted_excerpt", "relevance_score"
    )


#: Evidence fields beside rank and evidence_id, and what evidence derived from a rule has in them.
EVIDENCE_FIELDS = {
    "title": "string", "authority": "string", "source_url": "string", "quoted_excerpt": "string", "relevance_score": "double",
    "collection": "string", "status": "string", "manifest_version": "string",
}


def attach_evidence(findings: DataFrame, hits: DataFrame, keys: list[str], doc_rule: str = "rule_id") -> DataFrame:
    """Give each finding its clause's evidence, or candidates derived from the rule when none came.

    ``hits`` is (keys..., rank, evidence_id and any of ``EVIDENCE_FIELDS``); at most a few rows per
    clause. A clause without hits is ``unavailable``, never an error.
    """
    kept = [(F.col(c) if c in hits.columns else F.lit(None)).cast(kind).alias(c) for c, kind in EVIDENCE_FIELDS.items()]
    per_clause = hits.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "evidence_id", *kept))).alias("_hits")
    )
    derived = F.transform(
        "legal_basis",
        lambda b, i: F.struct(
            (i + 1).alias("rank"),
            F.concat_ws(":", F.lit("candidate"), F.col(doc_rule), (i + 1).cast("string")).alias("evidence_id"),
            *[
                (b if c == "title" else F.lit("candidate_unverified" if c == "status" else None)).cast(kind).alias(c)
                for c, kind in EVIDENCE_FIELDS.items()
            ],
        ),
    )
    versions = F.array_sort(
        F.array_distinct(F.transform("_hits", lambda h: F.coalesce(h["manifest_version"], F.lit("unknown"))))
    )
    return (
        findings.join(per_clause, keys, "left")
        .withColumn("evidence", F.coalesce("_hits", derived))
        .withColumn("grounding", F.when(F.col("_hits").isNotNull(), "grounded").otherwise("unavailable"))
        .withColumn("retrieved_count", F.coalesce(F.size("_hits"), F.lit(0)))
        .withColumn("corpus_version", F.coalesce(F.array_join(versions, ","), F.lit("not_available")))
        .drop("_hits")
    )


def corpus_version(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Comma-joined sorted manifest versions per key."""
    return evidence.groupBy(*keys).agg(
        F.array_join(
            F.array_sort(F.collect_set(F.coalesce("manifest_version", F.lit("unknown")))), ","
        ).alias("corpus_version")
    )


def first_relevant(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """Rank of the first expected evidence per case (NULL when none was retrieved)."""
    expected = judgments.select(
        F.col("case_id").alias("query_id"), F.explode("expected_evidence_ids").alias("evidence_id")
    ).distinct()
    found = hits.join(expected, ["query_id", "evidence_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return judgments.select(F.col("case_id"), F.col("case_id").alias("query_id")).join(found, "query_id", "left").select(
        "case_id", "rank"
    )


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """Case count, hit rate and mean reciprocal rank; zero for an empty set."""
    return ranks.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.round(F.coalesce(F.avg(F.col("rank").isNotNull().cast("double")), F.lit(0.0)), 6).alias("hit_at_k"),
        F.round(F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"),
    )
