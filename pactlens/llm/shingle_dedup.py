"""Near copies by the exact similarity of shingle sets.

Two texts are near copies if the Jaccard similarity of their sets of word shingles reaches a bound. First the SimHash fingerprints
of the sets are searched by multi-index hashing, which finds close copies. Fingerprints can't tell 0.8 from 0.7 within a searchable
radius, so farther pairs are found as well: they share a band of min-hashes. Pairs whose set sizes rule the bound out, or too few of
whose min-hashes agree, go no further; the similarity of all others is computed from both texts. Equal sets are one node throughout. Before the pairs of a bucket are compared, its
nodes are compared with leaders of the bucket, first the nodes that share most buckets with others: the originals of
copies. Pairs that are linked by then are not made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import remove, save, work_folder
from pactlens.llm.components import components
from pactlens.llm.simhash import RADIUS, SEED, Segments, _remix, link_prints, print_of, shingle_hashes

LEAST = 0.8
BANDS, DEPTH = 28, 4  # a pair at 0.8 shares no band in (1 - 0.8**4)**28 = 4e-7 of cases
LEADER_ROUNDS = 2
#: Of the 112 min-hashes at least so many must agree, by their last byte; a pair at 0.8 has fewer in 3e-6 of cases.
AGREE = 70
WORDS = BANDS * DEPTH // 8


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketch(text: str | None, shingle: int) -> tuple[bytes, list[int], int, list[int], list[int]]:
    """A 128-bit name of the shingle set, the hash of each band of min-hashes, its size, the last bytes of the min-hashes, and its fingerprint."""
    import xxhash

    own = shingle_set(text, shingle)
    least = [_remix(own, i + 1).min() if len(own) else np.uint64(0) for i in range(BANDS * DEPTH)]
    rows = np.array(least, np.uint64).reshape(BANDS, DEPTH)
    bands = np.array([xxhash.xxh64_intdigest(r.tobytes(), SEED) for r in rows], np.uint64)
    last = (rows.ravel() & np.uint64(255)).astype(np.uint8).view("<i8")
    return xxhash.xxh128_digest(own.tobytes()), bands.view(np.int64).tolist(), len(own), last.tolist(), print_of(own)


def sketches(text: Column, shingle: int) -> Column:
    names = ["name", "bands", "size", "last", "fp"]

    @F.pandas_udf("name binary, bands array<long>, size int, last array<long>, fp array<long>")
    def made(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch(t, shingle) for t in texts], columns=names)

    return made(text)


def _agreeing(a: Column, b: Column) -> Column:
    """Bytes in which two words of eight min-hashes agree: a difference is gathered in the last bit of its byte."""
    x = a.bitwiseXOR(b)
    for step in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, step))
    return F.lit(8) - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def _possible(least: float) -> Column:
    """Whether (size, last) and (size2, last2) can belong to sets of a similarity of ``least``."""
    sizes = F.least("size", "size2") >= F.lit(least) * F.greatest("size", "size2")
    agree = [_agreeing(F.get("last", F.lit(i)), F.get("last2", F.lit(i))) for i in range(WORDS)]
    # Bounds other than the default scale the number of min-hashes that must agree.
    return sizes & (sum(agree[1:], agree[0]) >= int(AGREE - 112 * max(0.0, LEAST - least)))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float, folder: str) -> DataFrame:
    """Edges (a, b) between the components of those pairs (id, comp, id2, comp2) whose similarity is ``least`` or more."""
    @F.pandas_udf("boolean")
    def near(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([similarity(shingle_set(a, shingle), shingle_set(b, shingle)) >= least for a, b in zip(one, two, strict=True)], dtype=bool)

    # One pair stands for all that would link the same components from the same node.
    pairs = save(pairs.groupBy("id", "comp2").agg(F.min("comp").alias("comp"), F.collect_set("id2").alias("ids")).select(
        "id", "comp", F.explode("ids").alias("id2"), "comp2"), f"{folder}/pairs")
    asked = pairs.select("id").union(pairs.select("id2")).distinct()
    some = save(texts.join(asked, "id", "left_semi"), f"{folder}/texts")
    other = some.select(F.col("id").alias("id2"), F.col("text").alias("text2"))
    found = pairs.join(some, "id").join(other, "id2").filter(near("text", "text2"))
    edges = save(found.select(F.col("comp").alias("a"), F.col("comp2").alias("b")), f"{folder}/found")
    for step in ("pairs", "texts"):
        remove(texts.sparkSession, f"{folder}/{step}")
    return edges


def _by_prints(single: DataFrame, texts: DataFrame, shingle: int, least: float, folder: str) -> DataFrame:
    """(id, comp) of different sets (id, fp, size, last) linked by fingerprints within ``RADIUS`` bits and, of those, by their similarity."""
    sizes = single.select("id", "size", "last")
    twice = sizes.select(*[F.col(c).alias(f"{c}2") for c in sizes.columns])

    def check(pairs: DataFrame, at: str) -> DataFrame:
        asked = pairs.select("id", "comp", "id2", "comp2").distinct().join(sizes, "id").join(twice, "id2").filter(_possible(least))
        return _verified(asked.select("id", "comp", "id2", "comp2"), texts, shingle, least, at)

    return link_prints(single.select("id", "fp"), Segments.exact(single.count(), RADIUS), RADIUS, 1, folder, check=check)


def near_groups(docs: DataFrame, key: str, shingle: int, least: float = LEAST, rounds: int = LEADER_ROUNDS, folder: str | None = None) -> DataFrame:
    """(key, component_id) of every row: the smallest key that is linked to it by steps of a similarity of ``least`` or more.

    ``key`` is unique and never null. Null and empty texts are equal; fewer words than a shingle has are one shingle. Ties and repeated texts
    are one node. A very long text is one set in one task. An empty table gives an empty result; further columns are ignored. The result is
    a stored table; all others in ``folder`` are removed.
    """
    spark = docs.sparkSession
    folder = folder or work_folder(spark, "shingles")
    prints = save(docs.select(F.col(key).alias("key"), sketches(F.col("text"), shingle).alias("s")).select("key", "s.*"), f"{folder}/prints")
    first = prints.groupBy("name").agg(F.min("key").alias("id"))
    named = save(prints.select("key", "name").join(first, "name").select("key", "id"), f"{folder}/named")
    texts = docs.select(F.col(key).alias("id"), "text")
    single = prints.join(named.filter("key = id").select("key"), "key")
    own = single.select(F.col("key").alias("id"), F.posexplode("bands").alias("band", "val"))
    shared = own.groupBy("band", "val").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = save(own.join(shared, ["band", "val"]), f"{folder}/buckets")
    weights = own.groupBy("id").agg(F.sum("n").alias("weight"))
    sets = save(single.select(F.col("key").alias("id"), "fp", "size", "last"), f"{folder}/sets")
    remove(spark, f"{folder}/prints")
    linked = _by_prints(sets, texts, shingle, least, f"{folder}/links")
    nodes = sets.join(linked, "id").join(weights, "id", "left").select("id", F.coalesce("weight", F.lit(0)).alias("weight"), "size", "last", "comp")
    nodes = save(nodes, f"{folder}/nodes")
    for step in ("sets", "links"):
        remove(spark, f"{folder}/{step}")
    for turn in range(rounds + 1):
        at = f"{folder}/round{turn}"
        if turn < rounds:
            rows = own.drop("n").join(nodes.select("id", "comp", "weight"), "id")
            rank = F.struct((-F.col("weight") if turn == 0 else F.lit(0)).alias("w"), F.xxhash64(F.lit(turn), "id").alias("o"), "id", "comp")
            lead = rows.groupBy("band", "val").agg(F.min(rank).alias("f"))
            other = lead.select("band", "val", F.col("f.id").alias("id2"), F.col("f.comp").alias("comp2"))
            pairs = rows.join(other, ["band", "val"]).filter("comp <> comp2").select("id", "comp", "id2", "comp2").distinct()
            twice = nodes.select(F.col("id").alias("id2"), F.col("size").alias("size2"), F.col("last").alias("last2"))
            pairs = pairs.join(nodes.select("id", "size", "last"), "id").join(twice, "id2").filter(_possible(least))
        else:
            # Buckets whose nodes are all linked make no pairs, and in the others only pairs that can be similar leave the join.
            rows = own.drop("n").join(nodes.select("id", "comp"), "id")
            mixed = rows.groupBy("band", "val").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band", "val")
            rows = rows.join(mixed, ["band", "val"], "left_semi").join(nodes.select("id", "size", "last"), "id")
            other = rows.select("band", "val", *[F.col(c).alias(f"{c}2") for c in ("id", "comp", "size", "last")])
            same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("band", "val")]
            pairs = rows.alias("l").join(other.alias("r"), same[0] & same[1] & (F.col("comp2") < F.col("comp")) & _possible(least))
        edges = _verified(pairs.select("id", "comp", "id2", "comp2"), texts, shingle, least, at)
        found = components(edges, at).select(F.col("node").alias("_n"), "root")
        after = save(nodes.join(found, F.col("comp") == F.col("_n"), "left").select(
            "id", "weight", "size", "last", F.coalesce("root", "comp").alias("comp")), f"{folder}/nodes{turn}")
        remove(spark, at)
        remove(spark, f"{folder}/nodes{turn - 1 if turn else ''}")
        nodes = after
    out = named.join(nodes.select("id", "comp"), "id", "left").select(F.col("key").alias(key), F.coalesce("comp", "id").alias("component_id"))
    done = save(out, f"{folder}/groups")
    for step in ("named", "buckets", f"nodes{rounds}"):
        remove(spark, f"{folder}/{step}")
    return done
