"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is fitted on a bounded sample of trusted documents. Its counts are Spark tables sharded by n-gram: trigram counts
give the continuation counts of bigrams, those give the ones of words, and joins of each table with its contexts give
discounted probabilities and interpolation weights. The finished tables have no more rows than the sample has tokens, so they go to
every worker, and each document's perplexity needs no shuffle. A document is rejected above its language's threshold, a
quantile of trusted documents that the model has not seen.

Toxic text reads like any other but for a few words, which a mean over all words hides. So the lowest order of the model, the
continuation shares of words, is fitted to a bounded sample of labelled toxic documents as well. The log odds of a document's
different words, as far as they are above ``LEAST_ODDS``, add up to a score with a threshold of the same kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import save, work_folder

SAMPLE_DOCS = 2000  # trusted documents that the model is fitted on, at most
SAMPLE_BYTES = 1 << 16  # longer documents are not taken into the sample
QUANTILE = 0.998
MARGIN = 0.05  # of log10 perplexity, above the quantile
LEAST_ODDS = 1.0  # log10 odds that a word must exceed to count as a sign of toxic text; it counts by the excess
TOXIC_MARGIN = 0.1  # of the toxic score, above the quantile
HELD_BROADCAST = 1_000_000  # ids of trusted documents up to which they are sent to the workers, before their texts are scored
LEAST_TRUSTED = 100  # trusted documents that a language needs for a threshold of its own
PRIOR_TOKENS = 30.0  # weight of the typical perplexity in a document's: short texts say little
CACHE_WORDS = 300_000
_MARKS = b"\"'`.,;:!?()[]{}<>*_-"
BOS, END, FIRST = 0, 1, 2  # ids of the marks, and of the first word


@dataclass
class Model:
    """Tables sorted by key. A key is ((u * size) + v) * size + w, exact for up to 2**20 words."""

    words: dict[int, int]  # hash of a word to its id
    size: int
    tri_key: np.ndarray
    tri: np.ndarray  # discounted trigram probabilities
    ctx_key: np.ndarray
    ctx: np.ndarray  # interpolation weights of two-word contexts
    bi_key: np.ndarray
    bi: np.ndarray
    one_ctx: np.ndarray  # interpolation weights of one-word contexts, by id
    one: np.ndarray  # unigram probabilities by id
    unknown: float


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


class Ids(dict):
    """Word to id with a bounded memory; -1 for unknown words."""

    def __init__(self, words: dict[int, int]):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = self.words.get(_word_hash(word), -1)
        return value


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # case is kept: it tells shouting from prose


def sequences(texts: list[str | None], ids: Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with two begin marks and an end for each text, where each text starts, and its tokens (words and one end)."""
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = tokens(text)
        sizes[i] = len(words) + 1
        parts += [[BOS, BOS], np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), [END]]
    flat = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes + 2)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64), sizes


def _vocabulary(sample: DataFrame) -> dict[int, int]:
    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {_word_hash(w) for t in batch["text"] for w in tokens(t)}
            yield pd.DataFrame({"h": np.array(sorted(found), np.uint64).view(np.int64)})

    rows = sample.mapInPandas(hashes, "h long").distinct().toArrow()["h"].to_numpy()
    return {h: i + FIRST for i, h in enumerate(np.sort(rows).view(np.uint64).tolist())}


def _trigrams(sample: DataFrame, words: dict[int, int]) -> DataFrame:
    size, shared = len(words) + FIRST, sample.sparkSession.sparkContext.broadcast(words)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = Ids(shared.value)
        for batch in batches:
            flat, _, _ = sequences(batch["text"].tolist(), ids)
            u, v, w = flat[:-2], flat[1:-1], flat[2:]
            yield pd.DataFrame({"u": u, "v": v, "w": w})[w != BOS]

    counted = sample.mapInPandas(keys, "u long, v long, w long").groupBy("u", "v", "w").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("size", F.lit(size))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    n = counts.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).first()
    if not all(n):
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]


def _smooth(counts: DataFrame, context: list[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """(counts with p, contexts with weight): discounted shares, and the mass left to the shorter context."""
    d = _discounts(counts)
    off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    totals = save(counts.groupBy(*context).agg(F.sum("n").alias("total"), (F.sum(off) / F.sum("n")).alias("weight")), folder)
    return counts.join(totals, context).withColumn("p", (F.col("n") - off) / F.col("total")), totals


def fit(trusted: DataFrame, folder: str) -> Model:
    """Model of the texts of ``trusted`` (text), a bounded sample."""
    words = _vocabulary(trusted)
    size = len(words) + FIRST
    three = save(_trigrams(trusted, words).drop("size"), f"{folder}/three")
    two = save(three.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n")), f"{folder}/two")
    one = save(two.groupBy("w").agg(F.count(F.lit(1)).alias("n")), f"{folder}/one")
    tri, tri_ctx = _smooth(three, ["u", "v"], f"{folder}/ctx3")
    bi, bi_ctx = _smooth(two, ["v"], f"{folder}/ctx2")

    def arrays(df: DataFrame, key: Column, value: str) -> tuple[np.ndarray, np.ndarray]:
        rows = df.select(key.alias("key"), F.col(value).alias("value")).toArrow()
        order = np.argsort(keys := rows["key"].to_numpy())
        return keys[order], rows["value"].to_numpy()[order]

    pair, col = F.lit(size), F.col
    tri_key, tri_p = arrays(tri, (col("u") * pair + col("v")) * pair + col("w"), "p")
    ctx_key, ctx_p = arrays(tri_ctx, col("u") * pair + col("v"), "weight")
    bi_key, bi_p = arrays(bi, col("v") * pair + col("w"), "p")
    by_id = np.ones(size)
    at, value = arrays(bi_ctx, col("v"), "weight")
    by_id[at] = value
    d, rows = _discounts(one), one.toArrow()
    n = rows["n"].to_numpy().astype(np.float64)
    off = np.where(n == 1, d[0], np.where(n == 2, d[1], d[2]))
    total = max(n.sum(), 1.0)
    rest = off.sum() / total if len(n) else 1.0
    unknown = rest / (size + 1)
    p1 = np.full(size, unknown)
    p1[rows["w"].to_numpy()] += (n - off) / total
    return Model(words, size, tri_key, tri_p, ctx_key, ctx_p, bi_key, bi_p, by_id, p1, unknown)


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), missing)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], missing)


def log_probability(model: Model, texts: list[str | None], ids: Ids) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log10 probabilities, and tokens, of each text."""
    flat, starts, sizes = sequences(texts, ids)
    if not len(flat):
        return np.zeros(0), sizes
    known = flat >= 0
    p = np.where(known, model.one[np.maximum(flat, 0)], model.unknown)
    u, v, w = flat[:-2], flat[1:-1], flat[2:]
    near = known[1:-1] & known[2:]
    at = np.flatnonzero(near) + 2
    shorter = p[2:].copy()
    # Contexts that the sample lacks have weight 1: the shorter context decides.
    seen_v = np.where(known[1:-1], model.one_ctx[np.maximum(v, 0)], 1.0)
    two = seen_v * shorter
    two[at - 2] += _find(model.bi_key, model.bi, v[at - 2] * model.size + w[at - 2], 0.0)
    context = np.flatnonzero(known[:-2] & known[1:-1])
    weight = np.ones(len(two))
    weight[context] = _find(model.ctx_key, model.ctx, u[context] * model.size + v[context], 1.0)
    three = weight * two
    full = context[known[2:][context] & (weight[context] != 1.0)]
    three[full] += _find(model.tri_key, model.tri, (u[full] * model.size + v[full]) * model.size + w[full], 0.0)
    logs = np.zeros(len(flat))
    logs[2:] = np.log10(three)
    logs[starts] = 0.0
    logs[starts + 1] = 0.0
    return np.add.reduceat(logs, starts), sizes


def bare(word: bytes) -> bytes:
    """A word without marks at its ends, A-Z lower-cased; a word of marks only is itself."""
    return (word.strip(_MARKS) or word).lower()


class Signs(dict):
    """Word to the hash of its bare form if that is a sign of toxic text, else 0, with a bounded memory."""

    def __init__(self, odds: dict[int, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = _word_hash(bare(word))
        self[word] = value = found if found in self.odds else 0
        return value

    def score(self, words: list[bytes]) -> float:
        """Sum over the different signs; in the order of hashes, so that equal texts have equal scores."""
        return sum(self.odds[h] for h in sorted(set(map(self.__getitem__, words)) - {0}))


def word_odds(sample: DataFrame) -> dict[int, float]:
    """Hash of a bare word to the log10 odds of its continuation share in toxic against trusted texts, less ``LEAST_ODDS``, where positive.

    ``sample`` (text, bad) is bounded. A word's count is the number of different words before it, or of different texts with it if those are
    fewer, so that one odd document makes no sign.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, bad in zip(batch["text"], batch["bad"], strict=True):
                h = [0] + [_word_hash(bare(w)) for w in tokens(text)]
                found = pd.DataFrame({"v": np.array(h[:-1], np.uint64).view(np.int64), "w": np.array(h[1:], np.uint64).view(np.int64)}).drop_duplicates()
                yield found.assign(d=np.uint64(_word_hash((text or "").encode())).view(np.int64), bad=bool(bad))

    seen = sample.mapInPandas(pairs, "v long, w long, d long, bad boolean")
    n = seen.groupBy("bad", "w").agg(F.least(F.count_distinct("v"), F.count_distinct("d")).alias("n"))
    rows = n.groupBy("w").agg(*[F.coalesce(F.sum(F.when(F.col("bad") == b, F.col("n"))), F.lit(0)).alias(c) for b, c in ((True, "b"), (False, "g"))])
    table = rows.toArrow()
    shares = []
    for c in ("b", "g"):
        k = table[c].to_numpy().astype(np.float64)
        ones, twos, total = (k == 1).sum(), (k == 2).sum(), max(k.sum(), 1.0)
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        shares.append((np.maximum(k - d, 0) + d * (k > 0).sum() / (len(k) + 1)) / total)
    odds = np.log10(shares[0] / shares[1]) - LEAST_ODDS if len(table) else np.zeros(0)
    up = (odds > 0) & (table["b"].to_numpy() > 1)
    return dict(zip(table["w"].to_numpy()[up].view(np.uint64).tolist(), odds[up].tolist(), strict=True))


def perplexities(docs: DataFrame, model: Model, odds: dict[int, float]) -> DataFrame:
    """``docs`` with n_tokens, logp and cue, the toxic score; one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast((model, odds))

    @F.pandas_udf("n_tokens long, logp double, cue double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, odds = shared.value
        ids, signs = Ids(model.words), Signs(odds)
        for batch in batches:
            texts, out = batch.tolist(), []
            for at in range(0, len(texts), 256):
                part = texts[at:at + 256]
                logp, sizes = log_probability(model, part, ids)
                cue = [signs.score(tokens(t)) for t in part]
                out.append(pd.DataFrame({"n_tokens": sizes, "logp": logp, "cue": np.array(cue, np.float64)}))
            none = {"n_tokens": np.zeros(0, np.int64), "logp": np.zeros(0), "cue": np.zeros(0)}
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame(none)

    return docs.withColumn("_m", measure("text"))


def classify(
    docs: DataFrame, trusted: DataFrame, toxic: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS, quantile: float = QUANTILE,
    margin: float = MARGIN, prior: float = PRIOR_TOKENS, folder: str | None = None, toxic_margin: float = TOXIC_MARGIN,
) -> DataFrame:
    """Judge every document of ``docs`` (doc_id, text, lang, ..).

    ``trusted`` (doc_id, repeats allowed) names trusted documents. Half of them, by hash of the id, are for the model, which is fitted on at
    most about ``sample_docs`` of them that are at most ``SAMPLE_BYTES`` long; the other half gives the thresholds: per
    language the ``quantile`` of log10 perplexity, plus ``margin``. A language with fewer than ``LEAST_TRUSTED``, or none
    (null), has the threshold of all. A document's log10 perplexity is averaged with the typical one of trusted text,
    weighing as much as ``prior`` tokens; empty and null texts, which have one token, are kept by that. ``toxic`` names toxic documents, of
    which at most about ``sample_docs`` of the same length give the word odds; a document whose toxic score is above the quantile of
    trusted ones of its language plus ``toxic_margin`` is rejected, too. Without trusted documents all are kept, without toxic ones
    perplexity alone decides. Returns one row per row: _doc (the whole row as a struct), n_tokens, perplexity, score (the
    averaged log10), threshold, toxic_score, toxic_threshold, kept. Repeated rows are judged alike. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or work_folder(spark, "quality")
    side = F.pmod(F.xxhash64("_id"), F.lit(2))
    names = save(trusted.select(F.col("doc_id").alias("_id")).filter("_id IS NOT NULL").distinct(), f"{folder}/trusted")
    fits, rest = names.filter(side == 0), names.filter(side == 1)
    short = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES)

    def sampled(ids: DataFrame, path: str) -> DataFrame:
        every = max(1, -(-ids.count() // sample_docs))
        chosen = ids.filter(F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(every)) == 0)
        return save(short.join(chosen, F.col("doc_id") == F.col("_id"), "left_semi").select("text"), f"{folder}/{path}")

    sample = sampled(fits, "sample")
    model, odds = fit(sample, f"{folder}/model"), {}
    if toxic is not None:
        bad = save(toxic.select(F.col("doc_id").alias("_id")).filter("_id IS NOT NULL").distinct(), f"{folder}/toxic")
        bad = sampled(bad, "toxic_sample")
        odds = word_odds(sample.withColumn("bad", F.lit(False)).unionByName(bad.withColumn("bad", F.lit(True))))
    language = F.coalesce(F.col("_doc.lang"), F.lit(""))
    packed = docs.select(F.struct("*").alias("_doc"), "text")
    measured = [F.col("_m.n_tokens").alias("n_tokens"), (-F.col("_m.logp") / F.col("_m.n_tokens")).alias("entropy"), F.col("_m.cue").alias("cue")]
    scored = perplexities(packed, model, odds).select("_doc", *measured)
    # Texts don't cross a shuffle: few ids go to the texts, and for many, all texts are measured and narrow rows are joined.
    narrow, held_ids = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text"), F.col("doc_id") == F.col("_id")
    few = rest.count() <= HELD_BROADCAST
    if few:
        narrow = narrow.join(F.broadcast(rest), held_ids, "left_semi")
    narrow = perplexities(narrow, model, odds).select("doc_id", "lang", *measured)
    held = save(narrow if few else narrow.join(rest, held_ids, "left_semi"), f"{folder}/held")
    typical = held.agg(F.percentile_approx("entropy", 0.5, 10_000)).first()[0]
    typical = 0.0 if typical is None else float(typical)
    score = (F.col("entropy") * F.col("n_tokens") + prior * typical) / (F.col("n_tokens") + prior)
    graded = held.withColumn("score", score)
    cuts = [F.percentile_approx(c, quantile, 10_000).alias(f"{c}_cut") for c in ("score", "cue")]
    overall = [F.lit(None if v is None else float(v)).cast("double") for v in graded.agg(*cuts).first()]
    own = graded.groupBy("lang").agg(*cuts, F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_TRUSTED)
    limits = save(own.select(F.col("lang").alias("_lang"), "score_cut", "cue_cut"), f"{folder}/limits")
    judged = scored.withColumn("_l", language).join(limits, F.col("_l") == F.col("_lang"), "left").withColumn("score", score)
    judged = judged.withColumn("threshold", F.coalesce("score_cut", overall[0]) + margin)
    judged = judged.withColumn("toxic_threshold", F.coalesce("cue_cut", overall[1]) + toxic_margin)
    return judged.select(
        "_doc", "n_tokens", F.pow(F.lit(10.0), "entropy").alias("perplexity"), "score", "threshold", F.col("cue").alias("toxic_score"), "toxic_threshold",
        F.coalesce((F.col("score") <= F.col("threshold")) & (F.col("cue") <= F.col("toxic_threshold")), F.lit(True)).alias("kept"),
    )
