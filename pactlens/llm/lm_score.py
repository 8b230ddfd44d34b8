"""Language-model scores from a weighted backoff automaton.

The model is an n-gram model over symbols with hierarchical Dirichlet smoothing: P(s | context) = (c(context s) + m P(s |
shorter context)) / (c(context) + m). Every word is a symbol of its own. As an automaton, every context seen in training
is a state. A seen continuation is an arc with the smoothed probability; any other symbol takes the failure arc, whose
weight is m / (c(context) + m), to the state of the shorter context. After a word the state is the n-gram that ends
there, so one pass from left to right carries the state and adds up log-probabilities. Unknown words share the mass of
words seen once (Good and Turing). With a ``share`` above 0 only words with at least that share of all training tokens and
the end of a text are symbols, and one symbol stands for all other words; a word has its share of its symbol's probability.

The counts of a large corpus fit nowhere. Documents are dealt into chunks of bounded size. A chunk asks for the words and
n-grams it holds, sorted and cut into buckets by their hashes; a bucket adds up the counts of all chunks and answers each chunk
with the totals alone, in the order of its keys. Each chunk then traverses its own part of the automaton.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import save, whole_text, work_folder

SHARE = 0.0  # of training tokens, for a symbol of its own; 0: every word has one
MASS = (100.0,)  # Dirichlet mass of contexts of 1, 2, .. words; its length gives the order
CHUNK_BYTES = 6 << 20  # of text that a worker holds with its counts
START_WORD, END_WORD, REST_WORD = b" start", b" end", b" rest"  # no word holds a space

_STEP, _M1 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    """64-bit hashes of words, computed once for each chunk and word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


class Sequences:
    """The words of a chunk's texts in one array, a start mark before each text and an end after it."""

    def __init__(self, texts: Sequence[str]):
        hashes = _Hashes()
        start, end = np.uint64(hashes[START_WORD]), np.uint64(hashes[END_WORD])
        parts, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = text.encode().lower().split()  # bytes: ASCII only
            sizes[i] = len(words) + 1
            parts += [[start], np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), [end]]
        self.sizes = sizes
        self.words = np.concatenate(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        self.is_start = np.zeros(len(self.words), bool)
        self.is_start[self.starts] = True
        self.doc = np.repeat(np.arange(len(sizes)), sizes + 1)

    def ngrams(self, order: int, symbols: Totals) -> list[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``order`` symbols: the key of the n-gram that ends at each place, and where there is one."""
        own = symbols.of(self.words)
        out = [(own, np.ones(len(own), bool))]
        for _ in range(1, order):
            shorter, valid = out[-1]
            key, ok = np.zeros_like(shorter), np.zeros_like(valid)
            x = shorter[:-1] * _STEP + (own[1:] ^ _STEP)
            x = (x ^ (x >> np.uint64(29))) * _M1
            key[1:] = x ^ (x >> np.uint64(32))
            ok[1:] = valid[:-1] & ~self.is_start[1:]
            out.append((key, ok))
        return out


def _lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of sorted keys; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0.0)


class Totals:
    """Training totals. Every word is its own symbol, and its counts are those that the chunk was sent."""

    def __init__(self, tokens: int, types: int, once: int, texts: int):
        self.tokens, self.types, self.texts = tokens, types, texts
        self.unknown = once / tokens if once and once < tokens else 0.5 / (tokens + 1)
        marks = _Hashes()
        self.start, self.end, self.rest = (np.uint64(marks[w]) for w in (START_WORD, END_WORD, REST_WORD))

    def of(self, words: np.ndarray) -> np.ndarray:
        return words

    def count(self, symbols: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Training count of symbols as contexts; a start mark stands before each text."""
        return np.where(symbols == self.start, self.texts, seen)

    def word_probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, (1 - self.unknown) * count / max(self.tokens, 1), self.unknown)

    def probability(self, symbols: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return self.word_probability(seen)


class Symbols(Totals):
    """The bounded part of a model of frequent words: totals, and the symbols with their counts as tokens and as contexts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, types: int, once: int, texts: int):
        super().__init__(tokens, types, once, texts)
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order].astype(np.float64)

    def of(self, words: np.ndarray) -> np.ndarray:
        kept = (_lookup(self.words, self.counts, words) > 0) | (words == self.start) | (words == self.end)
        return np.where(kept, words, self.rest)

    def count(self, symbols: np.ndarray, seen: np.ndarray) -> np.ndarray:
        own = _lookup(self.words, self.counts, symbols)
        own = np.where(symbols == self.rest, self.tokens - self.counts.sum(), own)
        return np.where(symbols == self.start, self.texts, own)

    def probability(self, symbols: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """All other words have what the symbols leave, the unknown among them."""
        seen = (1 - self.unknown) / max(self.tokens, 1)
        end = self.unknown if not self.tokens else 0.0
        own = np.where(symbols == self.end, np.maximum(_lookup(self.words, self.counts, symbols) * seen, end), _lookup(self.words, self.counts, symbols) * seen)
        return np.where(symbols == self.rest, 1 - self.counts.sum() * seen, own)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as eight planes of bytes: the high bytes, mostly zero, lie together and take no room when compressed."""
    return np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their steps, which are smaller."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _counted(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each is learned."""
    asked = np.unique(keys)
    known, times = np.unique(keys[learned], return_counts=True)
    count = np.zeros(len(asked), np.int64)
    count[np.searchsorted(asked, known)] = times
    return asked, count


def _places(seq: Sequences, first: int, last: int, symbols: Totals) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Words (true) and n-grams of two and more symbols, where ``first`` to ``last`` include them: their keys and documents."""
    if first == 1:
        yield True, seq.words[~seq.is_start], seq.doc[~seq.is_start]
    if last > 1:
        grams = seq.ngrams(last, symbols)[1:]
        yield False, np.concatenate([key[ok] for key, ok in grams]), np.concatenate([seq.doc[ok] for _, ok in grams])


_ASKED = "chunk long, word boolean, bucket long, keys binary, n binary"
_ANSWERED = "chunk long, word boolean, bucket long, totals binary, tokens long, types long, once long, known binary, times binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _table(rows: list[tuple] | dict, schema: str) -> pa.Table:
    """An Arrow table of columns, or of rows, that are named and typed as in ``schema``."""
    types = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    fields = [(name, types[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    columns = rows if isinstance(rows, dict) else {f[0]: [r[i] for r in rows] for i, f in enumerate(fields)}
    return pa.table([pa.array(columns[name], kind) for name, kind in fields], names=[f[0] for f in fields])


def _chunk_counts(first: int, last: int, buckets: int, shared):
    """A chunk's n-grams of ``first`` to ``last`` symbols with their training counts, a row for each bucket; those of one are words.

    A bucket is a range of keys, so the buckets of a chunk in order hold its keys in order.
    """

    def counts(docs: pa.Table) -> pa.Table:
        seq, learned, rows = Sequences(docs["text"].to_pylist()), docs["train"].to_numpy(), []
        for word, keys, doc in _places(seq, first, last, shared.value):
            asked, n = _counted(keys, learned[doc])
            bucket = ((asked >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            found, starts = np.unique(bucket, return_index=True)
            for i, at, end in zip(found.tolist(), starts, [*starts[1:], len(asked)], strict=True):
                rows.append((docs["chunk"][0].as_py(), word, i, _packed_keys(asked[at:end]), _packed(n[at:end])))
        return _table(rows, _ASKED)

    return counts


def _bucket_totals(listed: bool):
    """A bucket's answer to each chunk; the first row also has its words' totals, and with ``listed`` the learned words."""

    def totals(asked: pa.Table) -> pa.Table:
        keys = [_unpacked_keys(x) for x in asked["keys"].to_pylist()]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([_unpacked(x) for x in asked["n"].to_pylist()])
        total = np.bincount(at, n, len(distinct)).astype(np.int64)  # as doubles: exact below 2**53
        answers = np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])
        word, bucket = asked["word"][0].as_py(), asked["bucket"][0].as_py()
        rows = [(chunk, word, bucket, _packed(x), 0, 0, 0, None, None) for chunk, x in zip(asked["chunk"].to_pylist(), answers, strict=True)]
        if word:
            known = total > 0
            lists = (_packed_keys(distinct[known]), _packed(total[known])) if listed else (None, None)
            rows[0] = (*rows[0][:4], int(total.sum()), int(known.sum()), int((total == 1).sum()), *lists)
        return _table(rows, _ANSWERED)

    return totals


class Automaton:
    """The part of the automaton that a chunk's texts can reach: arcs by n-gram, and word counts."""

    def __init__(self, symbols: Totals, words: tuple[np.ndarray, np.ndarray], arcs: tuple[np.ndarray, np.ndarray], mass: Sequence[float]):
        self.symbols, self.mass = symbols, mass
        self.words, self.arcs = (tuple(x[np.argsort(t[0])] for x in t) for t in (words, arcs))

    def traverse(self, seq: Sequences) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and training count of each token; start marks have zero and zero.

        The state before a place is the context that ends just before it, for all places of the chunk at once.
        """
        grams = seq.ngrams(len(self.mass) + 1, self.symbols)
        seen = _lookup(*self.words, seq.words)
        root = self.symbols.probability(grams[0][0], seen)
        p, state = root, self.symbols.count(grams[0][0], seen)
        for (key, ok), mass in zip(grams[1:], self.mass, strict=True):
            arcs = np.where(ok, _lookup(*self.arcs, key), 0.0)
            context = np.concatenate([[0.0], state[:-1]])
            failure = np.where(ok, mass / (context + mass), 1.0)  # weight of the failure arc
            p = np.where(arcs > 0, arcs / (context + mass), 0.0) + failure * p
            state = arcs
        token = ~seq.is_start
        with np.errstate(divide="ignore", invalid="ignore"):  # of start marks, which are no tokens
            inside = np.where(grams[0][0] == self.symbols.rest, self.symbols.word_probability(seen) / root, 1.0)
            return np.where(token, np.log10(p * inside), 0.0), np.where(token, seen, 0.0)


def _chunk_scores(shared, mass: Sequence[float]):
    def scores(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return _table([], _SCORES)
        symbols, seq = shared.value, Sequences(docs["text"].to_pylist())
        counts = {word: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for word in (True, False)}
        answers = answers.sort_by("bucket")
        for word, keys, _ in _places(seq, 1, len(mass) + 1, symbols):
            sent = answers.filter(answers["word"] if word else pc.invert(answers["word"]))["totals"].to_pylist()
            counts[word] = np.unique(keys), np.concatenate([np.zeros(0, np.uint64), *map(_unpacked, sent)]).astype(np.int64)
            if len(counts[word][0]) != len(counts[word][1]):
                raise ValueError("the documents of a chunk changed between two reads of the table")
        logp, seen = Automaton(symbols, counts[True], counts[False], mass).traverse(seq)
        base = np.log10((seen + 0.5) / (symbols.tokens + 0.5 * (symbols.types + 1)))
        base[seq.is_start] = 0.0
        add = lambda x: np.add.reduceat(x, seq.starts)
        return _table({
            "doc_id": docs["doc_id"].to_pylist(), "held_out": ~docs["train"].to_numpy(), "n_tokens": seq.sizes,
            "n_known": add((seen > 0).astype(np.int64)), "train_tokens": np.full(len(docs), symbols.tokens, np.int64),
            "base_score": add(base), "score": add(logp),
        }, _SCORES)

    return scores


def _at_least(share_of_all: float, end: int):
    """(key, total) of the listed words that are frequent, and of the end."""

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for known, times in zip(frame["known"], frame["times"], strict=True):
                key, total = _unpacked_keys(known).view(np.int64), _unpacked(times).view(np.int64)
                kept = (total >= share_of_all) | (key == end)
                yield pd.DataFrame({"key": key[kept], "total": total[kept]})

    return pick


def totals_of(words: DataFrame, texts: int, share: float) -> Totals:
    """From the buckets' answers: totals, and with a ``share`` above 0 the at most 1 / share words that are symbols."""
    tokens, types, once = (int(x or 0) for x in words.agg(F.sum("tokens"), F.sum("types"), F.sum("once")).first())
    if not share:
        return Totals(tokens, types, once, texts)
    pick = _at_least(max(1.0, share * tokens), np.uint64(_Hashes()[END_WORD]).astype(np.int64).item())
    rows = words.filter("known IS NOT NULL").select("known", "times").mapInPandas(pick, "key long, total long").toArrow()
    return Symbols(rows["key"].to_numpy().astype(np.int64).view(np.uint64), rows["total"].to_numpy().astype(np.int64), tokens, types, once, texts)


def train_rows(doc_id: Column) -> Column:
    """Whether a document is learned from; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1


def score(
    docs: DataFrame, mass: Sequence[float] = MASS, share: float = SHARE, chunk_bytes: int = CHUNK_BYTES, folder: str | None = None
) -> DataFrame:
    """Score every text with a model of the texts that :func:`train_rows` picks.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score, score for each row. A null text
    is empty: one token, the end. Repeated rows are learned and scored each. With nothing to learn from, all mass is on
    unknown words. Ties and further columns don't matter; an empty table gives an empty result.
    """
    folder = folder or work_folder(docs.sparkSession, "lm")
    picked = train_rows(F.col("doc_id"))
    size, texts = docs.agg(F.sum(F.octet_length(whole_text()) + 64), F.count(F.when(picked, 1))).first()
    chunks = int((size or 0) // chunk_bytes) + 1
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"),
        picked.alias("train"), whole_text().alias("text"),
    )
    by_chunk, buckets = dealt.groupBy("chunk"), chunks // 2 + 1  # a bucket holds about as many keys as two chunks
    context, order = docs.sparkSession.sparkContext, len(mass) + 1

    def answered(first: int, last: int, symbols, name: str) -> DataFrame:
        asked = by_chunk.applyInArrow(_chunk_counts(first, last, buckets, symbols), _ASKED)
        return save(asked.groupBy("word", "bucket").applyInArrow(_bucket_totals(share > 0), _ANSWERED), f"{folder}/{name}")

    # Where every word is a symbol, words and n-grams are counted together.
    counts = answered(1, 1 if share else order, context.broadcast(Totals(0, 0, 0, 0)), "counts")
    shared = context.broadcast(totals_of(counts.filter("word"), int(texts), share))
    back = counts.select("chunk", "word", "bucket", "totals")
    if mass and share:
        back = back.unionByName(answered(2, order, shared, "arcs").select(*back.columns))
    return by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(_chunk_scores(shared, mass), _SCORES)
