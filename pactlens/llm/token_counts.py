"""Token counts by a two-tier lookup of pre-token lengths, without any shuffle of pre-tokens.

Tokens never cross from one pre-token to the next, so a text's count is the sum over its pre-tokens. A small table of
frequent pre-tokens goes to every worker; what it lacks is encoded once for each worker and kept in a bounded cache.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pactlens.llm.common import whole_text

SAMPLE_DOCS = 2000  # documents, by hash, that the frequent table is taken from; counts don't depend on it
TABLE_ENTRIES = 32_768
CACHE_ENTRIES = 300_000
LIMIT = 4096
_RUNS = re.compile(r"( +)([^ ]*)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WholeTexts:
    """Encodes whole texts; for vocabularies whose tokens may cross pre-tokens."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in self.library.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            self.encode = lambda texts: [len(x.ids) for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        return self.encode(texts)


class Pieces(WholeTexts):
    """Sentencepiece with white space as prefix: words with the spaces before them, and lines, are pre-tokens.

    A key is a text whose encoding has one prefix space too many at its start: ``word`` for a space and a word,
    ``" word"`` for two spaces and a word, and so on; ``"\\nword"`` for the first word of a later line, without a space.
    """

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        super().__init__(path)
        vocabulary = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        space = "▁"
        self.separable = not any(space in p.lstrip(space) or "\n" in p for p in vocabulary) and self.encode([""]) == [0]
        # Normalisation that rewrites text, or drops spaces, would move the borders.
        probe = self.library.encode("  ﬁ  ", out_type=str)
        self.separable &= "".join(probe).replace(space, " ") == "   ﬁ  "
        line, self.prefix = self.encode(["\n", "a "])[0], self.encode(["a "])[0] - self.encode(["a"])[0]
        self.separable &= line == self.prefix + self.encode(["\n\n"])[0] - line
        self.frequent, self.cache = frequent or {}, {}

    def keys(self, text: str) -> list[str]:
        out = []
        for i, line in enumerate(text.replace("▁", " ").split("\n")):
            words = line.split(" ")
            first = words[0] if i == 0 else "\n" + words[0]
            if "  " in line or line[-1:] == " " or (i == 0 and line[:1] == " "):
                if i == 0:
                    out += [s[1:] + w for s, w in _RUNS.findall(" " + line)]
                else:
                    out.append(first)
                    out += [s[1:] + w for s, w in _RUNS.findall(line[len(words[0]):])]
            else:
                words[0] = first
                out += words
        return out

    def learn(self, keys: list[str]) -> None:
        if len(self.cache) + len(keys) > CACHE_ENTRIES:
            self.cache = {}
        for k, n in zip(keys, self.encode(keys), strict=True):
            self.cache[k] = self.prefix if not k else n - self.prefix if k[0] == "\n" else n

    def count(self, texts: list[str]) -> list[int]:
        if not self.separable:
            return self.encode(texts)
        out = []
        for text in texts:
            if not text:
                out.append(0)
                continue
            keys = self.keys(text)
            known = list(map(self.frequent.get, keys))
            if None in known:
                rest = [k for k, n in zip(keys, known, strict=True) if n is None]
                if missing := [k for k in set(rest) if k not in self.cache]:
                    kept = self.cache
                    self.learn(missing)
                    found = self.cache if kept is self.cache else kept | self.cache
                else:
                    found = self.cache
                out.append(sum(n for n in known if n is not None) + sum(map(found.__getitem__, rest)))
            else:
                out.append(sum(known))
        return out


def counter(path: str, frequent: dict[str, int] | None = None) -> WholeTexts:
    return Pieces(path, frequent) if path.endswith(".model") else WholeTexts(path)


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """The most frequent pre-tokens of a hash sample with their lengths: at most ``entries``, a few megabytes."""
    if not path.endswith(".model"):
        return {}
    every = max(1, docs.count() // sample_docs)
    # The id is hashed as well, so that the copies of one text are not all taken or all left.
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text")

    def most(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, seen = counter(path), Counter()
        for batch in batches:
            for text in batch["text"].dropna():
                seen.update(pieces.keys(text))
                if len(seen) > 8 * entries:
                    seen = Counter(dict(seen.most_common(4 * entries)))
        top = seen.most_common(entries)
        if top:  # Arrow makes no struct of a frame without rows
            yield pd.DataFrame({"key": [k for k, _ in top], "n": [n for _, n in top]}, columns=["key", "n"])

    total = Counter()
    for key, n in sample.mapInPandas(most, "key string, n long").toLocalIterator():
        total[key] += n
    pieces = counter(path)
    keys = [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:entries] if len(k) <= 64]
    pieces.learn(keys)
    return pieces.cache


def token_count(text: Column, path: str, shared) -> Column:
    """Column of token counts. ``shared``: broadcast table of :func:`frequent_lengths`."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = counter(path, shared.value)
        for batch in batches:
            yield pd.Series(pieces.count(batch.tolist()), dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Return doc_id, n_bytes, n_tokens and over_limit for every row.

    ``path`` is a tokenizer file that every worker can read. Counts are without begin, end or added special tokens and
    without truncation. Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null doc_ids are counted like
    any other row; further columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs.select("doc_id", "text"), path, sample_docs))
    counted = docs.select(
        "doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), token_count(whole_text(), path, shared).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
