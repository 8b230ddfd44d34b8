"""URL filters by a blocked Bloom filter of listed canonical URLs and an exact hash join.

A rule is a canonical URL: host and path without scheme, query and fragment. The listed ones set four bits each in one block of
256 bits, so a probe reads a single row of the filter. A page's candidates are the ends of its host with the starts
of its path, in the shapes that the list has. What passes the filter meets the list in a hash join, which removes false
positives, and the longest rule decides. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from pactlens.llm.common import ascii_lower, save, work_folder

BITS_PER_RULE = 16
WORDS = 4  # of 64 bits in a block; a rule sets one bit in each
#: The filter is sent to all workers: 2**18 blocks are 8 MiB of bits, some 20 MiB as rows. Longer lists share them, which lets
#: more false positives through to the join and changes no result.
MAX_BLOCKS = 1 << 18
BLOCK, ALLOW = "block", "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A to Z lower-cased; and then up to ``?``, ``#`` or
    the end. Both are empty for null and where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    bare = F.regexp_replace(rest, r"(?s)[?#].*", "")
    host = F.substring_index(bare, "/", 1)
    return ascii_lower(host), F.substr(bare, F.char_length(host) + 1, F.char_length(bare))


def _word(key: Column, i: int) -> Column:
    """The bit of a key in word ``i`` of its block."""
    shift = F.shiftrightunsigned(F.xxhash64(F.lit(1), key), 6 * i).bitwiseAND(F.lit(63))
    return F.call_function("shiftleft", F.lit(1).cast("long"), shift.cast("int"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(blocks)).cast("int")


def block_count(rules: int) -> int:
    """A power of two of blocks with ``BITS_PER_RULE`` bits a rule, up to ``MAX_BLOCKS``."""
    need = -(-max(rules, 1) * BITS_PER_RULE // (64 * WORDS))
    return min(1 << (need - 1).bit_length(), MAX_BLOCKS)


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3): the blocks of the filter that hold any of the ``key`` values. At most ``blocks`` rows."""
    words = [_word(F.col("key"), i).alias(f"w{i}") for i in range(WORDS)]
    rows = keys.select(_block(F.col("key"), blocks).alias("block"), *words)
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def listed(rules: DataFrame, path: str) -> DataFrame:
    """The list as (key, host_labels, path_chars, verdict), written once. Of repeated rules a blocking one counts."""
    host, start = ascii_lower("host"), F.coalesce("path", F.lit(""))
    rows = rules.filter("host IS NOT NULL AND host <> ''").select(
        F.concat(host, start).alias("key"), F.size(F.split(host, r"\.")).alias("host_labels"), F.char_length(start).alias("path_chars"), "verdict"
    )
    strict = F.when(F.bool_or(F.coalesce(F.col("verdict") != ALLOW, F.lit(True))), BLOCK).otherwise(ALLOW)
    return save(rows.groupBy("key", "host_labels", "path_chars").agg(strict.alias("verdict")), path)


def candidates(host: Column, path: Column, shapes: Column) -> Column:
    """Ends of the host joined with starts of the path, for every (host_labels, path_chars) that the URL is long enough for."""
    labels = F.size(F.split(host, r"\."))
    fits = F.filter(shapes, lambda s: (s["host_labels"] <= labels) & (s["path_chars"] <= F.char_length(path)))
    ends = F.transform(
        fits, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["host_labels"]), F.substr(path, F.lit(1), s["path_chars"]))
    )
    return F.when(host != "", ends).otherwise(F.array().cast("array<string>"))


def possible_hits(urls: DataFrame, rules: DataFrame, blocks: int) -> DataFrame:
    """(host, path, key) of the candidates of ``urls`` (host, path) that the filter lets through.

    ``rules`` as :func:`listed` gives them. The filter is broadcast: ``blocks`` rows at most.
    """
    # One row of shapes: at most as many as label counts times path lengths occur in the list. An empty list has none.
    shapes = rules.agg(F.to_json(F.sort_array(F.collect_set(F.struct("host_labels", "path_chars"))))).first()[0]
    shape_type = "array<struct<host_labels:int,path_chars:int>>"
    keys = urls.select("host", "path", F.explode(candidates(F.col("host"), F.col("path"), F.from_json(F.lit(shapes), shape_type))).alias("key"))
    probe = keys.withColumn("block", _block(F.col("key"), blocks))
    joined = probe.join(F.broadcast(bloom_blocks(rules, blocks)), "block")
    passed = F.lit(True)
    for i in range(WORDS):
        passed &= F.col(f"w{i}").bitwiseAND(_word(F.col("key"), i)) != 0
    return joined.filter(passed).select("host", "path", "key")


def decide(urls: DataFrame, rules: DataFrame, blocks: int) -> DataFrame:
    """(host, path, rule, verdict) of the different ``urls`` (host, path) that a rule fits: the longest one, by code points, then by host."""
    hits = possible_hits(urls, rules, blocks).join(rules, "key")
    length = F.struct(F.char_length("key").alias("chars"), F.col("host_labels").alias("labels"))
    best = F.max_by(F.struct("key", "verdict"), length)
    return hits.groupBy("host", "path").agg(best.alias("_b")).select("host", "path", F.col("_b.key").alias("rule"), F.col("_b.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, folder: str | None = None, default: str = ALLOW) -> DataFrame:
    """Judge each page's ``url`` by a list of rules: (_doc, host, path, rule, verdict), where ``_doc`` is the whole row.

    ``rules`` has host, path and verdict (``block`` or ``allow``; anything else, and null, blocks) and may have any number of rows. A rule fits its host
    and all hosts below it, if the URL's path starts with the rule's path; the longest rule wins, and a blocking one of equal rules.
    URLs without a rule are not listed and get ``default``, with a null rule. Null and empty URLs, and those without
    ``://``, have an empty host and path and fit no rule. Rules without host are left out, rules without path cover the
    whole host. Long URLs make no more candidates than the list has shapes. Every row is
    returned, repeated rows and null ids too; an empty table gives an empty result, an empty list judges all by ``default``.
    Further columns travel in the struct, so names cannot clash.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or work_folder(spark, "urls")
    rules = listed(rules, f"{folder}/rules")
    blocks = block_count(rules.count())
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.struct("*").alias("_doc"), host.alias("host"), path.alias("path"))
    # Equal canonical URLs meet before the shuffle; each has at most one row in ``found``.
    found = decide(rows.select("host", "path"), rules, blocks).withColumnsRenamed({"host": "_h", "path": "_p"})
    # Rows without a host can't be listed: a key of their own keeps them from meeting in one task.
    plain = [F.col("_doc")[f.name] for f in pages.schema if isinstance(f.dataType, AtomicType)]
    spread = F.when(F.col("host") != "", F.col("host")).otherwise(F.concat(F.lit("/"), F.xxhash64(*plain).cast("string")))
    return rows.join(found, (spread == F.col("_h")) & (F.col("path") == F.col("_p")), "left").select(
        "_doc", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
