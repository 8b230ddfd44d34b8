"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm import (
    conversation_repair, decontaminate, exact_dedup, line_dedup, lm_score, mixing, periodic_runs, quality, sentence_dedup, simhash, suffix_dedup, token_counts,
    url_filter,
)
from pactlens.llm.common import WORD, whole_text


TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the document that stays for its text."""
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


def quality_weights(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, quality weight) of labelled documents: good ones come twice as early as others, bad ones half as early."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    bad = (F.col("good") == 0) | (F.col("toxic") == 1)
    return labels.select(F.col("doc_id").alias("_id"), F.when(bad, 0.5).otherwise(2.0).alias("quality"))


def op6_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The words that a mix of 150% of all words takes from each document."""
    docs = table(spark, sf, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    graded = docs.join(quality_weights(spark, sf), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    return mixing.mix(graded).select("doc_id", "size", "source_size", "target", "taken")


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines before, lines dropped and the kept text's fingerprint of every document."""
    out = line_dedup.drop_frequent_lines(table(spark, sf, "documents").select("doc_id", "text"))
    kept = F.sha2(F.encode(F.coalesce("_doc.text", F.lit("")), "UTF-8"), 256)
    return out.select("_doc.doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf, "documents"), token_counts.tokenizer_path(TOKENIZER))


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and near-copy group of every document."""
    out = simhash.near_groups(table(spark, sf, "documents"))
    return out.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op3_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    """Log-probabilities of every text under a model of four fifths of them."""
    return lm_score.score(table(spark, sf, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and spans removed from every document, and the fingerprint of the rest."""
    return suffix_dedup.remove_repeats(table(spark, sf, "documents")).drop("spans")


def trusted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents labelled good and not toxic."""
    return table(spark, sf, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")


def toxic(spark: SparkSession, sf: str) -> DataFrame:
    """Documents labelled toxic."""
    return table(spark, sf, "labels").filter("toxic = 1").select("doc_id")


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Perplexity and toxic score of every document and whether it stays."""
    out = quality.classify(table(spark, sf, "documents").select("doc_id", "text", "lang"), trusted(spark, sf), toxic(spark, sf))
    return out.select("_doc.doc_id", "_doc.lang", "n_tokens", "perplexity", "threshold", "toxic_score", "toxic_threshold", "kept")


def op2_sentence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences removed from every document as parts of repeated passages."""
    out = sentence_dedup.remove_spans(table(spark, sf, "documents").select("doc_id", "text"))
    kept = F.sha2(F.encode(F.coalesce("_doc.text", F.lit("")), "UTF-8"), 256)
    return out.select("_doc.doc_id", "n_sentences", "n_removed", kept.alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the benchmark items that they hold."""
    return decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


#: The list of the query, fixed values: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = url_filter.judge(table(spark, sf, "pages").select("page_id", "url"), rules)
    return out.select("_doc.page_id", "host", "path", "rule", "verdict")


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a fault in about a quarter of the rows, dealt by a hash of conversation and turn."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                                (F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "UTF-8")) % 20).alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("_k <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_t")).drop("_t")


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults, cost and audit of every conversation after damage."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    out = conversation_repair.repair(damaged_turns(rows)).withColumnRenamed("conv_id", "_id")
    every = rows.select("conv_id").distinct()
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(out, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zeros],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def looped_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, by a hash of the id, repeat a few of their words from some word to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(whole_text(), F.lit(f"({WORD})"), F.lit(1))
    hit = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_w"), g.alias("_g"))
    n = F.size("_w").cast("long")
    sized = hit.select("doc_id", "text", "_w", "_g", n.alias("_n"), F.when(n > 0, F.col("_g") % n).alias("_a"))
    period = (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    start, rest = F.col("_a").cast("int"), (F.col("_n") - F.col("_a")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("_w", start + 1, period), F.ceil(rest / period).cast("int")))
    looped = F.array_join(F.concat(F.slice("_w", F.lit(1), start), F.slice(again, F.lit(1), rest)), " ")
    return sized.select("doc_id", F.when(F.col("_n") > 0, looped).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Number, longest and fingerprint of every document's runs, and the fingerprint of its text without their repeats."""
    out = periodic_runs.find_runs(looped_texts(table(spark, sf, "documents")))
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    listed = F.transform("runs", lambda r: F.concat(F.array_join(F.array(r["start"], r["length"], r["period"]), ","), F.lit("\n")))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    best = out.select("*", longest.alias("_b"))
    return best.select(
        "_doc.doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.s").alias("start"), (-F.col("_b.l")).alias("length"), F.col("_b.p").alias("period"),
        F.floor(-1000 * F.col("_b.l") / F.col("_b.p")).alias("exponent_milli"),
        digest(F.array_join(listed, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES = {
    "op13_periodic_runs": op13_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op11_url_filter": op11_url_filter,
    "op2_sentence_dedup": op2_sentence_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op1_quality": op1_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op3_lm_score": op3_lm_score,
    "op5_simhash": op5_simhash,
    "op4_token_counts": op4_token_counts, "op9_line_dedup": op9_line_dedup, "op8_exact_dedup": op8_exact_dedup, "op6_mix_sources": op6_mix_sources}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op11_url_filter": f"""
        WITH u AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS s FROM pages),
        p AS (SELECT r, page_id, translate(regexp_extract(s, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(s, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        l(h, q, v) AS (VALUES {_RULE_ROWS}),
        m AS (SELECT r, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v FROM p JOIN l
              ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY r)
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (r)""",
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORMAL} AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op9_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
        k AS (SELECT r, i, line, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
        f AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
        m AS (SELECT k.*, f.k IS NOT NULL AS hit FROM k LEFT JOIN f USING (k)),
        s AS (SELECT r, count(*) AS n_lines, count(*) FILTER (hit) AS n_dropped,
                     coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit), '') AS t FROM m GROUP BY r)
        SELECT doc_id, n_lines, n_dropped, sha256(t) AS kept_sha256 FROM d JOIN s USING (r)""",
}
