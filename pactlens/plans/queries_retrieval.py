"""Queries over evidence retrieval, semantic candidates and the exception gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactlens.constants import COLLECTIONS
from pactlens.functions import embed as em
from pactlens.operators import candidates as cand
from pactlens.operators import modelio, retrieve, screen
from pactlens.operators.prefix import spread, top_rows
from pactlens.operators.similar import nearest
from pactlens.packs.defaults import LATIN_RULES
from pactlens.plans import sqltext as q
from pactlens.plans.tables import documents, sha, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its oracle when there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_TOK = "list_transform(regexp_extract_all(text, '[가-힣A-Za-z0-9]+'), lambda w: lower(w))"


def _hash_sql(t: str) -> tuple[str, str]:
    return f"('0x' || substr(sha256({t}), 1, 8))::BIGINT % 128", f"1.0::DOUBLE - 2 * (('0x' || substr(sha256({t}), 9, 2))::BIGINT % 2)"


def _vec_sql(src: str, key: str, out: str) -> str:
    """CTEs: sparse unit vectors (key, b, v) of the texts in ``src``."""
    b, s = _hash_sql("t")
    return f"""{out}t AS (SELECT {key}, unnest({_TOK}) AS t FROM {src}),
{out}w AS (SELECT {key}, {b} AS b, sum({s}) AS s FROM {out}t GROUP BY {key}, {b}),
{out} AS (SELECT {key}, b, s / sqrt(sum(s * s) OVER (PARTITION BY {key})) AS v FROM {out}w WHERE s <> 0)"""


# ---- tokens and embeddings -------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(list_distinct(t)) AS BIGINT) AS distinct_tokens, sha256(array_to_string(t, ' ')) AS token_sha FROM (SELECT doc_id, {_TOK} AS t FROM documents)")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval tokens of every document."""
    d = documents(spark, sf).select("doc_id", em.tokenize(F.col("text")).alias("t"))
    return d.select(
        "doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"),
        F.sha2(F.array_join("t", " "), 256).alias("token_sha"),
    )


@query(f"WITH {_vec_sql('documents', 'doc_id', 'h')} SELECT doc_id, b AS bucket, round(v, 6) AS value FROM h")
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Signed hashing embedding of every document, as its non-zero buckets.

    The first aggregate combines a document's tokens inside its own partition.
    """
    d = documents(spark, sf).select("doc_id", F.explode(em.signed_codes(em.tokenize(F.col("text")))).alias("c"))
    w = d.groupBy("doc_id", F.floor(F.col("c") / 2).alias("bucket")).agg(F.sum(1 - 2 * (F.col("c") % 2)).alias("s"))
    w = w.filter("s <> 0").withColumn("_n", F.sum(F.col("s") * F.col("s")).over(W.partitionBy("doc_id")))
    return w.select("doc_id", "bucket", F.round(F.col("s") / F.sqrt("_n"), 6).alias("value"))


@query(f"""WITH c AS (SELECT item_id, lower(regexp_replace('passage: ' || text, '{q.WS}', '', 'g')) AS t FROM benchmark),
g AS (SELECT item_id, substr(t, i, n) AS g FROM (SELECT item_id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS n))),
b AS (SELECT item_id, ('0x' || substr(sha256(g), 1, 8))::BIGINT % 384 AS b, count(*)::DOUBLE AS s FROM g GROUP BY ALL)
SELECT item_id, b AS bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY item_id)), 6) AS value FROM b""")
def ngram_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Character n-gram embedding of the corpus, through the vector function."""
    t = table(spark, sf, "benchmark").select("item_id", em.embed_ngrams(F.concat(F.lit("passage: "), F.col("text"))).alias("v"))
    flat = t.select("item_id", F.posexplode("v").alias("bucket", "x")).filter("x <> 0")
    return flat.select("item_id", F.col("bucket").cast("long"), F.round("x", 6).alias("value"))


# ---- hybrid search ---------------------------------------------------------------------------


def evidence_index(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as evidence; some of them also appear in the last collection."""
    b = table(spark, sf, "benchmark")
    ords = F.when(F.col("item_id") % 7 == 0, F.array_distinct(F.array((F.col("item_id") % 5).cast("int"), F.lit(4)))).otherwise(
        F.array((F.col("item_id") % 5).cast("int"))
    )
    names = F.array(*[F.lit(c) for c in COLLECTIONS])
    return b.select(F.col("item_id").alias("evidence_id"), "text", F.explode(ords).alias("collection_ord")).select(
        "evidence_id", "text", "collection_ord", F.get(names, F.col("collection_ord")).alias("collection"),
        F.when(F.col("evidence_id") % 3 != 0, (F.col("evidence_id") % 4) * 0.25).alias("authority_weight"),
        F.concat(F.lit("item "), F.col("evidence_id").cast("string")).alias("title"),
        F.when(F.col("evidence_id") % 2 == 0, "verified").otherwise("unverified").alias("status"),
        F.concat(F.lit("v"), (F.col("evidence_id") % 3).cast("string")).alias("manifest_version"),
    )


def turn_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn as a query."""
    c = spread(table(spark, sf, "conversations"))
    return c.select(F.concat_ws("#", "conv_id", "turn").alias("query_id"), "text", "conv_id", "turn", "role")


def _search_sql(queries: str, index: str, pool: int) -> str:
    """CTEs up to ``fused`` (query_id, item, grp, vs, lexical, score); queries/index have text."""
    return f"""qs AS ({queries}), ix AS ({index}),
it AS (SELECT DISTINCT item, text FROM ix),
{_vec_sql('qs', 'query_id', 'qv')}, {_vec_sql('it', 'item', 'iv')},
dots AS (SELECT query_id, item, sum(qv.v * iv.v) AS d FROM qv JOIN iv ON qv.b = iv.b GROUP BY query_id, item),
prs AS (SELECT qs.query_id, ix.item, ix.grp, coalesce(d, 0) AS vs FROM qs CROSS JOIN ix LEFT JOIN dots ON dots.query_id = qs.query_id AND dots.item = ix.item),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY round(vs, 9) DESC, item) AS r FROM prs) WHERE r <= {pool}),
itf AS (SELECT item, t, count(*) AS tf FROM ivt GROUP BY item, t), il AS (SELECT item, count(*) AS len FROM ivt GROUP BY item),
qt AS (SELECT DISTINCT query_id, t FROM qvt),
pl AS (SELECT pool.*, coalesce(len, 0) AS len, count(*) OVER w AS n, avg(coalesce(len, 0)) OVER w AS av FROM pool LEFT JOIN il ON il.item = pool.item WINDOW w AS (PARTITION BY query_id, grp)),
ht AS (SELECT pl.query_id, pl.grp, pl.item, len, n, av, tf, count(*) OVER (PARTITION BY pl.query_id, pl.grp, itf.t) AS df
 FROM pl JOIN itf ON itf.item = pl.item JOIN qt ON qt.query_id = pl.query_id AND qt.t = itf.t),
bs AS (SELECT query_id, grp, item, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av))) AS s FROM ht GROUP BY ALL),
lx AS (SELECT pool.*, coalesce(s, 0) / CASE WHEN max(coalesce(s, 0)) OVER (PARTITION BY pool.query_id, pool.grp) > 0 THEN max(coalesce(s, 0)) OVER (PARTITION BY pool.query_id, pool.grp) ELSE 1 END AS lexical
 FROM pool LEFT JOIN bs ON bs.query_id = pool.query_id AND bs.grp = pool.grp AND bs.item = pool.item)"""


_INDEX_SQL = """SELECT item_id AS item, text, g AS grp, CASE WHEN item_id % 3 <> 0 THEN (item_id % 4) * 0.25::DOUBLE ELSE 0.5::DOUBLE END AS auth
 FROM (SELECT *, unnest(CASE WHEN item_id % 7 = 0 THEN list_distinct([item_id % 5, 4]) ELSE [item_id % 5] END) AS g FROM benchmark)"""
_TURN_SQL = "SELECT conv_id || '#' || turn AS query_id, text FROM conversations"


def _rank_sql(k: int) -> str:
    return f"""fused AS (SELECT lx.*, round(0.45::DOUBLE * greatest(vs, 0) + 0.4::DOUBLE * lexical + 0.15::DOUBLE * auth, 6) AS score FROM lx JOIN ix ON ix.item = lx.item AND ix.grp = lx.grp),
uq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item ORDER BY grp DESC) AS u FROM fused) WHERE u = 1),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, grp, round(vs, 9) DESC, item) AS rank FROM uq) WHERE rank <= {k})"""


@query(f"WITH {_search_sql(_TURN_SQL, _INDEX_SQL, 20)}, {_rank_sql(5)} SELECT query_id, CAST(rank AS BIGINT) AS rank, item AS evidence_id, score AS relevance_score FROM ranked")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Top five evidence passages for every conversation turn."""
    hits = retrieve.hybrid_search(turn_queries(spark, sf).select("query_id", "text"), evidence_index(spark, sf), 5)
    return hits.select("query_id", F.col("rank").cast("long"), "evidence_id", "relevance_score")


@query(f"WITH {_search_sql(_TURN_SQL, _INDEX_SQL, 20)} SELECT query_id, item AS item_id, grp, round(lexical, 6) AS lexical FROM lx")
def bm25(spark: SparkSession, sf: str) -> DataFrame:
    """Pool-local lexical scores of every turn and its vector neighbours."""
    t, ix = turn_queries(spark, sf), evidence_index(spark, sf)
    words = em.tokenize(F.col("text"))
    codes = em.signed_codes(words).alias("codes")
    pool = nearest(
        t.select("query_id", codes, F.array_distinct(words).alias("tokens")),
        ix.select(F.col("evidence_id").alias("item_id"), F.col("collection_ord").alias("grp"), codes, words.alias("tokens")), 20,
    )
    out = retrieve.bm25(pool, gathered=True)
    return out.select("query_id", "item_id", F.col("grp").cast("long"), F.round("lexical", 6).alias("lexical"))


_CASE_SQL = "SELECT item_id AS query_id, regexp_extract(text, '^[^.]*[.]') AS text FROM benchmark"
_EVAL = f"WITH {_search_sql(_CASE_SQL, _INDEX_SQL, 20)}, {_rank_sql(3)}, hr AS (SELECT b.item_id AS case_id, min(r.rank) AS rank FROM benchmark b LEFT JOIN ranked r ON r.query_id = b.item_id AND r.item = b.item_id GROUP BY 1)"


def _case_ranks(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    cases = b.select(F.col("item_id").alias("query_id"), F.regexp_extract("text", r"^[^.]*[.]", 0).alias("text"))
    hits = retrieve.hybrid_search(cases, evidence_index(spark, sf), 3)
    judged = b.select(F.col("item_id").alias("case_id"), F.array("item_id").alias("expected_evidence_ids"))
    return retrieve.first_relevant(hits, judged)


@query(f"{_EVAL} SELECT case_id, CAST(rank AS BIGINT) AS rank FROM hr")
def hit_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of the expected passage when searching by its first sentence."""
    return _case_ranks(spark, sf).select("case_id", F.col("rank").cast("long"))


@query(f"{_EVAL} SELECT CAST(count(*) AS BIGINT) AS case_count, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6)::DOUBLE AS hit_at_k, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM hr")
def retrieval_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rate and mean reciprocal rank of those searches."""
    return retrieve.retrieval_metrics(_case_ranks(spark, sf))


_TURN_RULES, _TR = q.rule_hits("tc", "conv_id, turn", LATIN_RULES.select(None), prefix="tr")


@query(f"""WITH tc AS (SELECT conv_id, turn, text FROM conversations), {_TURN_RULES}, {_search_sql(_TURN_SQL + " WHERE role <> 'system'", _INDEX_SQL, 20)}, {_rank_sql(3)},
ev AS (SELECT query_id, string_agg(CAST(item AS VARCHAR), ',' ORDER BY rank) AS ids, count(*) AS nn, array_to_string(list_sort(list_distinct(list('v' || (item % 3)))), ',') AS cv FROM ranked GROUP BY query_id)
SELECT f.conv_id, f.turn, f.rule_id, CASE WHEN ids IS NULL THEN 'unavailable' ELSE 'grounded' END AS grounding, CAST(coalesce(nn, 0) AS BIGINT) AS retrieved_count,
 coalesce(cv, 'not_available') AS corpus_version, coalesce(ids, array_to_string(list_transform(range(1, len(legal_basis) + 1), lambda i: 'candidate:' || f.rule_id || ':' || i), ',')) AS evidence_ids
FROM {_TR} f LEFT JOIN ev ON ev.query_id = f.conv_id || '#' || f.turn""")
def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Findings in turns with their evidence; system turns have none and fall back to the rule's own."""
    t = turn_queries(spark, sf)
    f = screen.screen(t, LATIN_RULES)
    hits = retrieve.hybrid_search(t.filter("role <> 'system'").select("query_id", "text"), evidence_index(spark, sf), 3)
    hits = hits.withColumn("evidence_id", F.col("evidence_id").cast("string"))
    a = retrieve.attach_evidence(f, hits, ["query_id"])
    return a.select(
        "conv_id", "turn", "rule_id", "grounding", F.col("retrieved_count").cast("long"), "corpus_version",
        F.array_join(F.transform("evidence", lambda e: e["evidence_id"]), ",").alias("evidence_ids"),
    )


@query("""SELECT lang, array_to_string(list_sort(list_distinct(list(CASE WHEN n_chars % 7 = 0 THEN 'unknown' ELSE 'v' || (n_chars % 3) END))), ',') AS corpus_version FROM documents GROUP BY lang""")
def corpus_version(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of the evidence per group."""
    d = table(spark, sf, "documents").select(
        "lang", F.when(F.col("n_chars") % 7 != 0, F.concat(F.lit("v"), (F.col("n_chars") % 3).cast("string"))).alias("manifest_version")
    )
    return retrieve.corpus_version(d, ["lang"])


# ---- semantic candidates ---------------------------------------------------------------------

_T, _G = 0.10, 0.02


def _prototype_tables(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two lowest ids of each label: the first is the prototype, the second the hard negative."""
    two = top_rows(e, ["category"], ["vec_id"], 2, "n")
    pos = two.filter("n = 1").select(
        F.concat(F.lit("L"), F.col("category").cast("string")).alias("rule_id"), "category",
        F.concat(F.lit("L"), F.col("category").cast("string"), F.lit(":p1")).alias("prototype_id"), F.col("vec_id").alias("ord"), "vec",
    )
    return pos, two.filter("n = 2").select("category", "vec")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("category"), F.col("embedding").cast("array<double>").alias("vec"))


def _dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


_KNN = f"""p AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
sc AS (SELECT e.vec_id, e.label AS own, a.label AS category, 'L' || a.label AS rule_id, {_dot_sql('e.embedding', 'a.embedding')} AS s, {_dot_sql('e.embedding', 'b.embedding')} AS ns
 FROM embeddings e CROSS JOIN (SELECT * FROM p WHERE n = 1) a JOIN (SELECT * FROM p WHERE n = 2) b ON b.label = a.label),
ok AS (SELECT *, s - ns AS gap FROM sc WHERE s >= {_T} AND s - ns >= {_G})"""
_CAND_COLS = "category, rule_id, rule_id || ':p1' AS prototype_id, round(s, 6) AS similarity_score, round(gap, 6) AS similarity_margin, CASE WHEN round(s, 6) >= 0.85 THEN 'high' ELSE 'medium' END AS confidence, CAST(rank AS BIGINT) AS rank"


def _shape(ranked: DataFrame, *keys: str) -> DataFrame:
    return ranked.select(
        *keys, F.col("rank").cast("long"), "category", "rule_id", "prototype_id", "similarity_score", "similarity_margin", "confidence"
    )


def _scored(spark: SparkSession, sf: str, keys: list[str], segments: DataFrame) -> DataFrame:
    pos, neg = _prototype_tables(_vectors(spark, sf))
    return cand.category_scores(segments, pos, neg, keys, _T, _G)


@query("""WITH r AS (SELECT source AS rule_id, min(lang) AS category, list_sort(list_distinct(list(lang))) AS terms FROM documents GROUP BY source),
t AS (SELECT 'src' || (item_id % 27) AS rule_id, item_id, text, (item_id // 27) % 2 = 0 AND item_id % 5 <> 0 AS positive FROM benchmark),
o AS (SELECT rule_id, list(text ORDER BY item_id) AS own FROM t WHERE positive GROUP BY rule_id),
p AS (SELECT rule_id, category, coalesce(own, terms) AS texts FROM r LEFT JOIN o USING (rule_id))
SELECT 'positive' AS kind, category, rule_id || ':p' || n AS prototype_id, sha256(texts[n]) AS text_sha FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS n FROM p)
UNION ALL SELECT 'negative', category, NULL, sha256(text) FROM t JOIN r USING (rule_id) WHERE NOT positive
UNION ALL SELECT 'negative', category, NULL, sha256('shared') FROM r""")
def prototype_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Prototypes of the sources from benchmark items; sources without items fall back to their languages."""
    rules = table(spark, sf, "documents").groupBy(F.col("source").alias("rule_id")).agg(
        F.min("lang").alias("category"), F.array_sort(F.collect_set("lang")).alias("candidate_terms")
    )
    rules = rules.withColumn("rule_ord", F.regexp_extract("rule_id", "[0-9]+", 0).cast("int"))
    i = F.col("item_id")
    taxonomy = table(spark, sf, "benchmark").select(
        F.concat(F.lit("src"), (i % 27).cast("string")).alias("rule_id"),
        F.when((F.floor(i / 27) % 2 == 0) & (i % 5 != 0), "positive").otherwise("negative").alias("polarity"), i.alias("ord"), "text",
    )
    pos, neg = cand.prototypes(rules, taxonomy, "shared")
    named = pos.select(F.lit("positive").alias("kind"), "category", "prototype_id", sha("text").alias("text_sha"))
    return named.unionByName(neg.select(F.lit("negative").alias("kind"), "category", F.lit(None).cast("string").alias("prototype_id"), sha("text").alias("text_sha")))


@query(f"WITH {_KNN} SELECT vec_id, {_CAND_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, rule_id) AS rank FROM ok) WHERE rank <= 2")
def knn_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Best two categories per vector, above threshold and margin."""
    segs = _vectors(spark, sf).withColumn("segment_ord", F.lit(0))
    return _shape(cand.rank_candidates(_scored(spark, sf, ["vec_id", "segment_ord"], segs), ["vec_id"], "segment_ord"), "vec_id")


@query(f"WITH {_KNN} SELECT vec_id, {_CAND_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, rule_id) AS rank FROM ok WHERE own <> category) WHERE rank <= 2")
def exclude_matched(spark: SparkSession, sf: str) -> DataFrame:
    """The same after removing categories already found by a rule, which lets others move up."""
    segs = _vectors(spark, sf).withColumn("segment_ord", F.lit(0))
    ranked = cand.rank_candidates(
        _scored(spark, sf, ["vec_id", "segment_ord"], segs), ["vec_id"], "segment_ord", excluded=_vectors(spark, sf)
    )
    return _shape(ranked, "vec_id")


@query(f"""WITH {_KNN}, sg AS (SELECT * FROM (SELECT *, vec_id // 3 AS clause_id, vec_id % 3 AS seg, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, rule_id) AS sr FROM ok) WHERE sr <= 2),
b AS (SELECT clause_id, category, arg_max(struct_pack(rule_id := rule_id, s := s, gap := gap, seg := seg), round(s, 6) * 1000 - seg * 1e-6::DOUBLE) AS b, min(seg * 10 + sr) AS f FROM sg GROUP BY 1, 2)
SELECT clause_id, segment_ord, {_CAND_COLS} FROM (SELECT clause_id, category, b.rule_id AS rule_id, b.s AS s, b.gap AS gap, CAST(b.seg AS BIGINT) AS segment_ord,
 row_number() OVER (PARTITION BY clause_id ORDER BY round(b.s, 6) DESC, f) AS rank FROM b) WHERE rank <= 2""")
def segment_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Best segment per category over three segments of a clause, then the best two categories."""
    segs = _vectors(spark, sf).select(F.floor(F.col("vec_id") / 3).alias("clause_id"), (F.col("vec_id") % 3).alias("segment_ord"), "vec")
    ranked = cand.rank_candidates(_scored(spark, sf, ["clause_id", "segment_ord"], segs), ["clause_id"], "segment_ord")
    return _shape(ranked, "clause_id", "segment_ord")


@query("""SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'R' || lpad(CAST(n_chars % 90 + 10 AS VARCHAR), 2, '0') || '_' || upper(lang) ELSE 'rule-' || lang END AS rule_id FROM documents""")
def candidate_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Rule of a candidate: from its id when present, else by its category."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    marked = F.concat(F.lit("R"), F.lpad((F.col("n_chars") % 90 + 10).cast("string"), 2, "0"), F.lit("_"), F.upper("lang"))
    cid = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("candidate:"), marked)).otherwise(F.concat(F.lit("candidate:article:1:"), F.col("lang")))
    return d.select("doc_id", cand.rule_of_candidate(cid, F.concat(F.lit("rule-"), F.col("lang"))).alias("rule_id"))


# ---- exception gate --------------------------------------------------------------------------

_FACTORS = [("connector", [" the | la ", " der "]), ("ending", ["tion|ment", "keit"]), ("mark", ["License|token", "[0-9]{4}"])]
_MIN, _GAP, _CARDS, _KEEP = 0.35, 0.02, 6, 4


def _gate_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = _vectors(spark, sf).join(texts, "vec_id").withColumn("rule_id", F.concat(F.lit("L"), F.col("category").cast("string")))
    groups = F.array(*[
        F.struct(F.lit(c).alias("code"), F.array(*[F.lit(p) for p in ps]).alias("patterns")) for c, ps in _FACTORS
    ])
    cards = top_rows(rows, ["rule_id"], ["vec_id"], _CARDS, "n").select(
        F.col("vec_id").alias("card_id"), "rule_id", F.when(F.col("n") % 2 == 1, "risk_pattern").otherwise("safe_exception").alias("polarity"),
        F.slice(groups, 1, F.pmod("n", F.lit(3)) + 1).alias("factor_groups"), "text", "vec",
    )
    return rows.select(F.col("vec_id").alias("candidate_id"), "rule_id", "text", "vec"), cards


_FSQL = ", ".join("(" + " OR ".join(f"regexp_matches(c.text, '{p}')" for p in ps) + ")" for _, ps in _FACTORS)
_GATE = f"""src AS (SELECT e.vec_id, 'L' || e.label AS rule_id, e.embedding, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
cards AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY vec_id) AS n FROM src) WHERE n <= {_CARDS}),
tk AS (SELECT vec_id, unnest({_TOK}) AS t FROM src),
pr AS (SELECT c.vec_id AS cid, k.vec_id AS kid, k.n, c.rule_id, c.text, {_dot_sql('c.embedding', 'k.embedding')} AS vs, list_slice([{_FSQL}], 1, CAST(k.n % 3 + 1 AS BIGINT)) AS fl
 FROM src c JOIN cards k ON k.rule_id = c.rule_id),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY round(vs, 9) DESC, kid) AS r FROM pr) WHERE r <= {_KEEP}),
itf AS (SELECT vec_id, t, count(*) AS tf FROM tk GROUP BY 1, 2), il AS (SELECT vec_id, sum(tf) AS len FROM itf GROUP BY 1),
pl AS (SELECT pool.cid, pool.kid, coalesce(len, 0)::DOUBLE AS len, count(*) OVER w AS n, avg(coalesce(len, 0)::DOUBLE) OVER w AS av FROM pool LEFT JOIN il ON il.vec_id = kid WINDOW w AS (PARTITION BY cid)),
ht AS (SELECT cid, kid, len, n, av, a.tf, count(*) OVER (PARTITION BY cid, a.t) AS df FROM pl JOIN itf a ON a.vec_id = kid JOIN itf b ON b.vec_id = cid AND b.t = a.t),
bs AS (SELECT cid, kid, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av))) AS s FROM ht GROUP BY 1, 2),
hits AS (SELECT pool.cid, pool.kid, pool.n % 2 = 1 AS risk, fl, len(list_filter(fl, lambda x: x)) AS fm, len(fl) AS fc,
 round(0.6::DOUBLE * greatest(vs, 0) + 0.2::DOUBLE * coalesce(s / nullif(max(s) OVER (PARTITION BY pool.cid), 0), 0) + 0.2::DOUBLE * len(list_filter(fl, lambda x: x)) / len(fl), 6) AS score
 FROM pool LEFT JOIN bs ON bs.cid = pool.cid AND bs.kid = pool.kid),
best AS (SELECT *, row_number() OVER (PARTITION BY cid, risk ORDER BY score DESC, kid) AS k FROM hits),
gt AS (SELECT src.vec_id AS cid, coalesce(r.score, 0) AS rs, coalesce(e.score, 0) AS es,
 CASE WHEN coalesce(e.score, 0) >= {_MIN} AND e.fm = e.fc THEN 'contested' WHEN coalesce(r.score, 0) >= {_MIN} AND coalesce(r.score, 0) - coalesce(e.score, 0) >= {_GAP} AND r.fm >= 2 THEN 'supported' ELSE 'insufficient' END AS status,
 r.fl AS rfl, e.fl AS efl FROM src LEFT JOIN best r ON r.cid = src.vec_id AND r.risk AND r.k = 1 LEFT JOIN best e ON e.cid = src.vec_id AND NOT e.risk AND e.k = 1)"""
_CODES = ", ".join(f"CASE WHEN coalesce(fl[{i + 1}], false) THEN '{c}' END" for i, (c, _) in enumerate(_FACTORS))


@query(f"WITH {_GATE} SELECT cid AS candidate_id, kid AS card_id, score, round(fm / fc, 6) AS factor_score, concat_ws(',', {_CODES}) AS factor_codes FROM hits")
def cards_top8(spark: SparkSession, sf: str) -> DataFrame:
    """Scored decision cards per candidate: vector top few, then re-scored."""
    c, k = _gate_tables(spark, sf)
    h = cand.search_cards(c, k, keep=_KEEP)
    return h.select("candidate_id", "card_id", "score", F.round("factor_score", 6).alias("factor_score"), F.array_join("factor_codes", ",").alias("factor_codes"))


@query(f"WITH {_GATE} SELECT cid AS candidate_id, status, rs AS support_score, es AS exception_score, status <> 'contested' AS kept, concat_ws(',', {_CODES.replace('fl[', 'fl[')}) AS matched_factors FROM (SELECT *, CASE WHEN status = 'contested' THEN efl ELSE rfl END AS fl FROM gt)")
def cards_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Gate decision per candidate."""
    c, k = _gate_tables(spark, sf)
    g = cand.gate(cand.search_cards(c, k, keep=_KEEP), c, min_score=_MIN, margin=_GAP)
    return g.select("candidate_id", "status", "support_score", "exception_score", "kept", F.array_join("matched_factors", ",").alias("matched_factors"))


@query(f"WITH {_GATE} SELECT CAST(count_if(status = 'supported') AS BIGINT) AS supported, CAST(count_if(status = 'contested') AS BIGINT) AS contested, CAST(count_if(status = 'insufficient') AS BIGINT) AS insufficient, round(count_if(status = 'insufficient') / count(*), 6) AS insufficient_rate FROM gt")
def gate_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the gate."""
    c, k = _gate_tables(spark, sf)
    return cand.gate_counts(cand.gate(cand.search_cards(c, k, keep=_KEEP), c, min_score=_MIN, margin=_GAP))


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS calls, CAST(sum(greatest(1, length(text) // 3)) AS BIGINT) AS total_estimated_input_tokens, CAST(sum(CASE role WHEN 'assistant' THEN 1600 ELSE 700 END) AS BIGINT) AS total_max_output_tokens FROM conversations GROUP BY conv_id""")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Token estimates per conversation."""
    c = table(spark, sf, "conversations").select(
        "conv_id", modelio.input_tokens(F.col("text")).alias("estimated_input_tokens"),
        F.when(F.col("role") == "assistant", 1600).otherwise(700).alias("max_output_tokens"),
    )
    return modelio.usage_totals(c, "conv_id")


@query("SELECT item_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces FROM benchmark")
def encoder_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a user's encoder in place of the hashed ones: an encoder of two plain numbers."""
    vectors = em.embed(F.col("text"), lambda texts: [[len(t), t.count(" ")] for t in texts])
    return table(spark, sf, "benchmark").select("item_id", vectors.alias("v")).select(
        "item_id", F.get("v", F.lit(0)).alias("chars"), F.get("v", F.lit(1)).alias("spaces")
    )


@query(f"""WITH {_search_sql(_CASE_SQL, _INDEX_SQL, 20)}, {_rank_sql(3)},
g AS (SELECT query_id, rank, item FROM ranked), n AS (SELECT b.item_id AS case_id, count(g.item) AS hits, count(*) FILTER (g.item = b.item_id) AS own FROM benchmark b LEFT JOIN g ON g.query_id = b.item_id GROUP BY 1)
SELECT case_id, CAST(hits AS BIGINT) AS hits, CAST(own AS BIGINT) AS own FROM n""")
def blocked_search(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of each case, with an index that is cut into many small blocks: the pool is merged from all of them."""
    b = table(spark, sf, "benchmark")
    cases = b.select(F.col("item_id").alias("query_id"), F.regexp_extract("text", r"^[^.]*[.]", 0).alias("text"))
    hits = retrieve.hybrid_search(cases, evidence_index(spark, sf), 3, tile_rows=16)
    per = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(F.col("evidence_id") == F.col("query_id")).alias("own")
    )
    every = b.select(F.col("item_id").alias("case_id"))
    return every.join(per, F.col("case_id") == F.col("query_id"), "left").select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "own")])
