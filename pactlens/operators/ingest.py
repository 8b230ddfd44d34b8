"""Provenance gates and idempotent corpus upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.constants import CARD_FIELDS, COLLECTIONS, DEFAULT_AUTHORITY, RECORD_FIELDS, RISK_LEVELS
from pactlens.operators.prefix import top_rows

# The manifest contract. Type letters: s text, u URI, n count, a list of text,
# b boolean or null, o text or null, plus enumerations.
MANIFEST_REQUIRED = ["manifest_version", "generated_at", "cutoff_date", "status", "datasets"]
MANIFEST_OPTIONAL = ["known_limitations"]
MANIFEST_STATUS = ["unverified", "reviewing", "verified"]
DATASET_REQUIRED = {
    "dataset_id": "s", "corpus_type": COLLECTIONS, "source_name": "s", "source_url": "u", "authority": "s",
    "collection_method": "s", "inclusion_criteria": "a", "exclusion_criteria": "a", "raw_count": "n",
    "deduplicated_count": "n", "accepted_count": "n", "rejected_count": "n", "deduplication_key": "s",
    "license_status": ["unknown", "reviewing", "approved", "restricted"], "license_basis": "s",
    "license_basis_url": "u", "redistribution_allowed": "b",
    "review_status": ["unverified", "reviewing", "verified", "rejected"],
}
DATASET_OPTIONAL = {"content_hash": "t", "reviewer": "o", "known_limitations": "a", "evaluation_exclusion": "B"}

DATE = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
URI = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$"


def _kind(v: Column, path: str) -> Column:
    """JSON type of a member: STRING, BIGINT, BOOLEAN, VOID, ARRAY<...>; NULL when absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _bad(v: Column, key: str, rule) -> Column:
    path = f"$.{key}"
    kind, text = _kind(v, path), F.try_variant_get(v, path, "string")
    is_text = kind == "STRING"
    if isinstance(rule, list):
        ok = is_text & text.isin(rule)
    else:
        ok = {
            "s": is_text & (F.length(text) >= 1),
            "t": is_text,
            "u": is_text & text.rlike(URI),
            "n": (kind == "BIGINT") & (F.try_variant_get(v, path, "bigint") >= 0),
            "a": kind.isin("ARRAY<STRING>", "ARRAY<VOID>") | (text == "[]"),
            "b": kind.isin("BOOLEAN", "VOID"),
            "B": kind == "BOOLEAN",
            "o": kind.isin("STRING", "VOID"),
        }[rule]
    return ~F.coalesce(ok, F.lit(False))


def _names(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))


def _extra(json: Column, allowed: Sequence[str], prefix: str) -> Column:
    extra = F.array_sort(F.array_except(_names(json), F.array(*[F.lit(a) for a in allowed])))
    return F.transform(extra, lambda k: F.concat(F.lit(f"{prefix}extra:"), k))


def gate_manifest(manifests: DataFrame, key: str, body: str = "manifest") -> DataFrame:
    """Check manifests kept as JSON text: (key, violations, accepted).

    Closed schema first, every violation listed as ``code:field``; then the status must be verified.
    """
    v = F.col("_v")
    parsed = manifests.select(key, F.col(body).alias("_j"), F.try_parse_json(body).alias("_v"))
    names = _names(F.col("_j"))
    header = [
        F.when(~F.array_contains(names, k), F.lit(f"missing:{k}")) for k in MANIFEST_REQUIRED
    ]
    typed = [
        ("manifest_version", _bad(v, "manifest_version", "s")),
        ("generated_at", ~F.coalesce(F.try_variant_get(v, "$.generated_at", "string").rlike(DATE_TIME), F.lit(False))),
        ("cutoff_date", ~F.coalesce(
            F.try_variant_get(v, "$.cutoff_date", "string").rlike(DATE)
            & F.try_variant_get(v, "$.cutoff_date", "string").try_cast("date").isNotNull(), F.lit(False))),
        ("status", _bad(v, "status", MANIFEST_STATUS)),
        ("datasets", ~F.coalesce(F.startswith(F.to_json(F.try_variant_get(v, "$.datasets", "variant")), F.lit("[")), F.lit(False))),
        ("known_limitations", _bad(v, "known_limitations", "a")),
    ]
    header += [F.when(F.array_contains(names, k) & bad, F.lit(f"invalid:{k}")) for k, bad in typed]
    sets = F.coalesce(F.from_json(F.get_json_object("_j", "$.datasets"), "array<string>"), F.array().cast("array<string>"))
    broken = F.col("_v").isNull()
    doc_level = parsed.select(
        key,
        "_j",
        sets.alias("_sets"),
        F.try_variant_get(v, "$.status", "string").alias("_status"),
        F.when(broken, F.array(F.lit("invalid_json"))).otherwise(
            F.concat(_extra(F.col("_j"), MANIFEST_REQUIRED + MANIFEST_OPTIONAL, ""), F.array_compact(F.array(*header)))
        ).alias("_top"),
    )
    exploded = doc_level.select(key, F.posexplode_outer("_sets").alias("_i", "_d")).filter("_d IS NOT NULL").select(
        key, "_i", "_d", F.try_parse_json("_d").alias("_v")
    )
    have = _names(F.col("_d"))
    checks = [F.when(~F.array_contains(have, k), F.lit(f"missing:{k}")) for k in DATASET_REQUIRED]
    checks += [
        F.when(F.array_contains(have, k) & _bad(v, k, rule), F.lit(f"invalid:{k}"))
        for k, rule in {**DATASET_REQUIRED, **DATASET_OPTIONAL}.items()
    ]
    found = F.concat(
        _extra(F.col("_d"), [*DATASET_REQUIRED, *DATASET_OPTIONAL], ""), F.array_compact(F.array(*checks))
    )
    per_set = (
        exploded.select(key, "_i", F.explode_outer(found).alias("_f")).filter("_f IS NOT NULL")
        .groupBy(key).agg(F.array_sort(F.collect_list(F.concat(F.lit("datasets."), F.col("_i").cast("string"), F.lit("."), "_f"))).alias("_in"))
    )
    joined = doc_level.join(per_set, key, "left")
    schema_bad = F.array_sort(F.concat("_top", F.coalesce("_in", F.array().cast("array<string>"))))
    return joined.select(
        key,
        F.when(
            (F.size(schema_bad) == 0) & ~F.coalesce(F.col("_status") == "verified", F.lit(False)),
            F.array(F.lit("not_verified")),
        ).otherwise(schema_bad).alias("violations"),
    ).withColumn("accepted", F.size("violations") == 0)


def gate_records(records: DataFrame, manifest_version: Column) -> DataFrame:
    """Add violations (missing fields, unknown corpus type, version mismatch) and accepted."""
    missing = F.array_sort(
        F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in RECORD_FIELDS]))
    )
    notes = F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))),
            F.when(F.col("corpus_type").isNotNull() & ~F.col("corpus_type").isin(COLLECTIONS), F.lit("unknown_corpus_type")),
            F.when(F.col("manifest_version") != manifest_version, F.lit("version_mismatch")),
        )
    )
    return records.withColumn("violations", notes).withColumn("accepted", F.size("violations") == 0)


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def gate_annotations(annotations: DataFrame) -> DataFrame:
    """Row and set rules for blinded expert judgments: (case_id, reviewer_id, violations, accepted).

    ``extra_fields`` (array) lists fields outside the contract, when the reader kept them.
    """
    lists = ["evidence_ids", "reason_codes", "review_question_codes"]
    extra = F.size("extra_fields") > 0 if "extra_fields" in annotations.columns else F.lit(False)
    pairs = annotations.groupBy("case_id", "reviewer_id").agg(F.count(F.lit(1)).alias("_pair"))
    cases = annotations.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    spread_of = cases.agg(F.min("_n").alias("lo"), F.max("_n").alias("hi"))
    uneven = spread_of.select(F.col("lo") != F.col("hi")).scalar()
    few = spread_of.select(F.col("lo") < 2).scalar()
    joined = annotations.join(pairs, ["case_id", "reviewer_id"], "left")
    notes = [
        F.when(extra, F.lit("unknown_field")),
        *[F.when(_blank(c), F.lit(f"blank:{c}")) for c in ("case_id", "reviewer_id", "risk_level")],
        F.when(~_blank("risk_level") & ~F.col("risk_level").isin(RISK_LEVELS), F.lit("unknown_level")),
        F.when(~F.coalesce("blinded", F.lit(False)), F.lit("not_blinded")),
        *[
            F.when(
                F.col(c).isNull() | F.exists(c, lambda x: F.coalesce(F.trim(x) == "", F.lit(True))), F.lit(f"bad_list:{c}")
            )
            for c in lists
        ],
        F.when(F.col("_pair") > 1, F.lit("duplicate_pair")),
        F.when(uneven, F.lit("uneven_reviewers")),
        F.when(few, F.lit("too_few_reviewers")),
    ]
    return joined.withColumn("violations", F.array_compact(F.array(*notes))).withColumn(
        "accepted", F.size("violations") == 0
    ).drop("_pair")


def gate_cards(cards: DataFrame) -> DataFrame:
    """Add violations for decision cards: missing fields, polarity, review status, duplicate ids."""
    dup = cards.groupBy("card_id").agg(F.count(F.lit(1)).alias("_dup"))
    missing = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in CARD_FIELDS])))
    notes = F.array_compact(
        F.array(
            F.when(F.col("_dup") > 1, F.lit("duplicate_id")),
            F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))),
            F.when(~F.col("polarity").isin("risk_pattern", "safe_exception"), F.lit("unknown_polarity")),
            F.when(F.col("review_status") != "synthetic_verified", F.lit("unverified")),
        )
    )
    return cards.join(dup, "card_id", "left").withColumn("violations", notes).withColumn(
        "accepted", F.size("violations") == 0
    ).drop("_dup")


def source_hash(text: Column) -> Column:
    """Provenance hash of a record's text."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def hash_reconcile(corpus: DataFrame, manifest: DataFrame, key: str = "corpus_type") -> DataFrame:
    """Per dataset: record count against accepted_count and number of wrong record hashes."""
    got = corpus.groupBy(key).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(F.col("source_hash") != source_hash(F.col("text"))).alias("hash_mismatches"),
    )
    return manifest.select(key, "accepted_count").join(got, key, "full").select(
        key, "accepted_count", F.coalesce("record_count", F.lit(0)).alias("record_count"),
        F.coalesce("hash_mismatches", F.lit(0)).alias("hash_mismatches"),
        F.coalesce((F.col("accepted_count") == F.col("record_count")) & (F.col("hash_mismatches") == 0), F.lit(False)).alias("reconciled"),
    )


def stable_id(document_id: Column, chunk_id: Column) -> Column:
    """Identity of a chunk across ingests."""
    return F.concat_ws(":", document_id, chunk_id)


def upsert_plan(existing: DataFrame, incoming: DataFrame, meta: Sequence[str], order: str) -> DataFrame:
    """Action per incoming id: add, update or skip; also carries the incoming columns.

    Only metadata present (not NULL) on the incoming row is compared. Of several rows with one id
    the last by ``order`` wins. Unchanged rows are known before anything is embedded again.
    """
    newest = top_rows(incoming, ["stable_id"], [F.col(order).desc()], 1, "_r").drop("_r")
    newest = newest.withColumn("authority_weight", F.coalesce("authority_weight", F.lit(DEFAULT_AUTHORITY)))
    compared = [*meta, "authority_weight"]
    old = existing.select("stable_id", *[F.col(c).alias(f"_old_{c}") for c in [*compared, "source_hash"]], F.lit(True).alias("_known"))
    same = F.col("source_hash") == F.col("_old_source_hash")
    for c in compared:
        same = same & (F.col(c).isNull() | F.coalesce(F.col(c) == F.col(f"_old_{c}"), F.lit(False)))
    joined = newest.join(old, "stable_id", "left")
    return joined.withColumn(
        "action", F.when(F.col("_known").isNull(), "add").when(F.coalesce(same, F.lit(False)), "skip").otherwise("update")
    ).drop("_known", *[c for c in joined.columns if c.startswith("_old_")])


def upsert_index(existing: DataFrame, plan: DataFrame) -> DataFrame:
    """The new snapshot: existing rows not replaced, plus added and updated rows."""
    changed = plan.filter(F.col("action") != "skip").drop("action")
    kept = existing.join(changed.select("stable_id"), "stable_id", "left_anti")
    return kept.unionByName(changed.select(*[c for c in existing.columns if c in changed.columns]), allowMissingColumns=True)


def sync_cards(existing: DataFrame, cards: DataFrame, key: str = "card_id", version: str = "card_version") -> DataFrame:
    """Plan per card: delete stale, add missing, update on a version change, else skip.

    Only the version decides about a change; an edited text under the same version is not noticed.
    """
    old = existing.select(key, F.col(version).alias("_old"), F.lit(True).alias("_was"))
    new = cards.select(key, F.col(version).alias("_new"), F.lit(True).alias("_is"))
    return old.join(new, key, "full").select(
        key,
        F.when(F.col("_is").isNull(), "delete")
        .when(F.col("_was").isNull(), "add")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "skip")
        .otherwise("update")
        .alias("action"),
    )


def provider_guard(collections: DataFrame, records: DataFrame, provider: Column) -> DataFrame:
    """Refuse an index built with another embedding: one row per collection with the verdict.

    A collection without a provider takes over the records' provider when they all agree, or the
    configured one when it is empty.
    """
    seen = records.groupBy("collection").agg(
        F.min("provider").alias("_lo"), F.max("provider").alias("_hi"), F.count(F.lit(1)).alias("record_count")
    )
    joined = collections.join(seen, "collection", "left").withColumn("record_count", F.coalesce("record_count", F.lit(0)))
    inherited = F.when(F.col("record_count") == 0, provider).when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
    return joined.withColumn("effective", F.coalesce("provider", inherited)).select(
        "collection", "record_count", "effective",
        (~F.coalesce(F.col("effective") == provider, F.lit(False))).alias("violation"),
    )


def collection_counts(index: DataFrame, collection: str = "collection") -> DataFrame:
    """Rows per known collection; empty collections appear with zero."""
    names = index.sparkSession.createDataFrame([(n,) for n in COLLECTIONS], "collection string")
    counts = index.groupBy(F.col(collection).alias("collection")).agg(F.count(F.lit(1)).alias("records"))
    return names.join(counts, "collection", "left").select(
        "collection", F.coalesce("records", F.lit(0)).alias("records"),
        (F.coalesce("records", F.lit(0)) == 0).alias("empty"),
    )
