"""Metrics, calibration, routing, schema checks and ingestion against gold rows and brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlens import schemas
from pactlens.operators import evaluate as ev
from pactlens.operators import ingest, lifecycle, modelio, retrieve
from pactlens.operators.prefix import running_offsets, salted_join
from pactlens.operators.similar import nearest
from pactlens.packs import korean
from pactlens.packs.defaults import KOREAN_RULES
from pactlens.sources import readers, writers

LEVELS = [("001", "high", "high"), ("002", "low", "medium"), ("003", "none", "none")]


def _annotations(spark):
    rows = [(c, r, v, ["e"], ["c"], ["q"], True) for c, a, b in LEVELS for r, v in (("ra", a), ("rb", b))]
    return spark.createDataFrame(rows, schemas.ANNOTATION)


def test_kappa_gold(spark):
    k = ev.fleiss_kappa(_annotations(spark)).collect()[0]
    assert (k.exact_agreement_rate, k.fleiss_kappa, k.case_count) == (0.666667, 0.538462, 3)
    assert {r.case_id for r in ev.disagreements(_annotations(spark)).collect()} == {"002"}


def test_annotation_gate(spark):
    good = ingest.gate_annotations(_annotations(spark))
    assert good.filter("NOT accepted").count() == 0
    bad = _annotations(spark).limit(1).withColumn("risk_level", F.lit("severe")).withColumn("blinded", F.lit(False)).withColumn("case_id", F.lit("004"))
    got = ingest.gate_annotations(_annotations(spark).unionByName(bad)).filter("case_id = '004'").collect()[0]
    assert {"unknown_level", "not_blinded", "uneven_reviewers", "too_few_reviewers"} <= set(got.violations)


def test_calibration_equals_brute_force(spark):
    rnd = random.Random(5)
    for floor in (0.75, 0.5, 0.99):
        rows = [(round(rnd.random(), 2), rnd.random() < 0.6) for _ in range(60)]
        best = (0.0, 0.72)
        for t in sorted({s for s, _ in rows}):
            tp = sum(p and s >= t for s, p in rows)
            fp = sum((not p) and s >= t for s, p in rows)
            fn = sum(p and s < t for s, p in rows)
            if tp + fp and tp / (tp + fp) >= floor:
                pr, re = tp / (tp + fp), tp / (tp + fn) if tp + fn else 0.0
                best = max(best, (2 * pr * re / (pr + re) if pr + re else 0.0, t))
        df = spark.createDataFrame(rows, "score double, positive boolean")
        assert ev.calibrate_threshold(df, floor).collect()[0].threshold == best[1]
    empty = spark.createDataFrame([(0.9, False)], "score double, positive boolean")
    assert ev.calibrate_threshold(empty).collect()[0].threshold == 0.72
    assert ev.calibrate_threshold(empty.limit(0)).collect()[0].threshold == 0.72


def test_close_scores_are_spread_over_ranges(spark):
    """Scores within a thousandth of each other: the curve is right at every one of them."""
    close = spark.range(20_000).select((F.lit(0.5) + F.col("id") / 2e7).alias("score"), (F.xxhash64("id") % 3 == 0).alias("positive"))
    rows = sorted(((r.score, r.positive) for r in close.collect()), reverse=True)
    total, tp, want = sum(p for _, p in rows), 0, {}
    for i, (score, positive) in enumerate(rows):
        tp += positive
        want[score] = (round(tp / (i + 1), 9), round(tp / total, 9))
    assert {r.threshold: (round(r.precision, 9), round(r.recall, 9)) for r in ev.threshold_curve(close).collect()} == want


def test_prefix_sums_and_salted_join_on_a_hot_key(spark):
    rows = [(1, i, i % 7) for i in range(5000)] + [(2, i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = {(r.k, r.o): r.v_before for r in running_offsets(df, ["k"], "o", ["v"], block=64).collect()}
    total = 0
    for i in range(5000):
        assert got[(1, i)] == total
        total += i % 7
    side = spark.createDataFrame([(1, "a")], "k int, s string")
    assert salted_join(df, side, ["k"], "inner", ["o"]).count() == 5000
    assert salted_join(df, side, ["k"], "left_anti", ["o"]).count() == 10


def test_tiles_equal_broadcast_scoring(spark):
    rnd = random.Random(1)
    q = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)], "query_id long, vec array<double>")
    ix = spark.createDataFrame([(i, i % 3, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(90)], "item_id long, grp int, vec array<double>")
    small = {(r.query_id, r.grp, r.item_id): round(r.score, 9) for r in nearest(q, ix, 4).collect()}
    tiled = {(r.query_id, r.grp, r.item_id): round(r.score, 9) for r in nearest(q, ix, 4, tile_rows=25).collect()}
    assert len(small) == 60 * 3 * 4 and small == tiled
    assert nearest(q, ix.limit(0), 4).count() == 0


def test_nearest_over_a_large_index(spark):
    """50,000 index rows in blocks: the same best rows as one matrix product, and no row through the driver."""
    rng = np.random.default_rng(3)
    ix = spark.range(50_000).select(F.col("id").alias("item_id"), (F.col("id") % 2).cast("int").alias("grp"), F.array(
        *[((F.xxhash64("id", F.lit(j)) % 1000) / 1000.0) for j in range(16)]).alias("vec"))
    m = np.array([r.vec for r in ix.orderBy("item_id").collect()])
    q = rng.normal(size=(40, 16))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<double>")
    found = nearest(queries, ix, 5)
    got = {(r.query_id, r.grp, r.item_id): round(r.score, 7) for r in found.collect()}
    want = {}
    for i, row in enumerate(np.round(q @ m.T, 9)):
        for g in range(2):
            best = sorted(range(g, 50_000, 2), key=lambda j: (-row[j], j))[:5]
            want |= {(i, g, j): round(row[j], 7) for j in best}
    assert got == want
    plan = found._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "CartesianProduct" not in plan


def test_shared_tokens_by_postings_and_by_join(spark):
    words = ["a", "b", "c", "d", "e", "f", "g"]
    rnd = random.Random(5)
    texts = lambda n: [[rnd.choice(words) for _ in range(rnd.randint(0, 9))] for _ in range(n)]
    vec = lambda: [rnd.gauss(0, 1) for _ in range(4)]
    ix = spark.createDataFrame([(i, i % 2, vec(), t) for i, t in enumerate(texts(60))], "item_id long, grp int, vec array<double>, tokens array<string>")
    q = spark.createDataFrame([(i, vec(), sorted(set(t))) for i, t in enumerate(texts(30))], "query_id long, vec array<double>, tokens array<string>")
    flat = lambda df: {(r.query_id, r.grp, r.item_id): round(r.lexical, 9) for r in retrieve.bm25(df).collect()}
    by_postings = flat(nearest(q, ix, 6, tile_rows=13))
    pairs = nearest(q.drop("tokens"), ix.drop("tokens"), 6)
    assert by_postings == flat(retrieve.shared_tokens(pairs, q, ix.select("item_id", "tokens"))) and len(by_postings) == 360


def test_pools_pass_by_in_batches_without_windows(spark):
    """BM25 holds a batch and one query: no window or sort by pool, and batches that cut a pool give the same scores."""
    rnd = random.Random(6)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(4)]
    texts = {i: [rnd.choice("abcdef") for _ in range(rnd.randint(0, 8))] for i in range(40)}
    asked = {i: sorted({rnd.choice("abcdefg") for _ in range(3)}) for i in range(25)}
    ix = spark.createDataFrame([(i, i % 3, vec(), t) for i, t in texts.items()], "item_id long, grp int, vec array<double>, tokens array<string>")
    q = spark.createDataFrame([(i, vec(), t) for i, t in asked.items()], "query_id long, vec array<double>, tokens array<string>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for tile in (None, 13):
            out = retrieve.bm25(nearest(q, ix, 6, tile_rows=tile), gathered=True)
            got = {(r.query_id, r.grp, r.item_id): r.lexical for r in out.collect()}
            assert len(got) == 25 * 3 * 6
            assert tile or "Window" not in out._jdf.queryExecution().toString()
            for i, wanted in asked.items():
                for g in range(3):
                    pool = [k[2] for k in got if k[:2] == (i, g)]
                    mean = sum(len(texts[j]) for j in pool) / len(pool)
                    df = {t: sum(t in texts[j] for j in pool) for t in wanted}
                    idf = {t: math.log(1 + (len(pool) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
                    part = lambda j, t: idf[t] * (f := texts[j].count(t)) * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(texts[j]) / mean)) if t in texts[j] else 0.0  # noqa: E731, B023
                    total = {j: sum(part(j, t) for t in wanted) for j in pool}
                    best = max(total.values())
                    assert all(abs(got[i, g, j] - (total[j] / best if best else 0.0)) < 1e-9 for j in pool)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_upsert_skips_unchanged_and_keeps_last(spark):
    cols = "stable_id string, title string, language string, source_hash string, authority_weight double, seq int"
    old = spark.createDataFrame([("d:1", "a", "ko", "h1", 0.5, 0), ("d:2", "b", "ko", "h2", 1.0, 0), ("d:9", "z", "ko", "h9", 0.5, 0)], cols)
    new = spark.createDataFrame([("d:1", "a", None, "h1", None, 1), ("d:2", "b", "ko", "h2", None, 2), ("d:3", "c", "ko", "h3", None, 3), ("d:3", "c2", "ko", "h4", None, 4)], cols)
    plan = ingest.upsert_plan(old, new, ["title", "language"], "seq")
    assert {r.stable_id: r.action for r in plan.collect()} == {"d:1": "skip", "d:2": "update", "d:3": "add"}
    snap = {r.stable_id: r.title for r in ingest.upsert_index(old, plan).collect()}
    assert snap == {"d:1": "a", "d:2": "b", "d:3": "c2", "d:9": "z"}


def test_card_sync_looks_at_the_version_only(spark):
    old = spark.createDataFrame([("a", "v1"), ("b", "v1"), ("c", "v0")], "card_id string, card_version string")
    new = spark.createDataFrame([("a", "v1"), ("c", "v1"), ("d", "v1")], "card_id string, card_version string")
    assert {r.card_id: r.action for r in ingest.sync_cards(old, new).collect()} == {"a": "skip", "b": "delete", "c": "update", "d": "add"}


def _manifest(**change):
    dataset = {
        "dataset_id": "x", "corpus_type": "statutes", "source_name": "n", "source_url": "https://e.org", "authority": "a",
        "collection_method": "m", "inclusion_criteria": ["i"], "exclusion_criteria": [], "raw_count": 7, "deduplicated_count": 7,
        "accepted_count": 7, "rejected_count": 0, "deduplication_key": "k", "license_status": "approved", "license_basis": "b",
        "license_basis_url": "https://e.org", "redistribution_allowed": None, "review_status": "verified", "reviewer": None,
    }
    body = {"manifest_version": "v1", "generated_at": "2026-08-31T00:00:00+09:00", "cutoff_date": "2026-08-31", "status": "verified", "datasets": [dataset]}
    dataset.update(change.pop("dataset", {}))
    body.update(change)
    return json.dumps(body)


def test_manifest_gate(spark):
    rows = {
        "good": _manifest(), "draft": _manifest(status="reviewing"), "day": _manifest(cutoff_date="2026-02-30"),
        "extra": _manifest(owner="x"), "type": _manifest(dataset={"raw_count": "7"}), "less": _manifest(dataset={"accepted_count": -1}),
        "kind": _manifest(dataset={"redistribution_allowed": "yes"}), "broken": "{", "empty": _manifest(manifest_version=""),
    }
    got = {r.k: r.violations for r in ingest.gate_manifest(spark.createDataFrame(list(rows.items()), "k string, manifest string"), "k").collect()}
    assert got == {
        "good": [], "draft": ["not_verified"], "day": ["invalid:cutoff_date"], "extra": ["extra:owner"], "type": ["datasets.0.invalid:raw_count"],
        "less": ["datasets.0.invalid:accepted_count"], "kind": ["datasets.0.invalid:redistribution_allowed"], "broken": ["invalid_json"],
        "empty": ["invalid:manifest_version"],
    }


def test_routing_rules(spark):
    base = {"day": 1, "seq": 0, "risk_level": "medium", "failed_attempts": 0, "conflicting": False, "input_tokens": 0, "deep_before": 0}
    cases = [
        ("plan", {"role": "planner"}), ("verify", {"role": "verifier"}), ("again", {"role": "verifier", "failed_attempts": 1}),
        ("high", {"role": "analyst", "risk_level": "high"}), ("deep", {"role": "analyst", "risk_level": "high", "conflicting": True}),
        ("over", {"role": "planner", "input_tokens": 3001}), ("judge", {"role": "adjudicator", "risk_level": "high"}),
        ("late", {"role": "analyst", "risk_level": "high", "conflicting": True, "deep_before": 20, "seq": 1}),
        ("minus", {"role": "planner", "input_tokens": -1}), ("who", {"role": "poet"}),
    ]
    rows = [{"request_id": k, **base, **v} for k, v in cases]
    schema = "request_id string, day int, seq int, role string, risk_level string, failed_attempts int, conflicting boolean, input_tokens int, deep_before int"
    got = {r.request_id: (r.tier, r.rejected_code) for r in modelio.route_requests(spark.createDataFrame(rows, schema), modelio.routing_policy(spark)).collect()}
    assert got == {
        "plan": ("fast", None), "verify": ("fast", None), "again": ("balanced", None), "high": ("balanced", None), "deep": ("deep", None),
        "over": (None, "INPUT_BUDGET_EXCEEDED"), "judge": (None, "ADJUDICATOR_NOT_ALLOWED"), "late": (None, "DEEP_LIMIT_REACHED"),
        "minus": (None, "NEGATIVE_COUNTER"), "who": (None, "UNKNOWN_ROLE"),
    }
    none = modelio.route_requests(spark.createDataFrame(rows[:1], schema), modelio.routing_policy(spark), available=[])
    assert none.collect()[0].rejected_code == "MODEL_NOT_CONFIGURED"


def test_context_json_schema(spark):
    good = {"section_id": "s", "rule_id": "r", "evidence_quote": "q", "rationale": "w", "review_question": "?", "confidence": "low", "counter_considerations": []}
    rows = {
        "good": {"candidates": [good]}, "none": {"candidates": []}, "extra": {"candidates": [{**good, "x": 1}]},
        "long": {"candidates": [{**good, "evidence_quote": "q" * 601}]}, "many": {"candidates": [good] * 13}, "top": {"candidates": [], "y": 1},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], "k string, output string")
    got = {r.k: r.valid for r in modelio.validate_context_json(df).collect()}
    assert got == {"good": True, "none": True, "extra": False, "long": False, "many": False, "top": False}


def test_purge_keeps_all_other_keys(spark):
    rows = [('{"masked_text":"x","a":1,"keep":"y","n":{"b":[1,"2",null]}}',), ('{"a": 1}',), ("[1]",), ("broken",), (None,)]
    got = [(r.p, r.purged) for r in lifecycle.purge_field(spark.createDataFrame(rows, "p string"), "p", "masked_text").collect()]
    assert json.loads(got[0][0]) == {"a": 1, "keep": "y", "n": {"b": [1, "2", None]}} and got[0][1]
    assert got[1:] == [(r[0], False) for r in rows[1:]]


def test_context_budget_takes_one_call(spark):
    c = spark.createDataFrame([(1, i, "x" * 10) for i in range(5)], "doc_id int, clause_ord int, text string")
    one, many = (sorted(map(tuple, modelio.budget_batches(c, 25, n).collect()), key=str) for n in (1, 7))
    assert one == many


def test_model_hook(spark):
    f = spark.createDataFrame([("c",)], "category string")
    out = modelio.call_model(f.select("category"), lambda pdf: pdf.assign(n=pdf["category"].str.len()), "category string, n long")
    assert out.collect()[0].n == 1


def test_sources_and_sinks(spark, tmp_path):
    rec = {"document_id": "d", "chunk_id": "1", "corpus_type": "statutes", "text": "가나", "title": "t"}
    (tmp_path / "c.jsonl").write_text(json.dumps(rec, ensure_ascii=False) + "\n\n", encoding="utf-8")
    got = readers.read_jsonl(spark, str(tmp_path / "c.jsonl"), schemas.CORPUS_RECORD).collect()
    assert len(got) == 1 and got[0].text == "가나" and got[0].authority is None
    (tmp_path / "rules.yaml").write_text(json.dumps({"version": "9", "rules": KOREAN_RULES.rules}, ensure_ascii=False), encoding="utf-8")
    pack = readers.load_pack(spark, str(tmp_path / "rules.yaml"))
    assert pack.version == "9" and [r["id"] for r in pack.rules] == [r["id"] for r in KOREAN_RULES.rules]
    (tmp_path / "cards.json").write_text(json.dumps({"version": "c1", "cards": korean.CARDS}, ensure_ascii=False), encoding="utf-8")
    assert ingest.gate_cards(readers.read_cards(spark, str(tmp_path / "cards.json"))).filter("NOT accepted").count() == 0
    (tmp_path / "tax.json").write_text(json.dumps({"version": "t", "profiles": korean.TAXONOMY}, ensure_ascii=False), encoding="utf-8")
    tax = readers.read_taxonomy(spark, str(tmp_path / "tax.json"))
    assert tax.filter("polarity = 'positive'").count() == 22
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.txt").write_bytes("가".encode())
    (up / "b.txt").write_bytes(b"\xff\xfe")
    (up / "c.pdf").write_bytes(b"no")
    (up / "d.exe").write_bytes(b"x")
    codes = {r.path.rsplit("/", 1)[1]: r.error_code for r in readers.scan_uploads(spark, str(up)).collect()}
    assert codes == {"a.txt": None, "b.txt": "NOT_UTF8", "c.pdf": "BAD_PDF_SIGNATURE", "d.exe": "UNSUPPORTED_TYPE"}
    df = spark.createDataFrame([(1, "가", ["x"])], "id int, t string, a array<string>")
    writers.write_results(df, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).collect()[0].a == ["x"]
    assert writers.export_results(df, "id").collect()[0].result_json == '{"t":"가","a":["x"]}'
    writers.write_snapshot(spark.createDataFrame([("statutes", "x")], "corpus_type string, text string"), str(tmp_path / "snap"))
    assert readers.read_table(spark, str(tmp_path / "snap"), "text string, corpus_type string").count() == 1
    with pytest.raises(ValueError):
        writers.with_run_meta(df, {"text": "secret"})
    h = writers.dataset_hash(df.union(df), "id").collect()[0].dataset_sha256
    assert len(h) == 64


def test_encryption_and_audit_window(spark):
    df = spark.createDataFrame([("가나",)], "t string").withColumn("c", lifecycle.encrypt(F.col("t"), F.lit("0123456789abcdef")))
    ok, _ = lifecycle.decrypt(F.col("c"), F.lit("0123456789abcdef"))
    bad, code = lifecycle.decrypt(F.col("c"), F.lit("fedcba9876543210"))
    assert df.select(ok.alias("a"), bad.alias("b"), code.alias("e")).collect()[0][:] == ("가나", None, "STORAGE_INTEGRITY_FAILED")
    ages = spark.createDataFrame([(366,), (365,), (364,)], "age int").select(
        "age", F.expr("timestamp'2026-01-01 00:00:00' - make_dt_interval(age)").alias("created_at")
    )
    kept = lifecycle.expire_audit(ages, F.expr("timestamp'2026-01-01 00:00:00'"))
    assert sorted(r.age for r in kept.collect()) == [364, 365]
