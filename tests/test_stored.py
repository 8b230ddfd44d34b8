"""Stored index and vector store: what a change rewrites, and that doing it again changes nothing."""

from pathlib import Path

from pactlens.sources import stored

META = ["language"]


def _rows(spark, rows):
    return spark.createDataFrame(rows, "stable_id string, doc_id long, language string, source_hash string, authority_weight double")


def _files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet")}


def _state(spark, path):
    return sorted(tuple(r) for r in stored.read_index(spark, path).select("stable_id", "doc_id", "source_hash").collect())


def test_only_buckets_with_a_change_are_written(spark, tmp_path):
    path = str(tmp_path / "index")
    old = [(f"s:{i}", i, "en", f"h{i}", 0.5) for i in range(200)]
    stored.write_index(_rows(spark, old), path, buckets=32)
    before = _files(path)
    new = [("s:7", 907, "en", "other", None), ("s:8", 908, "en", "h8", None), ("t:1", 1, "de", "n", 0.9), ("t:1", 2, "de", "n2", 0.9)]
    actions = {r.stable_id: r.action for r in stored.upsert_stored(spark, path, _rows(spark, new), META, "doc_id", 32).collect()}
    assert actions == {"s:7": "update", "s:8": "skip", "t:1": "add"}
    after = _files(path)
    changed = {f.split("/")[0] for f in before ^ after}
    assert 1 <= len(changed) <= 2 and len(before & after) == len(before) - len({f for f in before if f.split("/")[0] in changed})
    assert _state(spark, path) == sorted([(f"s:{i}", i, f"h{i}") for i in range(200) if i != 7] + [("s:7", 907, "other"), ("t:1", 2, "n2")])
    again = {r.stable_id: r.action for r in stored.upsert_stored(spark, path, _rows(spark, new), META, "doc_id", 32).collect()}
    assert set(again.values()) == {"skip"} and _files(path) == after


def test_upsert_of_nothing_and_into_an_empty_bucket(spark, tmp_path):
    path = str(tmp_path / "index")
    stored.write_index(_rows(spark, [("a", 1, "en", "h", 0.5)]), path, buckets=64)
    before = _files(path)
    assert stored.upsert_stored(spark, path, _rows(spark, []), META, "doc_id", 64).collect() == [] and _files(path) == before
    stored.upsert_stored(spark, path, _rows(spark, [(f"b{i}", i, None, "h", None) for i in range(20)]), META, "doc_id", 64)
    assert len(_state(spark, path)) == 21


def test_cards_are_synchronised_and_stale_ones_go(spark, tmp_path):
    path = str(tmp_path / "cards")
    cards = spark.createDataFrame([(f"c{i}", "1", "old") for i in range(10)], "card_id string, card_version string, text string")
    stored.write_index(cards, path, "card_id", 8)
    wanted = spark.createDataFrame([("c1", "1", "edited"), ("c2", "2", "new"), ("x", "1", "new")], "card_id string, card_version string, text string")
    actions = {r.card_id: r.action for r in stored.sync_stored(spark, path, wanted, buckets=8).collect()}
    assert actions == {f"c{i}": "delete" for i in range(10)} | {"c1": "skip", "c2": "update", "x": "add"}
    state = {r.card_id: r.text for r in stored.read_index(spark, path).collect()}
    assert state == {"c1": "old", "c2": "new", "x": "new"}  # the version alone decides
    files = _files(path)
    assert {r.action for r in stored.sync_stored(spark, path, wanted, buckets=8).collect()} == {"skip"} and _files(path) == files


def test_a_second_run_encodes_nothing(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def encoder(texts):
        calls.add(len(texts))
        return [[len(t), 1.0] for t in texts]

    path = str(tmp_path / "vectors")
    rows = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "aa"), (4, None), (5, "")], "id long, text string")
    first = {r.id: r.vector for r in stored.encode_stored(rows, encoder, path, 2).collect()}
    assert first == {1: [2, 1], 2: [3, 1], 3: [2, 1], 4: None, 5: [0, 1]} and calls.value == 3
    assert {r.id: r.vector for r in stored.encode_stored(rows, encoder, path).collect()} == first and calls.value == 3
    more = rows.unionByName(spark.createDataFrame([(6, "cccc"), (7, "bbb")], rows.schema))
    assert {r.id: r.vector for r in stored.encode_stored(more, encoder, path).collect()} == first | {6: [4, 1], 7: [3, 1]} and calls.value == 4
