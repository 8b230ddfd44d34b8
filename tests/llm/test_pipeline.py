"""Each stage of the pipeline on its own input, against plain Python."""

from collections import Counter

import corpus
import corpus_pipeline as pipeline
import pytest
from pactlens.llm import quality
from test_llm_operators import DATA, drop_lines

COLUMNS = [f.name for f in corpus.SCHEMA]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return corpus.write(spark, tmp_path_factory.mktemp("tables"), DATA)


@pytest.fixture()
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_quality_stage(spark, sf, docs):
    out = pipeline.drop_low_quality(spark, docs, sf)
    judged = quality.classify(docs, pipeline.trusted(spark, sf), pipeline.toxic(spark, sf))
    assert out.columns == COLUMNS and rows(out) == rows(judged.filter("kept").select("_doc.*"))


def test_line_stage(spark, sf, docs):
    out = pipeline.drop_common_lines(spark, docs, sf)
    text = lambda r, t: None if r[1] is None else t
    assert out.columns == COLUMNS and rows(out) == Counter(
        (r[0], text(r, t), r[2], r[3], None if r[1] is None else len(t), *r[5:]) for r, _, _, t in drop_lines(DATA))


def linked_sets(sets):
    """The first of the sets that each is linked to by steps of a similarity of 0.8."""
    roots = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 10 * len(a & b) >= 8 * len(a | b)):
                old, new = max(roots[i], roots[j]), min(roots[i], roots[j])
                roots = [new if r == old else r for r in roots]
    return roots


def test_copies_of_one_text_are_linked_by_their_original(spark, sf):
    """Copies that differ from each other in two words are near the original only; few pairs are needed to see it."""
    from pactlens.llm import shingle_dedup

    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base)] + [" ".join(base[:k] + [f"x{k}"] + base[k + 1:]) for k in range(8, 52)]
    docs = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    assert {r.component_id for r in shingle_dedup.near_groups(docs, "_row", 5).collect()} == {0}


def test_near_stage(spark, sf, docs):
    out = pipeline.keep_one_of_near_copies(spark, docs, sf)
    words = [(r[1] or "").encode().lower().split() for r in DATA]
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    roots = linked_sets(sets)
    kept = Counter(t for t in (tuple(r) for r in out.collect()))
    assert out.columns == COLUMNS and not kept - Counter(DATA)
    group = {r: c for r, c in zip(DATA, roots, strict=True)}
    assert sorted(group[r] for r in kept.elements()) == sorted(set(roots))


def test_near_stage_goes_by_the_exact_similarity(spark, sf, docs):
    texts = []
    for i in range(48):  # similarities from 0.65 to 0.93 in a row
        words = [f"a{i}b{k}" for k in range(60)]
        texts += [" ".join(words), " ".join(words[:-(2 + i % 12)] + [f"c{i}d{k}" for k in range(2 + i % 12)])]
    texts += ["of " * n + f"x{n} y" for n in (50, 90)] + ["z " * n + "one two three four five" for n in (6, 400)]
    data = [(i, t, "en", "a", len(t), 1, "k", "x") for i, t in enumerate(texts)]
    sets = [{tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    later = {i for i in range(len(texts)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    out = pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(data, corpus.SCHEMA), sf)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(range(len(texts))) - later)
    assert 10 < len(later) < 40


def test_near_stage_links_close_copies_by_their_fingerprints(spark, sf, monkeypatch):
    """The multi-index search links copies that differ in a word, and nothing that is not similar; min-hashes find what lies farther."""
    from pactlens.llm import shingle_dedup, simhash

    texts, found = [], []
    for i in range(12):
        words = [f"a{i}b{k}" for k in range(400)]
        texts += [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:]]), " ".join(words[:-40])]
    sets = [shingle_dedup.shingle_set(t, 5) for t in texts]
    prints = [simhash.print_of(s)[0] for s in sets]
    close = {(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4 and shingle_dedup.similarity(sets[i], sets[j]) >= 0.8}
    whole = simhash.link_prints

    def spy(*args, **kw):
        out = whole(*args, **kw)
        found.append({r.id: r.comp for r in out.collect()})
        return out

    monkeypatch.setattr(shingle_dedup, "link_prints", spy)
    data = [(i, t, "en", "a", len(t), 1, "k", "x") for i, t in enumerate(texts)]
    out = pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(data, corpus.SCHEMA), sf)
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, len(texts), 4))
    comps, = found
    assert len(close) > 12 and all(comps[i] == comps[j] for i, j in close) and all(c // 4 == i // 4 for i, c in comps.items())


def test_leak_stage(spark, sf, docs):
    out = pipeline.drop_benchmark_leaks(spark, docs, sf)
    items = (corpus.QUESTION, corpus.PASSAGE.split(". ")[1], "no id and short")
    clean = [r for r in DATA if not any(corpus.brute_match(r[1], t) for t in items)]
    assert out.columns == COLUMNS and rows(out) == Counter(clean) and len(clean) < len(DATA)


def test_mixing_stage(spark, sf, docs):
    out = pipeline.mix_sources(spark, docs, sf).collect()
    assert all(0 < r.taken <= 2 * r.size and r.size == len(r.text.split()) for r in out)
    by = Counter()
    for r in out:
        by[r.target] += r.taken
    assert all(t - 1 <= n <= t for t, n in by.items())


def test_whole_pipeline_agrees_with_its_stages(spark, sf, docs):
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert rows(docs) == rows(pipeline.run(spark, sf)) and docs.count() > 0


def test_empty_documents(spark, sf, tmp_path):
    empty = corpus.write(spark, tmp_path / "none", [])
    assert pipeline.run(spark, empty).collect() == []
