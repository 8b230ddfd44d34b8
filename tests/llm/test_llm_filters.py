"""URL filter, conversation repair and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import corpus
import pytest
from pactlens.llm import conversation_repair, periodic_runs, queries, url_filter
from pactlens.llm.common import save, work_folder

DATA = corpus.rows()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return corpus.write(spark, tmp_path_factory.mktemp("tables"), DATA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    bare = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = bare.partition("/")
    host, path = lower(host), slash + path
    fits = [(len(h + p), h.count("."), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


def test_url_filter(spark, sf):
    got = Counter(tuple(r) for r in queries.op11_url_filter(spark, sf).collect())
    want = Counter((r[0], *judged(r[1], queries.URL_RULES)) for r in corpus.page_rows())
    assert got == want and {v for *_, v in want} == {"allow", "block"}


def test_url_filter_with_many_rules(spark):
    rng = random.Random(2)
    part = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    host = lambda: ".".join(part() for _ in range(rng.randint(1, 4)))
    path = lambda: "".join("/" + part() for _ in range(rng.randint(0, 3))) + rng.choice(["", "/"])
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(400)]
    urls = [f"{rng.choice(['http', 'https'])}://{host()}{path()}{rng.choice(['', '?x', '#y'])}" for _ in range(3000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    out = url_filter.judge(pages, listed, default="block")
    got = {r._doc.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: judged(u, rules, "block") for i, u in enumerate(urls)}
    none = url_filter.judge(pages, listed.limit(0))
    assert none.filter("rule IS NULL AND verdict = 'allow'").count() == len(urls)


def test_the_filter_lets_all_listed_through_and_little_else(spark):
    keys = spark.range(20_000).selectExpr("concat('h', id, '.org/') AS key", "2 AS host_labels", "1 AS path_chars", "'block' AS verdict")
    rules = save(keys, work_folder(spark, "rules"))
    blocks = url_filter.block_count(20_000)
    urls = spark.range(40_000).selectExpr("concat('h', id, '.org') AS host", "'/' AS path")
    passed = {r.key for r in url_filter.possible_hits(urls, rules, blocks).collect()}
    assert all(f"h{i}.org/" in passed for i in range(20_000)) and len(passed) < 20_000 * 1.02
    assert url_filter.bloom_blocks(rules, blocks).count() <= blocks and url_filter.block_count(10**12) == url_filter.MAX_BLOCKS


def test_url_filter_stays_in_the_jvm(spark, sf):
    plan = queries.op11_url_filter(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def mended(turns):
    """Cheapest edits of (role, text) turns by definition, whole strings compared."""
    seen, rows = set(), []
    for role, text in turns:
        bare = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        rows.append((role, text, fault))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserted):
        """(cost, audit, lines) from turn i on; at most two insertions in a row can help."""
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 2:
            for r in "ua":
                if r in step[state]:
                    c, a, lines = best(i, step[state][r], inserted + 1)
                    ways.append((c + 5, "I" + a, (f"{full[r]}:", *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, lines = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] in step[state]:
                    c, a, lines = best(i + 1, step[state][role[:1]], 0)
                    ways.append((c + extra, "K" + a, (f"{role}:{text}", *lines)))
                for r in "ua":
                    if r in step[state]:
                        c, a, lines = best(i + 1, step[state][r], 0)
                        ways.append((c + extra + 1, "R" + a, (f"{full[r]}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    faults = [f for _, _, f in rows]
    pairs = [rows[i][0][:1] + rows[i + 1][0][:1] for i in range(len(rows) - 1)]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, lines


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))


def repaired(rows):
    """Result of (turn, role, text) rows of one conversation."""
    rows = in_order(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    *numbers, audit, lines = mended([(r, t) for _, r, t in rows])
    return (gaps, *numbers, audit, sha("\n".join(lines)))


def test_conversation_repair(spark, sf):
    kept = defaultdict(list)
    for conv, turn, role, text, *_ in corpus.turn_rows():
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        rows = kept[conv]
        if k:
            row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            rows += [row, row] if k == 3 else [row]
    long = kept.pop(900)
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, sf).collect()}
    one = got.pop(900)
    assert got == {c: repaired(rows) for c, rows in kept.items()}
    assert sum(not rows for rows in kept.values()) > 0
    # the long conversation, without recursion: its edits keep the grammar and have the cost that is stated
    assert one[1:4] == tuple(sum(f == x for f in faults(long)) for x in ("blank", "duplicate", "truncated"))
    assert len(one[6].replace("I", "")) == len(long) and set(one[6]) <= set("DIKR")


def faults(rows):
    seen = set()
    for _, role, text in in_order(rows):
        bare = text.rstrip()
        yield "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))


def test_words_in_any_order_get_the_same_repair():
    rng, known = random.Random(4), conversation_repair.Words()
    text = {"f": "t{}.", "b": "", "t": "t{}"}
    for _ in range(1500):
        kinds = [(rng.choice(["system", "user", "assistant", "other"]), rng.choice("ffftb")) for _ in range(rng.randint(0, 9))]
        turns = [(r, text[k].format(i)) for i, (r, k) in enumerate(kinds)]
        word = "".join(conversation_repair.SYMBOLS[4 * "suao".index(r[0]) + {"f": 0, "b": 1, "t": 3}[k]] for r, k in kinds)
        assert (*conversation_repair.counts(word), *known.repair(word)) == mended(turns)[:6]
    assert len(known.automaton.nodes) < 400  # few nodes stand for all ends


def test_repaired_turns_follow_the_grammar_and_the_digest(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    out = conversation_repair.repair(rows)
    digests = {r.conv_id: r.repaired_sha256 for r in out.collect()}
    turns = defaultdict(list)
    for r in conversation_repair.repaired_turns(rows, out).orderBy("conv_id", "seq").collect():
        turns[r.conv_id].append((r.seq, r.role, r.text))
    for conv, digest in digests.items():
        own = turns[conv]
        assert [s for s, _, _ in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in own))
        assert sha("\n".join(f"{r}:{t}" for _, r, t in own)) == digest


def brute_runs(words, least=6, exponent=4):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j + q), q)  # shorter periods come first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items() if e - s >= max(least, exponent * q))


def collapsed(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_periodic_runs(spark, sf):
    want = Counter()
    for r in DATA:
        words, h = split(r[1]), zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[(r[0], len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))] += 1
    got = Counter(tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect())
    assert got == want and sum(n > 0 for _, n, *_ in want) > 3


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(0, 12)):
            words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.choice([0, 1, 2, 5, 10, 40, 90]))]
            if words and rng.random() < 0.5:
                a, p = rng.randrange(len(words)), rng.randint(1, 9)
                words = [w if i < a + p else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(" ".join(words))
        least, exponent = rng.choice([2, 6]), rng.choice([2, 3, 4])
        out = periodic_runs.describe(texts, least, exponent, rng.choice([5, 100, 10_000])).to_pylist()
        for text, got in zip(texts, out, strict=True):
            runs = brute_runs(text.split(), least, exponent)
            assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == runs
            assert got["collapsed"] == collapsed(text.split(), runs) and got["n_words"] == len(text.split())


def test_sides_longer_than_a_part(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    text = "a b " * 30 + "c " * 25 + "a b c " * 20
    assert [tuple(r.values()) for r in periodic_runs.describe([text], 6, 4).to_pylist()[0]["runs"]] == brute_runs(text.split())


def test_runs_keep_all_columns(spark):
    docs = spark.createDataFrame([(1, "x y " * 9, "kept"), (None, None, None)], "doc_id long, text string, runs string")
    out = periodic_runs.find_runs(docs).collect()
    assert {(r._doc.doc_id, r._doc.runs, r.n_words, len(r.runs), r.collapsed) for r in out} == {(1, "kept", 18, 1, "x y"), (None, None, 0, 0, "")}
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs.find_runs(docs, min_exponent=1)
