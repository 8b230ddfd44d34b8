"""A small corpus with awkward rows, and its tables as the queries read them."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("_row", T.LongType()), T.StructField("key", T.StringType()), T.StructField("kept", T.StringType()),
])
PASSAGE = ("The old harbour keeps its lamps lit through every winter storm. No ship has failed to find the quay since then. "
           "People say that the keeper counts each light twice before dawn. He writes the number into a long grey book.")
QUESTION = "A farmer named Bertram sold 12 baskets of pears for 30 dollars each while Bertram kept another 12 baskets for the village fair"
OTHER = "A farmer named Cecilia sold 45 baskets of pears for 70 dollars each while Cecilia kept another 45 baskets for the village fair"
MIXED_UP = "A farmer named Cecilia sold 45 baskets of pears for 70 dollars each while Dora kept another 99 baskets for the village fair"
BOILER = "All rights reserved by the publisher"


def words(rng, n, stock=400):
    return " ".join(rng.choice(["the", "of", "and", "in"]) if rng.random() < 0.3 else f"w{int(stock * rng.random() ** 2)}q" for _ in range(n))


def prose(rng, n):
    out = []
    for i in range(n):
        s = words(rng, rng.randint(4, 14))
        out.append(s[0].upper() + s[1:] + "." + ("\n" if rng.random() < 0.2 else " "))
    return "".join(out)


def rows(seed=3, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = prose(rng, rng.randint(2, 25))
        if i % 5 == 0:
            text += f"\n  {BOILER.upper() if i % 10 else BOILER}\t\n" + prose(rng, 2)
        if i % 7 == 0:
            text = prose(rng, 3) + PASSAGE + " " + prose(rng, 3)
        if i % 11 == 3:
            text = out[-1][1].replace(" ", "  ", 2)
        if i % 13 == 4:
            text = text.replace("w1", "W2")
        out.append([100 - i, text, ["en", "de", None][i % 3], ["a", "b", None, "ä"][i % 4]])
    out += [
        [None, "A null id. With some words in it.", "en", "a"], [None, None, None, None], [7001, None, "en", "b"], [7002, "", "en", "b"],
        [7003, " \t\n\x0b\f\r ", "en", "a"], [7004, "one", "en", "a"], [7005, "é" * 120 + " ü" + "é" * 120, "de", "a"],
        [7006, "du " * 400, "fr", "a"], [7007, "aaaa" * 300, "fr", "b"], [7008, prose(rng, 1500), "en", "b"],
        [7009, "x " + QUESTION + " y.", "en", "a"], [7010, "so it goes. " + OTHER + ".", "en", "a"], [7011, MIXED_UP, "en", "b"],
        [7012, "  two   spaces ▁ and <s> marks\r\n\r\n", "en", "a"],
    ]
    out += [list(out[5]), list(out[5]), [100, "same id, other text", "en", "a"]]
    return [(i, t, lang, s, None if t is None else len(t), 1, "k", "x") for i, t, lang, s in out]


URLS = [
    None, "", "no scheme", "://", "https://", "http://net", "http://a.net/", "HTTP://EXAMPLE.NET/en/1?q=/de/", "https://m.example.net/en", "https://m.example.net/en/",
    "https://example.net/EN/", "https://xexample.net/en/", "http://example.com/de/x#y", "http://example.com/den", "http://a.b.ORG/fr/?", "http://org?x=/fr/",
    "http://org#/fr/", "http://.net/x", "http://u@net:80/", "http://é.example.com/de/ü/", "a://b://net/", "http://net/\n/x\n?y", "http://" + "a." * 3000 + "net/" + "p/" * 3000,
]


def page_rows():
    return [(None if i % 9 == 4 else i, u, "h" if i % 2 else None, "clash") for i, u in enumerate(URLS + URLS[:9] + [URLS[6]] * 40)]


def turn_rows(seed=5):
    rng = random.Random(seed)
    texts = ["Fine.", "Done? ", "cut off", " \t\n", "", None, "é!\x0b", "a: b\nc.", "twice.", "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "agent"]
    out = []
    for c in range(150):
        n = rng.choice([1, 2, 3, 4, 7, 12])
        turn = rng.randint(0, 3)
        for i in range(n):
            usual = ["user", "assistant"][i % 2]
            out.append((None if c == 7 else c, None if rng.random() < 0.05 else turn, rng.choice(roles) if rng.random() < 0.3 else usual, rng.choice(texts), "x", 1))
            turn += rng.choice([1, 1, 1, 2, 5, 0])
    out += [(900, i, ["user", "assistant"][i % 2], f"part {i}.", "x", 1) for i in range(3000)]  # one long conversation
    out += [(901, None, None, None, None, None), (None, None, None, None, None, None)] + [(902, 1, "user", "same.", "x", 1)] * 5
    rng.shuffle(out)
    return out


def write(spark, folder, data):
    """documents, labels, benchmark, pages and conversations tables below ``folder``; those without data are empty."""
    pages = "page_id long, url string, html string, host string"
    spark.createDataFrame(page_rows() if data else [], pages).repartition(3).write.parquet(f"{folder}/pages.parquet")
    turns = "conv_id long, turn long, role string, text string, digest string, at long"
    spark.createDataFrame(turn_rows() if data else [], turns).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    ids = sorted({r[0] for r in data if r[0] is not None and r[0] <= 100})
    labels = [(i, int(i % 9 != 0), int(i % 10 == 0)) for i in ids] + [(None, 1, 0)]
    spark.createDataFrame(labels + labels[:2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, QUESTION), (2, None), (3, ""), (4, PASSAGE.split(". ")[1]), (None, "no id and short")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def brute_match(doc, item):
    """(tokens, slots, changed slots) of the best match of two texts' templates, diagonal by diagonal; None without one."""
    from pactlens.llm import decontaminate as d

    words = d.Words()
    (dc, dv), (ic, iv) = ([x.tolist() for x in words.template(t or "")] for t in (doc, item))
    size, best = min(d.WINDOW, len(ic)), None
    if not ic or (len(ic) < d.SHORT and len(ic) != len(dc)):
        return None
    for diagonal in range(-len(ic), len(dc)):
        runs, run = [], []
        for place in range(max(0, -diagonal), len(ic)):
            at = place + diagonal
            if at < len(dc) and dc[at] == ic[place]:
                run.append((ic[place], iv[place], dv[at]))
            else:
                runs.append(run)
                run = []
        for run in (r for r in [*runs, run] if len(r) >= size):
            # Stretches between clashes: each slot value stands for one value of the other side. A clash at a sentence start is an end.
            cuts, there, back = [(0, False)], {}, {}
            for i, (code, a, b) in enumerate(run):
                if code in d._KINDS:
                    kind = d.NAME if d._KINDS[code] == d.START else d._KINDS[code]
                    if there.get((kind, a), b) != b or back.get((kind, b), a) != a:
                        cuts.append((i, kind == d._KINDS[code]))
                        there, back = {}, {}
                    there[kind, a], back[kind, b] = b, a
            for (a, left), (b, right) in zip(cuts, [*cuts[1:], (len(run), False)], strict=True):
                ends = [(b, left or right)]
                begins = [i for i in range(a, b + 1) if i < len(run) and d._KINDS.get(run[i][0]) == d.START and run[i][1] != run[i][2]]
                ends += [(i, left) for i in begins if all(x[1] == x[2] for x in run[a:i] if x[0] in d._KINDS)]
                for end, torn in ends:
                    part = run[a:end]
                    slots = [x for x in part if x[0] in d._KINDS and (d._KINDS[x[0]] != d.START or x[1] != x[2])]
                    changed = sum(x[1] != x[2] for x in slots)
                    need = max(min(d.LEAST, len(ic)), d.WHOLE * len(ic) if torn else 0)
                    if part and len(part) >= need and (not changed or len(part) - len(slots) >= d.LITERALS * len(part)):
                        best = max(best or (0, 0, 0), (len(part), len(slots), changed))
    return best
