"""Repair of conversations by a suffix-shared automaton of role and fault signatures.

Each turn is one of sixteen symbols, its role class with its first fault, and a conversation the word of its symbols. Words are read from
the end: words that end alike share nodes, and nodes with equal costs-to-go and first edits are one node, for all conversations of a
task. So the cheapest way to a legal ending is computed once for each node, symbol and grammar state. The audit is then
read off along the nodes, and a last pass over the turns applies it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlens.llm.common import number, remove, save, work_folder

BLANK_CHARS = " \t\n\x0b\f\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5

#: A symbol's place in the alphabet is 4 * role class + fault.
ROLES, SYMBOLS = "sua", "abcdefghijklmnop"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL_PAIRS = {"su", "ua", "au"}

#: Grammar (s?(ua)+)?: states are what stands last, nothing at first. NEXT has the state after a role that may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that an insertion or a new role brings in each state.
WANTED = ("u", "u", "a", "u")
FULL_ROLE = {"u": "user", "a": "assistant"}

BLOCK_TURNS = 1024  # symbols that are gathered at a time
SORT_CHARS = 48  # of the reversed word: what places it in a task


class Automaton:
    """Nodes with, for each grammar state, the cost to a legal end and the first edit on the cheapest way there.

    Costs are relative to the node's least, so there are few different nodes, however long the words are. Ways of equal cost differ in
    their first letter or are the same from there on, since a letter leads to one state; so the least letter gives the least audit.
    """

    def __init__(self):
        self.nodes: list[tuple[tuple[int, ...], tuple[str, ...]]] = []
        self.ids: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.end = self._node([(0, ""), None, None, (0, "")])[0]

    def _node(self, ways: list[tuple[int, str] | None]) -> tuple[int, int]:
        """Add insertions, make costs relative, and return the node's id with what was taken off."""
        ways = [w or (1 << 40, "~") for w in ways]
        for _ in ways:
            ways = [min(w, (INSERT_COST + ways[NEXT[s][WANTED[s]]][0], INSERT)) for s, w in enumerate(ways)]
        least = min(cost for cost, _ in ways)
        node = tuple(cost - least for cost, _ in ways), tuple(letter for _, letter in ways)
        if node not in self.ids:
            self.ids[node] = len(self.nodes)
            self.nodes.append(node)
        return self.ids[node], least

    def before(self, node: int, symbol: str) -> tuple[int, int]:
        """The node for ``symbol`` and then what ``node`` stands for, with the cost that it adds to all states."""
        known = self.steps.get((node, symbol))
        if known is None:
            role, fault = divmod(SYMBOLS.index(symbol), 4)
            costs, extra = self.nodes[node][0], TRUNCATED_COST if fault == TRUNCATED else 0
            ways = []
            for state in range(4):
                own = [(DELETE_COST + costs[state], DELETE)]
                if fault in (FINE, TRUNCATED):
                    own.append((REROLE_COST + extra + costs[NEXT[state][WANTED[state]]], REROLE))
                    kept = NEXT[state].get(ROLES[role:role + 1])
                    if kept is not None:
                        own.append((extra + costs[kept], KEEP))
                ways.append(min(own))
            known = self.steps[node, symbol] = self._node(ways)
        return known


def walk(letter: str, state: int, symbol: str | None) -> int:
    """The state after an edit; ``symbol`` is the turn that it is applied to."""
    if letter == DELETE:
        return state
    role = ROLES[SYMBOLS.index(symbol) // 4] if letter == KEEP else WANTED[state]
    return NEXT[state][role]


class Words:
    """Cost and audit of words that come in the order of their reversed form, so that nodes of a common end are at hand."""

    def __init__(self):
        self.automaton = Automaton()
        self.word, self.path, self.costs, self.result = "", [self.automaton.end], [0], (0, "")

    def repair(self, word: str) -> tuple[int, str]:
        if word == self.word and len(self.path) == len(word) + 1:
            return self.result
        same, most = 0, min(len(word), len(self.word))
        while same < most:  # the common end, by halves
            half = (same + most + 1) // 2
            if word[len(word) - half:] == self.word[len(self.word) - half:]:
                same = half
            else:
                most = half - 1
        del self.path[same + 1:], self.costs[same + 1:]
        for symbol in reversed(word[:len(word) - same]):
            node, cost = self.automaton.before(self.path[-1], symbol)
            self.path.append(node)
            self.costs.append(self.costs[-1] + cost)
        nodes, state, letters = self.automaton.nodes, START, []
        total = self.costs[-1] + nodes[self.path[-1]][0][START]
        at = len(word)
        while letter := nodes[self.path[at]][1][state]:
            letters.append(letter)
            state = walk(letter, state, None if letter == INSERT else word[len(word) - at])
            at -= letter != INSERT
        self.word, self.result = word, (total, "".join(letters))
        return self.result


def counts(word: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns, and neighbours whose roles may not follow each other."""
    roles = "".join((ROLES + "x")[SYMBOLS.index(c) // 4] for c in word)
    faults = [SYMBOLS.index(c) % 4 for c in word]
    illegal = sum(roles[i:i + 2] not in LEGAL_PAIRS for i in range(len(roles) - 1))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal


def key_of(conv_id: Column) -> Column:
    """A text that tells conversations apart, null from all others."""
    return F.when(conv_id.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), conv_id.cast("string")))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(_c, conv_id, turn, role, text, digest): nulls of role and text are one space; digest stands for role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(key_of(F.col("conv_id")).alias("_c"), "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    content = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("digest", F.unhex(F.md5(content)))


def turn_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def signatures(turns: DataFrame, folder: str) -> DataFrame:
    """(_c, word): the symbols of each conversation in the order of its turns.

    Only narrow rows are shuffled. Equal turns are told apart by their place in a distributed sort; a long conversation spreads over
    tasks and is put together from blocks of a bounded number of symbols, one character a turn.
    """
    rest = F.rtrim("text", F.lit(BLANK_CHARS))
    initial = F.substr("role", F.lit(1), F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(rest == "", BLANK).when(F.instr(F.lit(ENDS), F.substring(rest, -1, 1)) == 0, TRUNCATED).otherwise(FINE)
    narrow = turns.select("_c", "turn", "role", "digest", role.alias("_r"), fault.alias("_f"))
    placed = save(number(narrow, [F.col("_c"), *turn_order()], f"{folder}/sorted", "at").drop("role"), f"{folder}/placed")
    remove(turns.sparkSession, f"{folder}/sorted")
    # The first turn with a role and text; the join goes by its place, which no two rows share.
    firsts = placed.groupBy("_c", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    again = F.col("_first").isNull() & (F.col("_f") != BLANK)
    symbol = F.substr(F.lit(SYMBOLS), F.col("_r") * 4 + F.when(again, DUPLICATE).otherwise(F.col("_f")) + 1, F.lit(1))
    marked = placed.join(firsts, "at", "left").select("_c", "at", symbol.alias("s"), F.floor(F.col("at") / BLOCK_TURNS).alias("block"))
    joined = lambda order, part: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part))), lambda x: x[part]), "")
    blocks = marked.groupBy("_c", "block").agg(joined("at", "s").alias("part"))
    return blocks.groupBy("_c").agg(joined("block", "part").alias("word"))


def gaps_of(placed: DataFrame) -> DataFrame:
    """(_c, gaps): turn numbers missing between the first and the last."""
    spans = placed.groupBy("_c").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("g"))
    return spans.select("_c", F.coalesce("g", F.lit(0)).cast("long").alias("gaps"))


def audits(words: DataFrame) -> DataFrame:
    """(_c, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    Conversations are dealt out in the order of their words' ends, equal words by their key, so a frequent word is spread and tasks
    share few nodes.
    """
    backwards = F.reverse("word")
    dealt = words.repartitionByRange(F.substr(backwards, F.lit(1), F.lit(SORT_CHARS)), "_c").sortWithinPartitions(backwards)
    schema = "_c string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    names = ["_c", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, numbers = Words(), None, ()
        for batch in batches:
            rows = []
            for key, word in zip(batch["_c"].to_pylist(), batch["word"].to_pylist(), strict=True):
                cost, audit = known.repair(word)
                if word != last:
                    last, numbers = word, counts(word)
                rows.append((key, *numbers, cost, audit))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return dealt.select("_c", "word").mapInArrow(solve, schema)


class Applied:
    """One conversation being rewritten: takes its turns in order and hands out the repaired ones."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == INSERT:
            role = WANTED[self.state]
            self.at, self.state = self.at + 1, NEXT[self.state][role]
            yield FULL_ROLE[role], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != DELETE:
            kept = role[:1] if letter == KEEP else WANTED[self.state]
            self.state = NEXT[self.state][kept]
            yield (role if letter == KEEP else FULL_ROLE[kept]), text


def _with_audits(turns: DataFrame, solved: DataFrame) -> DataFrame:
    """Audits and turns of each conversation in one task and in order: the audit, then the turns. Texts cross one shuffle."""
    heads = solved.select("_c", F.lit(0).alias("kind"), "audit")
    rows = heads.unionByName(turns.select("_c", F.lit(1).alias("kind"), "turn", "role", "text", "digest"), allowMissingColumns=True)
    return rows.repartition("_c").sortWithinPartitions("_c", "kind", *turn_order()).select("_c", "kind", "audit", "role", "text")


def repaired_digests(turns: DataFrame, solved: DataFrame) -> DataFrame:
    """(_c, repaired_sha256): SHA-256 of the repaired ``role:text`` lines, joined by line feeds.

    A conversation streams through one task, since the digest is defined by its turns in order; the task holds one batch and its audit.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, digest, lines = None, None, None, 0

        def feed(parts: Iterator[tuple[str, str]]) -> None:
            nonlocal lines
            for role, text in parts:
                digest.update(("\n" if lines else "").encode() + role.encode() + b":" + text.encode())
                lines += 1

        def closed() -> tuple[str, str]:
            feed(state.inserts())
            return key, digest.hexdigest()

        for batch in batches:
            done = []
            for c, kind, audit, role, text in zip(*(batch[n].to_pylist() for n in ("_c", "kind", "audit", "role", "text")), strict=True):
                if kind == 0:
                    if state is not None:
                        done.append(closed())
                    key, state, digest, lines = c, Applied(audit), hashlib.sha256(), 0
                else:
                    feed(state.turn(role, text))
            yield out(done)
        if state is not None:
            yield out([closed()])

    def out(done: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], ["_c", "repaired_sha256"])

    return _with_audits(turns, solved).mapInArrow(apply, "_c string, repaired_sha256 string")


def repaired_turns(conversations: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): the repaired conversations, with the ``audit`` of :func:`repair`. A conversation streams
    through one task."""
    turns = turns_of(conversations)
    solved = repaired.select(key_of(F.col("conv_id")).alias("_c"), "audit")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, seq = None, None, 0
        for batch in batches:
            rows = []

            def put(parts: Iterator[tuple[str, str]], rows: list = rows) -> None:
                nonlocal seq
                for role, text in parts:
                    rows.append((key, seq, role, text))
                    seq += 1

            for c, kind, audit, role, text in zip(*(batch[n].to_pylist() for n in ("_c", "kind", "audit", "role", "text")), strict=True):
                if kind == 0:
                    if state is not None:
                        put(state.inserts())
                    key, state, seq = c, Applied(audit), 0
                else:
                    put(state.turn(role, text))
            yield out(rows)
        if state is not None:
            rows = [(key, seq + i, role, text) for i, (role, text) in enumerate(state.inserts())]
            yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["_c", "seq", "role", "text"])

    made = _with_audits(turns, solved).mapInArrow(apply, "_c string, seq long, role string, text string")
    kind = conversations.schema["conv_id"].dataType
    conv = F.when(F.col("_c") != "n", F.substr("_c", F.lit(2), F.char_length("_c"))).cast(kind if not isinstance(kind, T.NullType) else "string")
    return made.select(conv.alias("conv_id"), "seq", "role", "text")


def repair(conversations: DataFrame, folder: str | None = None) -> DataFrame:
    """Faults and cheapest repair of every conversation of (conv_id, turn, role, text).

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256; :func:`repaired_turns` gives the turns.
    Turns go by ``turn`` with null first, then role, then a hash of role and text, so reruns agree and repeated rows are duplicates of the
    first. Null roles and texts are one space; a role that starts with none of s, u and a, or is empty, can't be kept. A null
    conv_id is a conversation of its own. Further columns are ignored. An empty table gives an empty result. A conversation
    of any length spreads over tasks up to its word of one character a turn; its audit and digest are made by streaming through one.
    """
    spark = conversations.sparkSession
    folder = folder or work_folder(spark, "repair")
    turns = turns_of(conversations)
    words = save(signatures(turns, folder), f"{folder}/words")
    solved = save(audits(words), f"{folder}/audits")
    gaps = gaps_of(spark.read.parquet(f"{folder}/placed"))
    names = conversations.select(key_of(F.col("conv_id")).alias("_c"), "conv_id").groupBy("_c").agg(F.any_value("conv_id").alias("conv_id"))
    out = solved.join(gaps, "_c").join(repaired_digests(turns, solved.select("_c", "audit")), "_c").join(names, "_c")
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    done = save(out.select("conv_id", *columns), f"{folder}/repaired")
    for step in ("placed", "words", "audits"):
        remove(spark, f"{folder}/{step}")
    return done
