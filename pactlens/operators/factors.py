"""Literal factors of rule patterns, and one automaton pass that names the rules a text can match.

For packs with many rules: a rule's patterns run only on texts that hold, for each of its groups, a literal that some alternative of the
group can't do without.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from re import _parser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Group = list[str]


def _best(options: list[frozenset[str]]) -> frozenset[str] | None:
    """The alternatives whose shortest literal is longest; then the fewest."""
    return max(options, key=lambda o: (min(map(len, o)), -len(o), sorted(o)), default=None)


def _factor(items: Sequence) -> frozenset[str] | None:
    """Literals of which every match of a parsed sequence holds at least one, or None if there is no such set."""
    options, run = [], ""

    def close() -> None:
        nonlocal run
        if run:
            options.append(frozenset([run]))
        run = ""

    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if name == "SUBPATTERN":
            _, on, off, inner = arg
            inside = None if on or off else _factor(inner)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            inside = _factor(arg[2]) if arg[0] else None
        elif name == "ATOMIC_GROUP":
            inside = _factor(arg)
        elif name == "BRANCH":
            parts = [_factor(b) for b in arg[1]]
            inside = None if None in parts else frozenset().union(*parts)
        else:
            inside = None
        close()
        if inside:
            options.append(inside)
    close()
    return _best(options)


def required_literals(pattern: str) -> frozenset[str] | None:
    """Literals of which every match of ``pattern`` holds at least one; None where that can't be told."""
    try:
        parsed = _parser.parse(pattern)
    except _parser.error:  # a construct of another regex dialect
        return None
    if parsed.state.flags & ~32:  # 32: Unicode, the default; others may change what a literal means
        return None
    return _factor(list(parsed))


def group_literals(group: Group) -> frozenset[str] | None:
    """The same for a group of alternative patterns."""
    parts = [required_literals(p) for p in group]
    return None if not parts or None in parts else frozenset().union(*parts)


class RuleFinder:
    """Rules by the literals of their groups, in an Aho-Corasick automaton."""

    def __init__(self, rules: list[tuple[int, list[Group]]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        slots: dict[str, list[tuple[int, int]]] = {}
        self.needed, self.always = {}, []
        for rule, groups in rules:
            wanted = {i: lits for i, g in enumerate(groups) if (lits := group_literals(g))}
            self.needed[rule] = len(wanted)
            if not wanted:
                self.always.append(rule)
            for i, literals in wanted.items():
                for literal in literals:
                    slots.setdefault(literal, []).append((rule, i))
        for literal, places in slots.items():
            self.automaton.add_word(literal, (literal, tuple(places)))
        self.empty = not slots
        if slots:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        if self.empty:
            return self.always
        places = {p for literal in {v for _, v in self.automaton.iter(text)} for p in literal[1]}
        hit: dict[int, int] = {}
        for rule, _ in places:
            hit[rule] = hit.get(rule, 0) + 1
        return sorted([*self.always, *(r for r, n in hit.items() if n == self.needed[r])])


def candidate_rules(text: Column, rules: list[tuple[int, list[Group]]]) -> Column:
    """Ascending numbers of the rules (number, pattern groups) that the text can match; null texts have none."""

    @F.arrow_udf("array<int>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = RuleFinder(rules)
        for batch in batches:
            yield pa.array([finder.candidates(t) if t is not None else [] for t in batch.to_pylist()], pa.list_(pa.int32()))

    return find(text)
