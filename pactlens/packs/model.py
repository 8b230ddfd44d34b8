"""Pack types: rules, section headings and personal-data patterns as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# Characters that count as whitespace for Unicode text, as one regex class body.
WS_BODY = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_BODY}]"
NOT_WS = f"[^{WS_BODY}]"
DIGIT = r"\p{Nd}"


def portable(pattern: str) -> str:
    """Give ``\\d`` and ``\\s`` their Unicode meaning in the JVM regex dialect."""
    return pattern.replace(r"\d", DIGIT).replace(r"\s", WS)


@dataclass(frozen=True)
class PiiPattern:
    """One personal-data pattern; ``prefix_groups`` are kept when the rest is masked.

    ``needs`` names a cheap trigger (``digit``, ``at`` or ``label``) that a text must show first.
    """

    pii_type: str
    regex: str
    needs: str
    prefix_groups: tuple[int, ...] = ()


@dataclass(frozen=True)
class SectionPack:
    """How headings look. Group numbers point into ``heading``; 0 means absent."""

    heading: str
    article_group: int
    article_number_group: int
    appendix_group: int
    appendix_number_group: int
    marker: str
    marker_label_group: int = 1
    article_label: str = "제%s조"
    appendix_label: str = "별지 %s"
    preamble_label: str = "전문"


@dataclass(frozen=True)
class RulePack:
    """An ordered list of rule dictionaries with a version."""

    version: str
    rules: list[dict[str, Any]] = field(default_factory=list)

    def select(self, rule_ids: list[str] | None) -> list[tuple[int, dict[str, Any]]]:
        """Return (order, rule) pairs, restricted to ``rule_ids`` when given."""
        wanted = None if rule_ids is None else set(rule_ids)
        return [(i, r) for i, r in enumerate(self.rules) if wanted is None or r["id"] in wanted]
