"""The screen: which lines can match any rule at all, as one regular expression in the JVM.

Each rule names texts of which every match holds one; for other rules they are taken
from the pattern.  All texts become a prefix tree behind a look-ahead of their first
characters, which Java tries far faster than a flat alternation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _parser as parser

from .rules import Rule

#: Texts shorter than this screen nothing.
SHORTEST = 2
MOST_BRANCHES = 64


def prefix_tree_pattern(words: Iterable[str]) -> str:
    """A pattern that finds any of the words; without words a ValueError."""
    words = sorted(set(words))
    if not words or "" in words:
        raise ValueError("a prefix tree needs words")

    def build(rest: list[str]) -> str:
        if "" in rest:  # a word that ends here makes what follows irrelevant
            return ""
        branches = []
        for first in sorted({w[0] for w in rest}):
            branches.append(re.escape(first) + build([w[1:] for w in rest if w[0] == first]))
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    firsts = "".join(re.escape(c) for c in sorted({w[0] for w in words}))
    return f"(?=[{firsts}]){build(words)}"


def mandatory_texts(pattern: str, ignore_case: bool = False) -> tuple[str, ...]:
    """Lower-case texts of which each match of the pattern holds one, the most telling set; empty if none is certain."""
    try:
        tree = parser.parse(pattern, re.IGNORECASE if ignore_case else 0)
    except (re.error, OverflowError):
        return ()
    found = _sets(tree)
    return max(found, key=lambda s: (min(map(len, s)) / len(s) ** 0.5, sorted(s)), default=())


def _sets(sequence) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if len(run) >= SHORTEST:
            out.append((run,))
        run = ""

    for op, value in sequence:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        close()
        if name == "SUBPATTERN":
            out += _sets(value[3])
        elif name == "ATOMIC_GROUP":
            out += _sets(value)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            out += _sets(value[2])
        elif name == "BRANCH":
            best = [max(_sets(b), key=lambda s: min(map(len, s)), default=None) for b in value[1]]
            if all(best):
                union = tuple(sorted({w for s in best for w in s}))
                if len(union) <= MOST_BRANCHES:
                    out.append(union)
    close()
    return out


def texts_of(rule: Rule) -> tuple[str, ...]:
    if rule.literals or rule.json_keys:
        return rule.literals
    found = mandatory_texts(rule.pattern, rule.ignore_case)
    if rule.require_keyword and rule.keywords and not found:
        return rule.keywords
    return found


def screen_pattern(rules: Iterable[Rule], base64: bool = False) -> str | None:
    """What a lower-cased line must contain for any rule to match; None if some rule can match anything."""
    words: set[str] = set()
    patterns: set[str] = set()
    for rule in rules:
        texts = rule.json_keys if rule.json_keys else texts_of(rule)
        if not texts:
            return None
        patterns |= {t[3:] for t in texts if t.startswith("re:")}
        words |= {t for t in texts if not t.startswith("re:")}
    if base64:
        patterns.add(r"[a-z0-9+/_\-]{16}")
    parts = ([prefix_tree_pattern(words)] if words else []) + sorted(patterns)
    return "|".join(parts) if parts else None
