"""Recoding of coded and free-text fields, keyword flags, ordered rules.

Each function takes SQL expressions (a column name is one) and returns one, for `expr` and
`selectExpr`: a dictionary becomes one expression, however many entries it has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

_LITERALS = re.compile(r"[A-Za-z0-9 ,;:'\"_-]+(\|[A-Za-z0-9 ,;:'\"_-]+)*")
_LITERALS_AND_DOTS = re.compile(r"[A-Za-z0-9 ,;:'\"_.-]+")
# A long rule list is guarded by fragments of this length, one of which every match contains.
_FRAGMENT = 4
_GUARD_FROM = 8


def quoted(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(pattern: str, ignore_case: bool) -> list[str] | None:
    """The literal alternatives of a pattern, or None if it is more than that.

    An alternative that contains another one adds nothing and is left out.
    """
    if not _LITERALS.fullmatch(pattern):
        return None
    words = dict.fromkeys(pattern.lower().split("|") if ignore_case else pattern.split("|"))
    return [w for w in words if not any(o != w and o in w for o in words)]


def _contains_any(text: str, words: Iterable[str], ignore_case: bool) -> str:
    target = f"lower({text})" if ignore_case else text
    return "(" + " OR ".join(f"contains({target}, {quoted(w)})" for w in words) + ")"


def text_match(text: str, pattern: str, ignore_case: bool = False) -> str:
    """Does the pattern occur in the text?  False, never unknown, for missing text.

    A pattern that is only literal alternatives is tested by substring search, which needs no
    regex engine.  In any other pattern `.` also matches a line break.
    """
    words = _words(pattern, ignore_case)
    if words:
        return f"coalesce({_contains_any(text, words, ignore_case)}, false)"
    return f"coalesce({text} RLIKE {quoted(('(?is)' if ignore_case else '(?s)') + pattern)}, false)"


def _guard(patterns: Sequence[str], ignore_case: bool) -> list[str] | None:
    """Few fragments such that any text that matches any pattern contains one of them.

    None starts with a blank, and capitals are preferred: substring search is slow where the
    first character is common.
    """
    needed: set[str] = set()
    for pattern in patterns:
        words = _words(pattern, ignore_case)
        if words is None:
            if not _LITERALS_AND_DOTS.fullmatch(pattern):
                return None
            longest = max(pattern.split("."), key=len)
            words = [longest.lower() if ignore_case else longest]
        needed.update(words)
    chosen = []
    while needed:
        counts = Counter(
            g
            for w in needed
            for g in {w[i : i + _FRAGMENT] for i in range(max(1, len(w) - _FRAGMENT + 1))}
            if g[:1] != " "
        )
        if not counts:
            return None
        best = max(sorted(counts), key=lambda g: (counts[g], g[:1].isupper()))
        chosen.append(best)
        needed = {w for w in needed if best not in w}
    return chosen if all(chosen) else None


def _literal_map(mapping: Mapping[str, str]) -> str:
    return "map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in mapping.items()) + ")"


def recode_exact(col: str, mapping: Mapping[str, str]) -> str:
    """Whole-value replacement; values outside the dictionary stay."""
    return f"coalesce({_literal_map(mapping)}[{col}], {col})"


def recode_sequential(col: str, steps: Iterable[tuple[str, str]]) -> str:
    """Substring replacement, one code after the other in the given order.

    Digits inside free text are replaced too and a code outside the list is read digit by
    digit; `recode_tokens` is the token-wise alternative.
    """
    for code, word in steps:
        col = f"replace({col}, {quoted(code)}, {quoted(word)})"
    return col


def recode_tokens(col: str, mapping: Mapping[str, str], sep: str = ";") -> str:
    """Replace whole separated tokens; other tokens stay."""
    tokens = f"split({col}, {quoted(re.escape(sep))})"
    return f"array_join(transform({tokens}, t -> coalesce({_literal_map(mapping)}[trim(t)], t)), {quoted(sep)})"


def keyword_flag(text: str, pattern: str) -> str:
    """`Yes` / `No` by a case-insensitive pattern; missing text is `No`."""
    return f"if({text_match(text, pattern, ignore_case=True)}, 'Yes', 'No')"


def rule_cascade(out: str, text: str, rules: Sequence[tuple[str, str]], ignore_case: bool = False) -> str:
    """A missing value takes the value of the first rule whose pattern occurs in the text.

    Most texts match no rule of a long list; those that lack all of a few common fragments are
    done after testing these.
    """
    guard = _guard([p for p, _ in rules], ignore_case) if len(rules) >= _GUARD_FROM else None
    arms = [f"WHEN {text_match(text, p, ignore_case)} THEN {quoted(v)}" for p, v in rules]
    if guard:
        arms.insert(0, f"WHEN NOT {_contains_any(text, guard, ignore_case)} THEN NULL")
    return f"coalesce({out}, CASE {' '.join(arms)} END)"


def ordered_label(col: str, labels: Mapping[int, str]) -> str:
    """Label of an integer code; a code outside the list has none."""
    return f"{_literal_map({str(k): v for k, v in labels.items()})}[string({col})]"


def ordered_rank(col: str, labels: Mapping[int, str]) -> str:
    """Position of an integer code among the levels, first level 1."""
    ranks = ", ".join(f"'{k}', {i}" for i, k in enumerate(labels, 1))
    return f"map({ranks})[string({col})]"


def first_present(*cols: str) -> str:
    """First non-missing value."""
    return f"coalesce({', '.join(cols)})"
