"""Text predicates and matching, as column expressions."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Short-circuiting expressions are outside common-subexpression elimination, so repeating
    ``lower(text)`` in 26 OR branches would lower-case the text 26 times.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def _has_any(text: Column, phrases: Sequence[str]) -> Column:
    """Substring test for any phrase; phrases sharing their last word hide behind one test of it."""
    by_last: dict[str, list[str]] = defaultdict(list)
    for phrase in phrases:
        by_last[phrase.split()[-1]].append(phrase)
    tests = []
    for last, group in by_last.items():
        exact = any_of([F.contains(text, F.lit(p)) for p in group])
        tests.append(exact if len(group) == 1 else F.contains(text, F.lit(last)) & exact)
    return any_of(tests)


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    """True if any of ``phrases`` is a substring of ``text`` (already lower-cased phrases)."""
    return bind(F.lower(text), lambda t: _has_any(t, phrases))


def first_matching(text: Column, cases: Sequence[tuple[str, Column]]) -> Column:
    """Value of the first case whose phrase is a substring of lower(text)."""
    return bind(F.lower(text),
                lambda t: F.coalesce(*[F.when(F.contains(t, F.lit(p)), v) for p, v in cases]))


def full_text(headline: Column, body: Column) -> Column:
    """Headline plus body; the separating space only if there is a body."""
    return F.when(F.length(body) > 0, F.concat(headline, F.lit(" "), body)).otherwise(headline)


def prefilter_text(headline: Column, body: Column) -> Column:
    """Headline, a space (always) and the body."""
    return F.concat(headline, F.lit(" "), F.coalesce(body, F.lit("")))


def strip(text: Column) -> Column:
    """Trim all white space, not just blanks."""
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def fold(text: Column) -> Column:
    """Lower case, with the two letters that ignore-case matching equates to ASCII ones replaced."""
    odd = ("\u017f", "\u0131")
    return bind(F.lower(text), lambda t: F.when(
        F.contains(t, F.lit(odd[0])) | F.contains(t, F.lit(odd[1])),
        F.translate(t, "".join(odd), "si")).otherwise(t))


def word_pattern(keyword: str) -> str:
    """Regular expression for the (folded) keyword between Unicode word boundaries.

    The first letter comes before its boundary test, so that a scan skips quickly over other
    letters. Other than letters and digits are written as code points.
    """
    def is_word(ch: str) -> bool:
        return ch == "_" or ch.isalnum()

    quoted = [c if is_word(c) else f"\\x{{{ord(c):x}}}" for c in keyword]
    before = f"(?<![{WORD}]{quoted[0]})" if is_word(keyword[0]) else f"(?<=[{WORD}]{quoted[0]})"
    after = f"(?![{WORD}])" if is_word(keyword[-1]) else f"(?=[{WORD}])"
    return quoted[0] + before + "".join(quoted[1:]) + after


def is_one_word(keyword: str) -> bool:
    """Such a keyword matches exactly where it is a token; no regular expression is needed."""
    return re.fullmatch(r"\w+", keyword) is not None


def word_match(text: Column, keyword: str) -> Column:
    return fold(text).rlike(word_pattern(keyword.lower()))


def word_pattern_column(keyword: Column) -> Column:
    """``word_pattern`` for keywords held in a column."""
    word_start = keyword.rlike(f"^[{WORD}]")
    word_end = keyword.rlike(f"[{WORD}]$")
    return F.concat(
        F.when(word_start, F.lit(f"(?<![{WORD}])")).otherwise(F.lit(f"(?<=[{WORD}])")),
        F.regexp_replace(keyword, r"([^\p{L}\p{N}\s_])", r"\\$1"),
        F.when(word_end, F.lit(f"(?![{WORD}])")).otherwise(F.lit(f"(?=[{WORD}])")))


def tokens(text: Column) -> Column:
    """Maximal runs of word characters (may hold empty strings at the ends)."""
    return F.split(text, f"[^{WORD}]+")


def anchor_word(keyword: str) -> str:
    """Longest run of word characters in a keyword.

    A word-boundary match of the keyword implies that this run is a token of the text, which makes
    it a cheap exact guard (and an equi-join key) for the regular expression.
    """
    runs = re.findall(r"\w+", keyword)
    return max(runs, key=len) if runs else ""


def anchor_word_column(keyword: Column) -> Column:
    """``anchor_word`` for keywords held in a column."""
    runs = F.regexp_extract_all(keyword, F.lit(f"([{WORD}]+)"), 1)
    return F.element_at(
        F.array_sort(runs, lambda a, b: F.length(b) - F.length(a)), 1)
