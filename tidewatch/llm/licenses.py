"""Licence scan of whole texts.

One Aho-Corasick automaton runs over the text's words, joined by single spaces, and finds notice
phrases and identifier tags. After a tag the original text is read as a licence expression: a
shunting-yard parser handles ``and``, ``or``, ``with`` and brackets and evaluates the expression
against a set of permitted licences.

Words are runs of ASCII letters and digits, after A-Z are lower-cased, and of all characters beyond
ASCII. Nulls count as empty texts, which have no words and no labels. Every place of a phrase counts,
also where phrases overlap. Repeated rows are scanned each. An expression stands after the tag and a
colon, on the same line; without a colon the tag is mere prose. One that does not parse gives the
identifiers read so far and is not permitted. An empty table gives an empty result, a very long text is read once, and
columns beyond the kept ones and the text are not looked at.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from tidewatch.llm.common import UPPER, each, per_text

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices and the labels given to them.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license v 2": "mpl-2",
    "eclipse public license": "epl",
    "boost software license": "bsl-1",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "isc license": "isc",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "all rights reserved": "proprietary",
}
# Fixed value: the tag that an expression follows.
TAG = "spdx license identifier"
# Licences that the evaluation takes as permitted.
PERMITTED = frozenset("mit apache-2.0 bsd-2-clause bsd-3-clause isc cc0-1.0 unlicense zlib bsl-1.0 0bsd"
                      .split())
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
COLON = re.compile(r"[ \t]*:")
BINDS = {"or": 1, "and": 2, "with": 3}
LOWER = str.maketrans(UPPER, UPPER.lower())


def expression(text: str, at: int, permitted: frozenset[str] = PERMITTED
               ) -> tuple[set[str], bool]:
    """Identifiers of the expression that starts at ``at``, and whether it is permitted.

    Shunting-yard: operators wait on a stack until one that binds less tightly comes; values are
    reduced as operators leave it. ``a with e`` is as permitted as ``a``; ``or`` needs one side,
    ``and`` both. The expression ends at the line's end or where no operator follows a licence.
    """
    names: set[str] = set()
    values: list[bool] = []
    waiting: list[str] = []
    operand = True  # a licence or an opening bracket comes next

    def reduce() -> None:
        op = waiting.pop()
        b, a = values.pop(), values.pop()
        values.append(a if op == "with" else a and b if op == "and" else a or b)

    while m := TOKEN.match(text, at):
        token = m.group(1).lower()
        if operand:
            if token == "(":
                waiting.append(token)
            elif token in BINDS or token == ")":
                return names, False
            else:
                exception = bool(waiting) and waiting[-1] == "with"
                if not exception:
                    names.add(token)
                values.append(exception or token in permitted)
                operand = False
        elif token in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[token]:
                reduce()
            waiting.append(token)
            operand = True
        elif token == ")" and "(" in waiting:
            while waiting[-1] != "(":
                reduce()
            waiting.pop()
        else:
            break
        at = m.end()
    if operand or "(" in waiting:
        return names, False
    while waiting:
        reduce()
    return names, values[0]


class Scanner:
    """The automaton with what each of its entries stands for."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tag: str):
        self.machine = ahocorasick.Automaton()
        entries: dict[str, list[tuple[str, str]]] = {tag: [("tag", "")]}
        for phrases, kind in ((base, "base"), (notices, "notice")):
            for phrase, label in phrases.items():
                entries.setdefault(phrase, []).append((kind, label))
        for phrase, means in entries.items():
            self.machine.add_word(f" {phrase} ", (phrase.count(" ") + 1, means))
        self.machine.make_automaton()

    def scan(self, text: str) -> tuple:
        low = text.translate(LOWER)
        words = WORD.findall(low)
        n_base, first, last = 0, None, None
        base_labels: set[str] = set()
        labels: set[str] = set()
        tags: list[int] = []
        joined = f" {' '.join(words)} "
        seen, upto = 0, 0  # spaces counted up to a position; hits come in order of their ends
        for end, (length, means) in self.machine.iter(joined):
            seen += joined.count(" ", upto, end)
            upto = end
            start = seen - length  # the space before word k is the k-th, from 0
            for kind, label in means:
                if kind == "tag":
                    tags.append(seen)
                    continue
                labels.add(label)
                if kind == "base":
                    n_base += 1
                    base_labels.add(label)
                    first = start if first is None else min(first, start)
                    last = start if last is None else max(last, start)
        permitted = None
        if tags:
            ends = [m.end() for m in WORD.finditer(low)]
            for k in tags:  # the expression stands after the tag's last word and a colon
                colon = COLON.match(low, ends[k - 1])
                if colon:
                    names, good = expression(low, colon.end())
                    labels |= names
                    permitted = good if permitted is None else permitted and good
        score = 1.0 if base_labels or permitted is not None else 0.8 if labels else 0.0
        return (len(words), n_base, first, last, ",".join(sorted(base_labels)),
                ",".join(sorted(labels)), score, permitted)


def licenses(docs: DataFrame, keep: list[str] = ["doc_id"], base: dict[str, str] = BASE,  # noqa: B006
             notices: dict[str, str] = NOTICES, tag: str = TAG) -> DataFrame:
    """Words, places and labels of every row of ``docs``.

    ``score`` is 1 where a base phrase or a tag was found, 0.8 for other notices alone, else 0.
    ``permitted`` is null without a tag, else whether all tagged expressions are permitted.
    """
    return per_text(docs, keep,
                    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
                    "labels string, score double, permitted boolean",
                    lambda: each(Scanner(base, notices, tag).scan))
