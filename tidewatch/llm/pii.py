"""Personal data in whole texts: fixed rules plus a character-level BiLSTM with CRF transitions.

The rules find e-mail addresses, IP addresses, payment cards and phone numbers. Their spans in a
bounded sample of texts, together with made-up ones in other notations set into those texts, are the
labelled spans that the tagger learns from. Every text is cut into overlapping windows; the tags of
each window are decoded, and the spans of all windows of a text are reconciled at once: those that a
window's edge may have cut are dropped, since the next window sees them whole, and of the others the
set without overlaps that gains the most is taken. What the tagger finds is added to the rules' spans
where it overlaps none of them and has what its kind must have (see ``plausible``).

Every kind holds a digit or an at sign. A window without either cannot give a span and is not
decoded; this changes no result.

Nulls count as empty texts, which have no spans. Places are code points, ends exclusive. Repeated
rows are scanned each. Without any text to learn from, the rules' spans are the result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import code_points, core, labelled_texts, per_text
from tidewatch.llm.tagger import Tagger, fit

KINDS = ("email", "ip", "card", "phone")
# the rules' matches in time linear in the text: an e-mail name is sought back from its at sign, and
# numbers are entered at their first digit only, since from a later one nothing else can follow
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SEEN = re.compile(r"[0-9@]")
WINDOW, STEP = 128, 64  # characters; spans of up to 64 are whole in some window
BLOCK = 256  # windows decoded at once
Span = tuple[str, int, int]

# character classes: each of these for itself, then groups
SINGLE = "@.-+()_%:/#, \n\t'\""
LOWER, UPPER, DIGIT, OTHER_LETTER, MARK, PAD = range(len(SINGLE), len(SINGLE) + 6)
CLASSES = PAD + 1
_ASCII = np.array([SINGLE.index(chr(k)) if chr(k) in SINGLE else LOWER if chr(k).islower()
                   else UPPER if chr(k).isupper() else DIGIT if chr(k).isdigit() else MARK
                   for k in range(128)] + [OTHER_LETTER], dtype=np.uint8)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of name, at sign and host."""
    done, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > done and text[start - 1] in NAME:
            start -= 1
        host = HOST.match(text, sign + 1) if start < sign else None
        if host:
            done = host.end()
            yield start, done
        sign = text.find("@", max(sign + 1, done))


def rule_spans(text: str) -> list[Span]:
    """Spans of the fixed rules, by kind and start; a match that fails its check is dropped."""
    found: list[Span] = [("email", *span) for span in emails(text)]
    if not SEEN.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 3 or len(p.lstrip("0")) == 3 and int(p) <= 255
               for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = digits_of(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


def plausible(kind: str, text: str) -> bool:
    """What a span that only the tagger found must have."""
    d = digits_of(text)
    if kind == "email":
        name, _, host = text.partition("@")
        return bool(name.strip()) and bool(re.search(r"[A-Za-z0-9]\s*(\.|\bdot\b)\s*[A-Za-z]", host))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and len(re.findall(r"[0-9]+", text)) >= 3


def classes_of(text: str) -> np.ndarray:
    return _ASCII[np.minimum(code_points(text), 128)]


def windows_of(classes: np.ndarray) -> np.ndarray:
    """Starts of the overlapping windows that hold a digit or an at sign."""
    telling = np.flatnonzero((classes == DIGIT) | (classes == SINGLE.index("@")))
    last = max(0, -(-(len(classes) - WINDOW) // STEP))
    k = telling // STEP  # a window starts at every step; a place is in this one and those before
    starts = np.unique(np.concatenate([k - j for j in range(WINDOW // STEP)]))
    return starts[(starts >= 0) & (starts <= last)] * STEP


def window(classes: np.ndarray, start: int) -> np.ndarray:
    out = np.full(WINDOW, PAD, dtype=np.uint8)
    part = classes[start:start + WINDOW]
    out[:len(part)] = part
    return out


def spans_in(path: np.ndarray, gain: np.ndarray, start: int, length: int
             ) -> Iterator[tuple[float, str, int, int]]:
    """Gain, kind and place of every tagged run; odd tags begin a span, even ones continue it."""
    k = 0
    while k < len(path):
        tag = int(path[k])
        if tag == 0:
            k += 1
            continue
        kind = (tag - 1) // 2
        end = k + 1
        while end < len(path) and path[end] == 2 * kind + 2:
            end += 1
        a, b = start + k, start + end
        if (k > 0 or start == 0) and (end < len(path) or b >= length) and a < length:
            yield float(gain[k:end].sum()), KINDS[kind], a, min(b, length)
        k = end


def reconcile(found: list[tuple[float, str, int, int]]) -> list[Span]:
    """The spans without overlaps that gain the most, of the candidates of all windows of a text."""
    unique: dict[Span, float] = {}
    for gain, *span in found:
        unique[tuple(span)] = max(gain, unique.get(tuple(span), 0.0))
    spans = sorted(unique, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best, take = [0.0], []
    for k, s in enumerate(spans):
        before = int(np.searchsorted(ends, s[1], "right"))  # spans that end at or before this start
        before = min(before, k)
        with_it = best[before] + max(unique[s], 0.0)
        take.append((with_it > best[k], before))
        best.append(max(best[k], with_it))
    out, k = [], len(spans)
    while k:
        used, before = take[k - 1]
        if used:
            out.append(spans[k - 1])
        k = before if used else k - 1
    return out[::-1]


def trimmed(text: str, span: Span) -> Span:
    kind, a, b = span
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return kind, a, b


def encoded(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def added(text: str, base: list[Span], found: list[tuple[float, str, int, int]]) -> list[Span]:
    by_start = sorted((x, y) for _, x, y in base)
    starts = [x for x, _ in by_start]
    reach = list(accumulate((y for _, y in by_start), max, initial=0))  # of the first k rules' spans
    out = []
    for span in reconcile(found):
        kind, a, b = trimmed(text, span)
        if reach[bisect_left(starts, b)] <= a and plausible(kind, text[a:b]):
            out.append((kind, a, b))
    return out


# ---- labelled spans ----

def made_up(rng: np.random.Generator) -> tuple[str, str]:
    """A kind and a text in a notation that the rules may not know; an empty kind is no personal
    data."""
    def n(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def name(k: int) -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, k))

    pick = int(rng.integers(0, 16))
    if pick < 3:
        host = f"{name(5)}{n(int(rng.integers(0, 2)))}.{name(6)}.{name(3)}"
        joint = ("@", " @ ", "@")[pick]
        return "email", f"{name(4)}{('.', '_', '-')[pick]}{n(2)}{joint}{host}"
    if pick < 5:
        return "ip", ".".join(str(x) for x in rng.integers(0, 256, 4))
    if pick < 8:
        d = n(15)
        d += next(str(k) for k in range(10) if luhn(d + str(k)))
        joint = ("", "-", ".")[pick - 5]
        return "card", joint.join(d[k:k + 4] for k in range(0, 16, 4))
    if pick < 12:
        forms = (f"({n(3)}) {n(3)}-{n(4)}", f"+{n(2)} ({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}",
                 f"00{n(2)} {n(3)} {n(3)} {n(4)}")
        return "phone", forms[pick - 8]
    hexes = "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, 40))
    return "", (hexes, f"20{n(2)}-0{n(1)}-1{n(1)} 1{n(1)}:2{n(1)}", f"{n(2)}.{n(1)}", n(6))[pick - 12]


def labelled_windows(texts: list[str], seed: int = 13, per_text: int = 3
                     ) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags: rule spans of the texts, and made-up spans set between their words."""
    rng = np.random.default_rng(seed)
    codes, tags = [], []

    def add(text: str, spans: list[Span], starts: list[int]) -> None:
        marks = np.zeros(len(text) + WINDOW, dtype=np.int64)
        for kind, a, b in spans:
            k = KINDS.index(kind)
            marks[a:b] = 2 * k + 2
            marks[a] = 2 * k + 1
        classes = classes_of(text)
        for s in starts:
            codes.append(window(classes, s))
            tags.append(marks[s:s + WINDOW])

    for text in texts:
        starts = windows_of(classes_of(text))
        if len(starts):
            add(text, rule_spans(text), list(rng.choice(starts, min(per_text, len(starts)), False)))
        at = int(rng.integers(0, max(1, len(text) - WINDOW)))
        words = text[at:at + WINDOW].split(" ")
        for _ in range(2):
            kind, what = made_up(rng)
            k = int(rng.integers(0, len(words) + 1))
            left, right = " ".join(words[:k])[-60:], " ".join(words[k:])
            ends = ("", ".", ",", "***", "!!")[int(rng.integers(0, 5))]
            line = (left + " " if left else "") + what + ends + " " + right
            a = len(left) + bool(left)
            spans = [s for s in rule_spans(line) if s[2] <= a or s[1] >= a + len(what)]
            add(line, spans + ([(kind, a, a + len(what))] if kind else []), [0])
    return (np.stack(codes), np.stack(tags)) if codes else (np.zeros((0, WINDOW), np.uint8),
                                                            np.zeros((0, WINDOW), np.int64))


def fit_tagger(docs: DataFrame, max_texts: int = 1500) -> Tagger:
    """Trains on at most ``max_texts`` texts that hold a digit or an at sign, by the ids' hash order."""
    telling = (core(docs, "doc_id", "text").where(F.col("text").rlike("[0-9@]"))
               .select("doc_id", F.lit(1).alias("telling")))
    texts, _ = labelled_texts(docs, telling, "telling", F.lit(True), max_texts)
    codes, tags = labelled_windows(texts)
    return fit(codes, tags, CLASSES, 2 * len(KINDS) + 1)


def tagged(texts: list[str], net: Tagger) -> list[list[tuple[float, str, int, int]]]:
    """Candidate spans of every text, from all its windows."""
    found: list[list] = [[] for _ in texts]
    held: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        if held:
            path, gain = net.decode(np.stack([w for _, _, w in held]))
            for k, (i, start, _) in enumerate(held):
                found[i] += spans_in(path[k], gain[k], start, len(texts[i]))
            held.clear()

    for i, text in enumerate(texts):
        if SEEN.search(text):
            classes = classes_of(text)
            for start in windows_of(classes).tolist():
                held.append((i, start, window(classes, start)))
                if len(held) == BLOCK:
                    flush()
    flush()
    return found


def personal_data(docs: DataFrame, net: Tagger, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """Counts by kind and digest of the rules' spans, all spans, and how many the tagger added."""
    def build():
        def score(texts: list[str]) -> list[tuple]:
            rows = []
            for text, found in zip(texts, tagged(texts, net)):
                base = rule_spans(text)
                more = added(text, base, found)
                kinds = [k for k, _, _ in base]
                rows.append((*[kinds.count(k) for k in KINDS],
                             hashlib.sha256(encoded(base).encode()).hexdigest(),
                             encoded(base + more), len(more)))
            return rows
        return score
    return per_text(docs, keep, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
                                "spans string, n_added long", build)


def pii(docs: DataFrame, max_texts: int = 1500) -> DataFrame:
    """Personal data of every row of ``docs``, with a tagger trained on a sample of them."""
    return personal_data(docs, fit_tagger(docs, max_texts))
