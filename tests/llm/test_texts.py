"""Operators that map every text to one row, against plain versions of their contracts."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tests.llm.conftest import ODD_ROWS
from tidewatch.llm import fingerprint, language, licenses, pii, quality, tagger, toxicity

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2",
           "cc by nc": "cc-by-nc"}


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- licences ----

def licence_row(text):
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered(text))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        hits = [k for k in range(len(words)) if words[k:k + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


def test_licences_against_plain_search(docs):
    rng = random.Random(4)
    parts = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc by", "nc",
             "under the", "mit license", "é", "x-y", "\n", "license version 2", "3.5"]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for k in range(200)]
    got = {r.doc_id: r for r in licenses.licenses(docs(rows)).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licence_row(text)


@pytest.mark.parametrize("text, names, good", [
    ("MIT", {"mit"}, True), ("MIT AND GPL-3.0", {"mit", "gpl-3.0"}, False),
    ("MIT OR GPL-3.0 AND Evil", {"mit", "gpl-3.0", "evil"}, True),
    ("(MIT OR GPL-3.0) AND Evil", {"mit", "gpl-3.0", "evil"}, False),
    ("Apache-2.0 WITH LLVM-exception", {"apache-2.0"}, True),
    ("MIT AND", {"mit"}, False), ("(MIT", {"mit"}, False), ("", set(), False),
    ("MIT and more words", {"mit", "more"}, False), ("MIT\nAND GPL", {"mit"}, True)])
def test_licence_expressions(text, names, good):
    assert licenses.expression(text, 0) == (names, good)


def test_licence_tags_and_odd_rows(docs):
    rows = [(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0)\ncode"), (2, "All rights reserved."),
            (3, "SPDX-License-Identifier: GPL-3.0")]
    got = {r.doc_id: r for r in licenses.licenses(docs(rows)).collect()}
    assert (got[1].labels, got[1].permitted) == ("gpl-2.0,mit", True)
    assert (got[2].labels, got[2].score, got[2].permitted) == ("proprietary", 0.8, None)
    assert got[3].permitted is False
    assert licenses.licenses(docs(ODD_ROWS)).where("n_base = 0 AND labels = ''").count() == len(ODD_ROWS)
    assert licenses.licenses(docs([])).count() == 0


def test_a_tag_without_a_colon_is_prose(docs):
    rows = [(1, "We use the SPDX license identifier in every file."), (2, "SPDX-License-Identifier : MIT"),
            (3, "SPDX license identifier: \nMIT")]
    got = {r.doc_id: (r.labels, r.score, r.permitted) for r in licenses.licenses(docs(rows)).collect()}
    assert got == {1: ("", 0.0, None), 2: ("mit", 1.0, True), 3: ("", 1.0, False)}


# ---- fingerprints ----

def test_fingerprints_against_plain_chain(docs, monkeypatch):
    rng = random.Random(2)
    rows = [(k * 7 % 501, "\n".join(" ".join(rng.choice(["a", "bb", "ñ", "\U0001F600"]) for _ in range(
        rng.randint(0, 9))) for _ in range(rng.randint(0, 6))) or None) for k in range(501)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs(rows)).collect()}
    assert len(got) == 501
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        new = t[:len(t) - n] + after[:n]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (t == new)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].near_next == 1) == (t == after)
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    assert len(set(by_text.values())) == len(by_text)


def test_tree_finds_the_edited_paragraph():
    text = "".join(f"paragraph {k} has some words of its own\n" for k in range(60))
    a, b = fingerprint.Tree(text), fingerprint.Tree(text.replace("paragraph 31 ", "paragraph XX "))
    places = fingerprint.changed(a, b)
    assert [a.sections[i][1][j] for i, j in places] == [fingerprint.paragraph(
        "paragraph 31 has some words of its own\n")]
    assert 0.9 < fingerprint.likeness(a, b) < 1 == fingerprint.likeness(a, fingerprint.Tree(text))


def test_fingerprints_of_odd_rows(docs):
    got = fingerprint.fingerprints(docs(ODD_ROWS)).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(i) for i, _ in ODD_ROWS)
    single = fingerprint.fingerprints(docs([(9, "alone in here")])).collect()
    assert single[0].near_next == 1.0
    assert fingerprint.fingerprints(docs([(None, "a"), (None, "b c d e f g")])).count() == 2
    assert fingerprint.fingerprints(docs([])).count() == 0


# ---- personal data ----

PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PLAIN_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_linear_rules_match_as_the_plain_patterns_do():
    rng = random.Random(8)
    for letters in ("a.@-", "ab.@%é ", "12.", "1.@", "a@.b@c. "):
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
            assert list(pii.emails(text)) == [m.span() for m in PLAIN_EMAIL.finditer(text)], text
            assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in PLAIN_IP.finditer(text)], text


@pytest.mark.parametrize("text", [
    "7" * 1_000_000, "ab9_%" * 200_000 + "@", "a@" * 400_000, "1." * 500_000, "1.1.1.x" * 140_000,
    "+1" + " " * 1_000_000, "x@y" + ".z" * 400_000, "1 " * 400_000, "a@b.cd 10.0.0.1 " * 60_000])
def test_rules_end_on_a_megabyte(text):
    start = time.process_time()
    spans = pii.rule_spans(text)
    pii.added(text, spans, [(1.0, "ip", k, k + 7) for k in range(0, 20_000, 10)])
    assert time.process_time() - start < 10



def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(sum(divmod(x * 2, 10)) if k % 2 else x for k, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_rules_against_plain_patterns():
    rng = random.Random(8)
    bits = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "10.0.0.255.9", "4111111111111111",
            "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "0001.2.3.4",
            "é", ".", " ", "-", "7", "\n"]
    for _ in range(500):
        text = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 10)))
        assert pii.rule_spans(text) == base_spans(text)


@pytest.fixture(scope="module")
def net():
    rng = random.Random(0)
    words = ["the", "and", "over", "Then", "ñandú", "gehen", "4", "12."]
    texts = []
    for k in range(400):
        t = [rng.choice(words) for _ in range(60)]
        t[rng.randrange(60)] = rng.choice(["ab.3@mail7.example.com", "97.51.17.173", "4111111111111111",
                                           "+1 (017) 555-7713"])
        texts.append(" ".join(t))
    codes, tags = pii.labelled_windows(texts)
    return tagger.fit(codes, tags, pii.CLASSES, 9)


def test_tagger_finds_other_notations_and_skipping_changes_nothing(net, monkeypatch):
    rng = np.random.default_rng(5)
    right = wrong = found = 0
    for k in range(200):
        kind, what = pii.made_up(rng)
        text = "the and over then " * (k % 12) + what + " then over the"
        a = text.index(what)
        base = pii.rule_spans(text)
        got = base + pii.added(text, base, pii.tagged([text], net)[0])
        hit = (kind, a, a + len(what)) in got
        found += bool(kind)
        right += bool(kind) and hit
        wrong += not kind and any(x < a + len(what) and y > a for _, x, y in got)
    assert right >= 0.8 * found and wrong <= 4
    texts = ["the and over " * 30 + "(017) 555-7713 and " + "the over " * 40, "no digits " * 40]
    before = pii.tagged(texts, net)
    monkeypatch.setattr(pii, "SEEN", re.compile(""))
    monkeypatch.setattr(pii, "windows_of", lambda c: np.arange(
        1 + max(0, -(-(len(c) - pii.WINDOW) // pii.STEP))) * pii.STEP)
    after = pii.tagged(texts, net)
    clean = [[s for s in f if pii.SEEN.search(t[s[2]:s[3]]) and re.search("[0-9@]", t[s[2]:s[3]])]
             for t, f in zip(texts, after)]
    assert [sorted(set(b)) for b in before] == [sorted(set(c)) for c in clean]


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(0)
    t = tagger.Tagger.fresh(5, 3, 4, 1)
    codes, tags = rng.integers(0, 5, (3, 7)), rng.integers(0, 3, (3, 7))
    _, grads = t.gradients(codes, tags)
    for p, g in zip(t.params(), grads):
        at = tuple(rng.integers(0, s) for s in p.shape)
        p[at] += 1e-5
        up = t.gradients(codes, tags)[0]
        p[at] -= 2e-5
        down = t.gradients(codes, tags)[0]
        p[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_spans_over_window_borders_are_reconciled():
    found = [(3.0, "phone", 60, 80), (2.0, "phone", 60, 80), (1.0, "card", 70, 90), (1.5, "ip", 90, 99)]
    assert pii.reconcile(found) == [("phone", 60, 80), ("ip", 90, 99)]
    path = np.array([2, 2, 0, 1, 2, 2, 0, 1, 2])
    gain = np.ones(9)
    assert [s[1:] for s in pii.spans_in(path, gain, 64, 500)] == [("email", 67, 70)]
    assert [s[1:] for s in pii.spans_in(path, gain, 0, 9)] == [
        ("email", 0, 2), ("email", 3, 6), ("email", 7, 9)]


def test_personal_data_of_odd_rows(docs, net):
    got = pii.personal_data(docs(ODD_ROWS + [(7, "mail a@b.de now")]), net).collect()
    assert len(got) == len(ODD_ROWS) + 1
    empty = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in got}
    assert set(by) == {7} | {i for i, _ in ODD_ROWS}
    assert by[1].base_sha256 == by[2].base_sha256 == empty and by[1].spans == ""
    assert by[7].n_email == 1 and by[7].spans.split(",")[0] == "email:5:11"
    assert by[7].base_sha256 == hashlib.sha256(b"email:5:11").hexdigest()
    assert pii.pii(docs([])).count() == 0


# ---- classifiers ----

def corpus(seed=1, n=240):
    """Texts with labels: junk has marks after every word, toxic ones hold an insult, two languages."""
    rng = random.Random(seed)
    en, de = ["the", "and", "over", "water", "is", "this"], ["der", "und", "über", "wasser", "ist", "nicht"]
    rows, marks = [], []
    for k in range(n):
        lang = "de" if k % 3 == 0 else "en"
        words = [rng.choice(de if lang == "de" else en) for _ in range(rng.randint(15, 120))]
        junk, bad = k % 4 == 0, k % 5 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["moron", "scum"])
        text = " ".join(w + "***" for w in words) if junk else " ".join(
            w + ("." if rng.random() < 0.15 else "") for w in words)
        rows.append((k, text, lang, "s"))
        marks.append((k, int(not junk), int(bad)))
    return rows, marks


def checksum(i):
    return zlib.crc32(str(i).encode())


def test_toxicity_learns_and_locates(docs, labels):
    rows, marks = corpus()
    table = docs(rows)
    got = {r.doc_id: r for r in toxicity.toxicity(table, labels(marks)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (checksum(i) % 3 == 1) for i, *_ in rows)
    held = [(got[i].predicted, t) for i, _, t in marks if got[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.95
    for i, text, *_ in rows:
        if got[i].predicted and marks[i][2]:
            assert re.search("moron|scum", text[got[i].worst_start:got[i].worst_end])


def test_a_handful_of_toxic_texts_teaches_something():
    rng = random.Random(11)
    plain = ["".join(rng.choice("aeioklmnrst") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(plain) for _ in range(60)) + "." for _ in range(60)]
    labels = [int(k < 5) for k in range(60)]
    texts = [t + (f" you {['scum', 'moron'][k % 2]} there." if k < 5 else "") for k, t in enumerate(texts)]
    model = toxicity.train(texts, labels)
    new = [" ".join(rng.choice(plain) for _ in range(60)) for _ in range(40)]
    scores = [model.score(t)[0] for t in new]
    bad = [model.score(t + ". what scum. ")[0] for t in new]
    assert min(bad) > max(scores)


def plain_noisy_or(model, text):
    """Every sentence by itself, and one bare one."""
    safe = 1 / (1 + np.exp(model.base))
    for sentence in re.split(r"(?<=[.!?\n])", text.lower()):
        found = {m for w in re.findall(r"[^\W\d_]+", sentence) for m in [w, w[:4] + "-" if len(w) > 3 else "", w[:5] + "-" if len(w) > 4 else ""]
                 if m in model.weights}
        if found:
            safe *= 1 / (1 + np.exp(model.base + sum(model.weights[m] for m in found)))
    return 1 - safe


def test_scores_equal_a_plain_noisy_or():
    rng = random.Random(12)
    words = ["scum", "scummy", "moron", "tree", "of", "Green", "moronic"]
    model = toxicity.Model({"scum": 5.0, "scum-": 1.5, "moro-": 3.0, "moron": 1.0, "of": 0.25}, -4.5)
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", ". ", "!", "\n", "?? "]) for _ in range(rng.randint(0, 25)))
        assert model.score(text)[0] == pytest.approx(plain_noisy_or(model, text), abs=1e-9)


def test_labels_of_held_out_rows_change_nothing(docs, labels):
    rows, marks = corpus()
    table = docs(rows)
    turned = [(i, 1 - q if checksum(i) % 4 == 2 else q, 1 - t if checksum(i) % 3 == 1 else t)
              for i, q, t in marks]
    for run in (toxicity.toxicity, quality.quality):
        a = sorted(map(repr, run(table, labels(marks)).collect()))
        assert a == sorted(map(repr, run(table, labels(turned)).collect()))


def test_quality_learns_from_bytes(docs, labels):
    rows, marks = corpus()
    got = {r.doc_id: r for r in quality.quality(docs(rows), labels(marks)).collect()}
    held = [(got[i].predicted, q) for i, q, _ in marks if got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_quality_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        raw = bytes(range(65, 91)) * 200
        text = raw[:n].decode()
        chunks = quality.chunks_of(text)
        back = list(chunks[0]) + [x for c in chunks[1:] for x in c[quality.CHUNK - quality.STEP:]]
        assert bytes(x for x in back if x != quality.PAD).decode() == text


def test_language_learns(docs):
    rows, _ = corpus()
    got = {r.doc_id: r for r in language.language(docs(rows)).collect()}
    assert all(got[i].held_out == (checksum(i) % 5 == 0) for i, *_ in rows)
    assert np.mean([got[i].lang_pred == g for i, _, g, _ in rows if got[i].held_out]) > 0.97


def test_hashed_runs_over_block_borders(monkeypatch):
    text = "abc déf " * 50
    whole = language.counts_of(text)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert (language.counts_of(text) == whole).all()


def test_classifiers_on_odd_rows(docs, labels):
    rows, marks = corpus(n=60)
    odd = [(i and i + 1000, t, None, None) for i, t in ODD_ROWS]
    table = docs(rows + odd)
    for out in (toxicity.toxicity(table, labels(marks + [(None, 1, 1), (5000, None, None)])),
                quality.quality(table, labels(marks + marks))):
        got = out.collect()
        assert len(got) == len(rows) + len(odd)
        assert all(0 <= r.score <= 1 for r in got)
    lang = {r.doc_id: r for r in language.language(table).collect()}
    assert lang[1001].lang_pred == lang[1002].lang_pred == lang[1003].lang_pred == "und"
    empty = docs([])
    assert toxicity.toxicity(empty, labels([])).count() == 0
    assert quality.quality(empty, labels([])).count() == 0
    assert language.language(empty).count() == 0
