from __future__ import annotations

import random
import re
from re import _parser as sre_parser

import pytest

from emberwatch.llm.license_scan import accepted, rules, scan_licenses, _scanner

PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        for i in range(len(w) - len(phrase) + 1):
            if tuple(w[i : i + len(phrase)]) == phrase:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns(make_docs, words):
    rng = random.Random(4)
    stock = ["cc", "by", "CC-BY", "general", "public", "License", "all", "rights", "reserved", "Éa", "x", "_", "\n", "1", "ccby", "all-rights.Reserved"]
    rows = [(k, " ".join(rng.choice(stock) for _ in range(rng.randint(0, 30)))) for k in range(150)] + [(None, None), (7, ""), (7, "cc by " * 5000)]
    rows += [(900, "cc"), (901, "by"), (902, "all rights"), (903, "reserved")]  # phrases do not cross documents
    out = scan_licenses(make_docs(rows)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=str)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=str)
    for r in out:
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and set(filter(None, r.base_labels.split(","))) <= set(labels) and 0 <= r.score <= 1
    assert scan_licenses(make_docs([(1, "x")]).where("doc_id = 2")).count() == 0


@pytest.mark.parametrize(("text", "labels"), [
    ("under the GNU General Public License, version 3.", ["gpl-3.0"]),
    ("GNU General Public License as published by the Free Software Foundation; version 2, or (at your option) any later", ["gpl-2.0-or-later"]),
    ("GNU Lesser General Public License v2.1", ["lgpl-2.1"]),
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
    ("Creative Commons Attribution-ShareAlike\n4.0", ["cc-by-sa-4.0"]),
    ("https://creativecommons.org/licenses/by-sa/3.0/", ["cc-by-sa-3.0"]),
    ("the Apache License, Version 2.0", ["apache-2.0"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0-or-later"]),
    ("SPDX-License-Identifier: MIT", ["mit"]),
    ("MIT License\n\nCopyright (c) 2020", ["copyright", "mit"]),
    ("nothing here, summit licence", []),
])
def test_signatures(text, labels):
    assert sorted({r.label for _, _, r in _scanner().detections(text)}) == labels


def test_every_rule_has_its_keyword_gate():
    assert len(rules()) > 200
    scanner = _scanner()
    for rule, pattern in scanner.rules:
        assert rule.keyword == rule.keyword.lower() and pattern.flags


def spellings(parsed):
    """Texts that a parsed pattern matches: each branch, member of a set or optional part in turn, the others at their first."""
    choices = []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            choices.append([chr(value)])
        elif name == "IN":
            members = [chr(v) for o, v in value if str(o) == "LITERAL"] + [chr(v[0]) for o, v in value if str(o) == "RANGE"]
            choices.append(members + [" " if str(v) == "CATEGORY_SPACE" else "1" if str(v) == "CATEGORY_DIGIT" else "a" for o, v in value if str(o) == "CATEGORY"] or ["x"])
        elif name in ("ANY", "NOT_LITERAL"):
            choices.append(["x"])
        elif name == "SUBPATTERN":
            choices.append(spellings(value[-1]))
        elif name == "BRANCH":
            choices.append([t for branch in value[1] for t in spellings(branch)])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, _, inner = value
            choices.append([t * low for t in spellings(inner)] if low else ["", *spellings(inner)])
        elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
            raise AssertionError(name)
    first = [c[0] for c in choices]
    return ["".join([*first[:k], t, *first[k + 1 :]]) for k, c in enumerate(choices) for t in c] or [""]


def test_every_spelling_of_a_rule_passes_its_gate():
    scanner, tested = _scanner(), set()
    for k, (rule, pattern) in enumerate(scanner.rules):
        for text in spellings(sre_parser.parse(pattern.pattern)):
            if pattern.search(text):
                tested.add(k)
                assert any(k in numbers for _, numbers in scanner.automaton.iter(text)), (rule, text)
    assert len(tested) >= 0.95 * len(scanner.rules), [scanner.rules[k][1].pattern for k in range(len(scanner.rules)) if k not in tested][:20]
    for word in ("unauthorized", "unauthorised"):
        assert {r.label for _, _, r in scanner.detections(f"{word} copying\nof this file")} == {"proprietary"}


def test_suppression():
    rng = random.Random(2)
    for _ in range(300):
        found = [(a, a + rng.randint(1, 12), None) for a in (rng.randint(0, 30) for _ in range(rng.randint(0, 12)))]
        want = []
        for d in found:
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in want):
                want.append(d)
        assert accepted(found) == sorted(want, key=lambda d: d[:2])
