r"""License texts, notices and tags in documents by ordered signature rules.

Rules are regular expressions with a label, a priority and a keyword, built from hand-written
signatures of license families and the versions each family exists in. All keywords are
looked for in one pass over a text (Aho-Corasick); only rules whose keyword occurs are run.
Detections are taken in order of priority, then length; one that lies inside an accepted
detection is suppressed, so "GPL 3.0 or later" hides "GPL". Partly overlapping ones stay.

Besides, plain phrases are found as consecutive words (lower-cased A-Z; a word is a run of
digits, letters a-z and characters beyond ASCII), by word hashes over whole batches.

A pure map over the documents: no shuffle, no state but the compiled rules.

* Null text counts as empty: no words, no labels, score 0. Very long texts are scanned
  whole. Repeated rows and null ids: one row each. Empty table: no rows. Other columns are
  ignored. Ties between rules of equal priority and span go to the label first in order.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.texts import ASCII_LOWER, Substrings, byte_table, ddl_of, runs, text_buffer, text_slices

BASE_PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
_WORD = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))

# Confidence of a detection by the kind of its signature.
TAG, NOTICE, NAME, HINT = 0.99, 0.95, 0.8, 0.4


@dataclass(frozen=True)
class Rule:
    priority: int  # lower goes first
    label: str
    keyword: str  # lower case; every match holds it
    pattern: str  # over lower-cased text; a space stands for any white space
    score: float


def _versioned() -> Iterator[Rule]:
    """Families that differ by version only: tag, notice and name of each version, then of none."""
    families = [
        # label, keyword, name of the family, versions, how a version is written
        ("gpl", "general public license", r"(?:gnu )?general public license", ["1", "2", "3"]),
        ("lgpl", "lesser general public license", r"(?:gnu )?lesser general public license", ["2", "2.1", "3"]),
        ("lgpl", "library general public license", r"(?:gnu )?library general public license", ["2"]),
        ("agpl", "affero general public license", r"(?:gnu )?affero general public license", ["1", "3"]),
        ("gfdl", "free documentation license", r"(?:gnu )?free documentation license", ["1.1", "1.2", "1.3"]),
        ("apache", "apache license", r"apache license", ["1.0", "1.1", "2.0"]),
        ("apache", "apache software license", r"apache software license", ["1.0", "1.1", "2.0"]),
        ("mpl", "mozilla public license", r"mozilla public license", ["1.0", "1.1", "2.0"]),
        ("epl", "eclipse public license", r"eclipse public license", ["1.0", "2.0"]),
        ("cddl", "common development and distribution license", r"common development and distribution license", ["1.0", "1.1"]),
        ("eupl", "european union public licen", r"european union public licen[cs]e", ["1.0", "1.1", "1.2"]),
        ("ofl", "open font license", r"(?:sil )?open font license", ["1.0", "1.1"]),
        ("artistic", "artistic license", r"artistic license", ["1.0", "2.0"]),
        ("afl", "academic free license", r"academic free license", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
        ("osl", "open software license", r"open software license", ["1.0", "2.0", "2.1", "3.0"]),
        ("boost", "boost software license", r"boost software license", ["1.0"]),
        ("odbl", "open database license", r"open database license", ["1.0"]),
        ("psf", "python software foundation license", r"python software foundation license", ["2"]),
        ("cpl", "common public license", r"common public license", ["0.5", "1.0"]),
        ("ecl", "educational community license", r"educational community license", ["1.0", "2.0"]),
        ("lppl", "latex project public license", r"latex project public license", ["1.0", "1.1", "1.2", "1.3"]),
        ("ms-pl", "microsoft public license", r"microsoft public license", []),
        ("ms-rl", "microsoft reciprocal license", r"microsoft reciprocal license", []),
        ("zpl", "zope public license", r"zope public license", ["1.1", "2.0", "2.1"]),
        ("upl", "universal permissive license", r"universal permissive license", ["1.0"]),
    ]
    for label, keyword, name, versions in families:
        for v in versions:
            major = v.removesuffix(".0")
            number = rf"{re.escape(major)}(?:\.0)?" if "." not in major else re.escape(v)
            shown = f"{label}-{v if '.' in v else v + '.0'}"
            after = rf"(?: as published by the free software foundation)?[;,]?(?: either)?(?:,? \(?(?:the )?(?:\w+ )?\)?)?,? ?(?:version |v\.? ?|ver\. ?)?{number}(?![\d.]*\d)"
            yield Rule(10, f"{shown}-or-later", keyword, rf"{name}{after}(?:,? or (?:\(at your option\) )?(?:any )?later|\+)", NOTICE)
            yield Rule(20, shown, keyword, name + after, NOTICE)
        yield Rule(40, label, keyword, name, NAME)


def _short_names() -> Iterator[Rule]:
    """Short names with a version, such as "gplv2+" or "MPL 2.0", and machine-readable tags."""
    names = {"gpl": ["1.0", "2.0", "3.0"], "lgpl": ["2.0", "2.1", "3.0"], "agpl": ["1.0", "3.0"], "mpl": ["1.0", "1.1", "2.0"],
             "epl": ["1.0", "2.0"], "cddl": ["1.0", "1.1"], "apache": ["1.0", "1.1", "2.0"], "eupl": ["1.1", "1.2"]}
    for label, versions in names.items():
        for v in versions:
            number = rf"{re.escape(v.removesuffix('.0'))}(?:\.0)?" if v.endswith(".0") else re.escape(v)
            yield Rule(15, f"{label}-{v}-or-later", label, rf"\b{label}[ -]?v?{number}(?:\+| or later|-or-later)", NAME)
            yield Rule(30, f"{label}-{v}", label, rf"\b{label}[ -]?v?{number}(?![\d.]*\d)", NAME)
            yield Rule(5, f"{label}-{v}", "spdx-license-identifier", rf"spdx-license-identifier: ?{label}-{re.escape(v)}(?:-only)?(?![\w.-])", TAG)
            yield Rule(4, f"{label}-{v}-or-later", "spdx-license-identifier", rf"spdx-license-identifier: ?{label}-{re.escape(v)}(?:-or-later|\+)", TAG)
    for tag in ["mit", "isc", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd", "zlib", "unlicense", "wtfpl", "cc0-1.0", "bsl-1.0", "ofl-1.1", "x11"]:
        yield Rule(5, tag, "spdx-license-identifier", rf"spdx-license-identifier: ?{re.escape(tag)}(?![\w.-])", TAG)
    yield Rule(9, "spdx-other", "spdx-license-identifier", r"spdx-license-identifier: ?[\w.+-]+", TAG)


def _creative_commons() -> Iterator[Rule]:
    """All license elements with all versions, by short name, by words and by link."""
    words = {"by": "attribution", "sa": "share ?-?alike", "nc": "non-?commercial", "nd": "no-?deriv(?:ative)?s?(?: works)?"}
    for parts in (["by", "nc", "sa"], ["by", "nc", "nd"], ["by", "sa"], ["by", "nc"], ["by", "nd"], ["by"]):
        short = "[ -]".join(parts)
        long = "[ -]+".join(words[p] for p in parts)
        label = "cc-" + "-".join(parts)
        rank = 20 - 2 * len(parts)
        for v in ["1.0", "2.0", "2.5", "3.0", "4.0"]:
            number = re.escape(v)
            yield Rule(rank, f"{label}-{v}", "cc", rf"\bcc[ -]{short}[ -]?(?:v|version )?{number}", NOTICE)
            yield Rule(rank, f"{label}-{v}", "creative commons", rf"creative commons[ :,-]+{long},? ?(?:license )?(?:v|version )?{number}", NOTICE)
            yield Rule(rank, f"{label}-{v}", "creativecommons.org", rf"creativecommons\.org/licenses/{'-'.join(parts)}/{number}", TAG)
        yield Rule(rank + 20, label, "cc", rf"\bcc[ -]{short}\b", NAME)
        yield Rule(rank + 20, label, "creative commons", rf"creative commons[ :,-]+{long}", NAME)
    yield Rule(20, "cc0-1.0", "cc0", r"\bcc0(?:[ -]1\.0)?\b", NOTICE)
    yield Rule(20, "cc0-1.0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0", TAG)
    yield Rule(50, "creative-commons", "creative commons", r"creative commons", HINT)


def _notices() -> Iterator[Rule]:
    """Sentences by which single licenses and reservations are known."""
    signatures = [
        (20, "mit", "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy", NOTICE),
        (20, "mit", "mit license", r"(?:the |an? )?\bmit license\b", NOTICE),
        (25, "mit", "under mit", r"\bunder mit\b", NAME),
        (20, "x11", "x11 license", r"\bx11 license\b", NOTICE),
        (20, "isc", "isc license", r"\bisc license\b", NOTICE),
        (20, "isc", "permission to use, copy, modify, and", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", NOTICE),
        (15, "bsd-4-clause", "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software", NOTICE),
        (18, "bsd-3-clause", "neither the name of", r"neither the name of .{1,80}? nor the names of (?:its|their) contributors", NOTICE),
        (20, "bsd-2-clause", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms", NOTICE),
        (19, "bsd-3-clause", "bsd", r"(?:\b3|three|new|modified|revised)[ -]clause bsd|bsd[ -]3[ -]clause|\b(?:new|modified|revised) bsd\b", NOTICE),
        (19, "bsd-2-clause", "bsd", r"(?:\b2|two)[ -]clause bsd|bsd[ -]2[ -]clause|\b(?:simplified|free)[ -]?bsd license", NOTICE),
        (19, "0bsd", "bsd", r"zero[ -]clause bsd|\b0bsd\b", NOTICE),
        (40, "bsd", "bsd", r"\bbsd(?:[ -]style)? license", NAME),
        (20, "zlib", "zlib license", r"\bzlib license\b", NOTICE),
        (20, "zlib", "this software is provided 'as-is'", r"this software is provided 'as-is', without any express or implied warranty", NOTICE),
        (20, "unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain", NOTICE),
        (20, "unlicense", "unlicense", r"\b(?:the )?unlicense\b", NAME),
        (20, "wtfpl", "do what the fuck you want", r"do what the fuck you want to public license", NOTICE),
        (20, "beerware", "beer-ware", r"beer-ware license", NOTICE),
        (20, "jquery-mit", "jquery.org/license", r"jquery\.org/license", TAG),
        (20, "json", "used for good, not evil", r"shall be used for good, not evil", NOTICE),
        (20, "apache-2.0", "apache.org/licenses", r"apache\.org/licenses/license-2\.0", TAG),
        (20, "gpl", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?gpl", TAG),
        (20, "lgpl", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?lgpl", TAG),
        (20, "agpl", "gnu.org/licenses", r"gnu\.org/licenses/agpl", TAG),
        (20, "mit", "opensource.org/licenses", r"opensource\.org/licenses/mit", TAG),
        (20, "bsd", "opensource.org/licenses", r"opensource\.org/licenses/bsd", TAG),
        (20, "mpl-2.0", "mozilla.org/mpl", r"mozilla\.org/mpl/2\.0", TAG),
        (30, "public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to|under) the public domain", NAME),
        (60, "public-domain", "public domain", r"public domain", HINT),
        (30, "proprietary", "proprietary and confidential", r"proprietary and confidential", NAME),
        (30, "proprietary", "confidential and proprietary", r"confidential and proprietary", NAME),
        (30, "proprietary", "copying of this", r"unauthori[sz]ed copying of this (?:file|document|work)", NAME),
        (30, "no-redistribution", "may not be reproduced", r"may not be reproduced,? (?:or )?(?:distributed|transmitted|stored)", NAME),
        (30, "no-redistribution", "no part of this", r"no part of this (?:publication|book|work|document) may be", NAME),
        (35, "eula", "end user license agreement", r"end[ -]user license agreement", NAME),
        (40, "rights-reserved", "rights reserved", r"(?:all|some|no) rights reserved", NAME),
        (55, "copyright", "copyright", r"copyright(?: \(c\)| ©)? (?:19|20)\d\d(?: ?[-–,] ?(?:(?:19|20)\d\d|present))?", HINT),
        (56, "copyright", "©", r"© ?(?:19|20)\d\d", HINT),
        (57, "copyright", "(c)", r"\(c\) (?:19|20)\d\d", HINT),
    ]
    for signature in signatures:
        yield Rule(*signature)


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    return [*_versioned(), *_short_names(), *_creative_commons(), *_notices()]


def flexible(pattern: str) -> str:
    """A space of a rule stands for any white space, one with a question mark for none, too."""
    return pattern.replace("[ ", r"[\s").replace(" ?", r"\s*").replace(" ", r"\s+")


class Scanner:
    def __init__(self) -> None:
        self.rules = [(r, re.compile(flexible(r.pattern), re.DOTALL)) for r in rules()]
        by_keyword: dict[str, list[int]] = {}
        for k, (rule, _) in enumerate(self.rules):
            by_keyword.setdefault(rule.keyword, []).append(k)
        # A keyword of several words is looked for by its longest word, as line ends may part the words.
        longest: dict[str, list[int]] = {}
        for keyword, numbers in by_keyword.items():
            longest.setdefault(max(keyword.split(" "), key=len), []).extend(numbers)
        self.automaton = ahocorasick.Automaton()
        for keyword, numbers in longest.items():
            self.automaton.add_word(keyword, tuple(numbers))
        self.automaton.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        """Accepted detections (start, stop, rule) in order of their start."""
        lowered = text.lower()
        gated: set[tuple[int, ...]] = {numbers for _, numbers in self.automaton.iter(lowered)}
        if not gated:
            return []
        found = []
        for k in sorted({k for numbers in gated for k in numbers}):
            rule, pattern = self.rules[k]
            found += [(m.start(), m.end(), rule) for m in pattern.finditer(lowered)]
        found.sort(key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].label))
        return accepted(found)


def accepted(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Of detections in order of preference, those that lie inside no accepted one, by start.

    Accepted spans never contain each other's later ones, so sorted starts and the largest
    stop before each start decide containment: a small list is searched backwards.
    """


    kept: list[tuple[int, int]] = []
    widest = 0
    out = []
    for start, stop, rule in found:
        k = bisect_right(kept, (start, 1 << 62))
        inside = False
        while k and kept[k - 1][0] + widest >= stop:
            if kept[k - 1][1] >= stop:
                inside = True
                break
            k -= 1
        if not inside:
            insort(kept, (start, stop))
            widest = max(widest, stop - start)
            out.append((start, stop, rule))
    return sorted(out, key=lambda d: d[:2])


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner()


def phrase_places(texts: pa.Array, phrases: dict[tuple[str, ...], str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, str]]]:
    """Words per text, and for each phrase (text numbers, word numbers, label) of its places."""
    raw, offsets = text_buffer(texts)
    raw = ASCII_LOWER[raw]
    starts, stops = runs(_WORD[raw], offsets)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    sizes = np.bincount(owner, minlength=len(offsets) - 1)
    first = np.cumsum(sizes) - sizes
    hashes = Substrings(raw).hash(starts, stops)
    out = []
    for phrase, label in phrases.items():
        at = np.flatnonzero(hashes == _word_hash(phrase[0]))
        at = at[at + len(phrase) <= len(hashes)]
        for k, word in enumerate(phrase[1:], start=1):
            at = at[(hashes[at + k] == _word_hash(word)) & (owner[at + k] == owner[at])]
        out.append((owner[at], at - first[owner[at]], label))
    return sizes, out


@lru_cache(maxsize=None)
def _word_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return Substrings(raw).hash(np.array([0]), np.array([len(raw)]))[0]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  phrases: dict[tuple[str, ...], str] = BASE_PHRASES) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``,
    ``score`` and ``spans``, the accepted detections (character offsets into the lower-cased text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for batch in batches:
            for part in text_slices(batch):
                text = pc.fill_null(part.column("text"), "")
                n = part.num_rows
                n_words, found = phrase_places(text, phrases)
                n_base = np.zeros(n, np.int64)
                low, high = np.full(n, 1 << 62), np.full(n, -1)
                base: list[set[str]] = [set() for _ in range(n)]
                for owner, place, label in found:
                    n_base += np.bincount(owner, minlength=n)
                    np.minimum.at(low, owner, place)
                    np.maximum.at(high, owner, place)
                    for k in set(owner.tolist()):
                        base[k].add(label)
                spans = [scanner.detections(t) for t in text.to_pylist()]
                labels = [sorted(b | {r.label for _, _, r in s}) for b, s in zip(base, spans, strict=True)]
                score = [1.0 - float(np.prod([1 - r.score for _, _, r in s] + [0.1] * bool(b))) for b, s in zip(base, spans, strict=True)]
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(n_words), pa.array(n_base), pa.array(low, pa.int64(), mask=none), pa.array(high, pa.int64(), mask=none),
                        pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array([",".join(x) for x in labels], pa.string()), pa.array(score),
                        pa.array([[{"start": a, "stop": b, "label": r.label, "priority": r.priority} for a, b, r in s] for s in spans], _SPANS),
                    ],
                    [id_column, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    ddl = (
        f"`{id_column}` {ddl_of(docs, id_column)}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<start: bigint, stop: bigint, label: string, priority: int>>"
    )
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, ddl)
