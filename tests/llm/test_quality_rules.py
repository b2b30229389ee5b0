from __future__ import annotations

import re
from collections import Counter

from emberwatch.llm.quality_rules import features, quality_rules
from tests.llm.conftest import rows_of

SPACE = r"\x20\x09-\x0D"


def base(text):
    text = text or ""
    w = re.findall(f"[^{SPACE}]+", text)
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(w) < 10 or 100 * len(covered) > 20 * len(w),
    )


def test_counts(make_docs, words):
    line = " ".join(words(12, 3))
    texts = [None, "", " \n", "a b c", line, f"{line}\n{line}\nother\n\n", " ".join(words(500, 1)), "x " * 50, "a b c d e a b c d e f", "# * $ % & | < > é ü",
             "a b c d e a b c d a b c d e", "  lead\t tail \x0b\x0c\r ", "🙂 🙂 " * 9, " ".join(words(30, 8) * 2), "w" * 20000, " ".join(words(20000, 9))]
    rows = [*enumerate(texts), (3, "a b c"), (None, line)]
    got = features(make_docs(rows)).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(got) == sorted(((i, *base(t)) for i, t in rows), key=str)


def test_thresholds_follow_the_group(make_docs, words):
    clean = [(k, " ".join(words(60, k)), "en", "prose") for k in range(120)]
    marked = [(1000 + k, " ".join(w + "#" * (k % 5) for w in words(60, k)), "en", "markup") for k in range(120)]
    odd = [(5000, " ".join(w + "###" for w in words(60, 1)), "en", "prose"), (5001, " ".join(words(60, 2)), None, None), (5002, None, "en", "prose")]
    out = {r.doc_id: r for r in quality_rules(make_docs(clean + marked + odd), min_documents=50).collect()}
    assert all(out[k].kept for k in range(120))
    assert all(out[1000 + k].kept for k in range(120))  # usual in this source
    assert not out[5000].kept and not out[5000].base_failed  # unusual in that one
    assert out[5001].kept and not out[5002].kept and out[5002].base_failed
    assert quality_rules(make_docs(odd).where("doc_id = 1")).count() == 0
