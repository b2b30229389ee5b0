"""Word-level byte-pair encoding by speculation and verification.

A vocabulary file of the `tokenizers` library with a word-end suffix is read as it is.
Words are proposed by greedy longest match. A proposal is right exactly if every adjacent
pair of its tokens is what merging the pair's own text gives, so all pairs of a batch of
new words are tested at once; only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

END = "\ue000"  # stands for the word-end suffix inside this module
CACHE_WORDS = 160_000  # words of a generation; two are kept, so words in use outlive the change
SHORT_WORD = 24
# Up to this code point normalisation is plain lower-casing and the character classes are spelled out.
LATIN = 0x250
SPACES = "\t-\r \x85\xa0"


def _byte_letters() -> list[str]:
    """Printable stand-ins of the 256 bytes: visible Latin-1 characters stand for themselves, the rest follow from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    return [hidden.get(b, chr(b)) for b in range(256)]


def _latin_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind)


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        suffix = spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.library = Tokenizer.from_file(path)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for text, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = text
        self.inner = {t.removesuffix(suffix) + END if t.endswith(suffix) else t: i for t, i in vocab.items()}
        self.texts = {i: t for t, i in self.inner.items()}
        self.longest = max(map(len, self.inner))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        letters = _byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        ascii_map = {b: letters[b] for b in range(128)}
        self.ascii_letters = ascii_map
        letter, digit = _latin_class("L"), _latin_class("N")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{SPACES}{letter}{digit}]+")
        # Some letters below LATIN have lower-case forms from it on.
        plain = "".join(re.escape(chr(c)) for c in range(LATIN) if max(chr(c).lower()) < chr(LATIN))
        self.beyond = re.compile(f"[^{plain}]")
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pairs: dict[int, bool] = {}
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # -- text to words ---------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens; words the library had to split are marked by a leading END."""
        if not text.isascii() and self.beyond.search(text):
            normal = self.library.normalizer.normalize_str(text)
            return [END + word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return self.words.findall(text.lower())

    def split(self, text: str) -> list[str | int]:
        """Words and, where special strings stand in the text, their ids."""
        if self.special is None or "<|" not in text:
            return self.pieces(text)
        out: list[str | int] = []
        at = 0
        for m in self.special.finditer(text):
            out += self.pieces(text[at : m.start()])
            out.append(self.specials[m.group()])
            at = m.end()
        return out + self.pieces(text[at:])

    # -- words to ids ----------------------------------------------------------------------

    def symbols(self, word: str) -> str:
        """The word in byte letters, with END behind it."""
        if word[0] == END:
            return word[1:] + END
        if word.isascii():
            return word.translate(self.ascii_letters) + END
        return "".join([self.letters[b] for b in word.encode()]) + END

    def propose(self, text: str) -> list[int]:
        """Greedy longest match; the END mark never stands alone."""
        ids, at, size, inner = [], 0, len(text), self.inner
        while at < size:
            stop = min(size, at + self.longest)
            while True:
                if stop != size - 1 or stop == at + 1 == size:
                    token = inner.get(text[at:stop])
                    if token is not None:
                        break
                stop -= 1
            ids.append(token)
            at = stop
        return ids

    def base(self, text: str) -> list[int]:
        """Smallest units of a text in byte letters; END belongs to the letter before it."""
        inner = self.inner
        if text.endswith(END):
            return [*[inner[c] for c in text[:-2]], inner[text[-2:]]]
        return [inner[c] for c in text]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost of equals."""
        get = self.merges.get
        if len(ids) <= SHORT_WORD:
            while len(ids) > 1:
                best, at = None, -1
                for i in range(len(ids) - 1):
                    m = get((ids[i], ids[i + 1]))
                    if m is not None and (best is None or m[0] < best[0]):
                        best, at = m, i
                if best is None:
                    break
                ids[at : at + 2] = [best[1]]
            return ids
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if m := get((new, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[after[j]]))
            if (k := before[i]) >= 0 and (m := get((ids[k], new))):
                heapq.heappush(heap, (m[0], k, m[1], ids[k], new))
        return [t for t in ids if t >= 0]

    def fits(self, code: int) -> bool:
        """Whether merging the text of two neighbours gives the two again."""
        left, right = code >> 32, code & 0xFFFFFFFF
        return self.merge(self.base(self.texts[left] + self.texts[right])) == [left, right]

    def learn(self, new: list[str]) -> None:
        """Encodes new words: proposals, one test over all neighbours, exact merges for the rest."""
        texts = [self.symbols(w) for w in new]
        proposals = [self.propose(t) for t in texts]
        sizes = np.array([len(p) for p in proposals])
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False  # no pair begins at a word's last token
        at = np.flatnonzero(inside)
        failed = np.zeros(len(new), bool)
        if len(at):
            codes, back = np.unique((flat[at] << 32) | flat[at + 1], return_inverse=True)
            known = self.pairs
            good = np.empty(len(codes), bool)
            for k, code in enumerate(codes.tolist()):
                ok = known.get(code)
                if ok is None:
                    ok = known[code] = self.fits(code)
                good[k] = ok
            failed[np.searchsorted(ends, at[~good[back]], side="right")] = True
        # A word of one token is right if the token comes out of merging its own text.
        for k in np.flatnonzero(sizes == 1):
            token = proposals[k][0]
            ok = self.pairs.get(-1 - token)
            if ok is None:
                ok = self.pairs[-1 - token] = self.merge(self.base(texts[k])) == [token]
            failed[k] = not ok
        ids = self.ids
        packed = flat.astype("<u4").tobytes()
        starts = ((ends - sizes) * 4).tolist()
        for word, start, stop in zip(new, starts, (ends * 4).tolist(), strict=True):
            ids[word] = packed[start:stop]
        for k in np.flatnonzero(failed):
            ids[new[k]] = np.array(self.merge(self.base(texts[k])), "<u4").tobytes()

    def encode_words(self, documents: list[list[str | int]]) -> list[bytes]:
        """Little-endian 32-bit ids of each document's words and special ids."""
        if len(self.ids) > CACHE_WORDS:
            self.ids, self.older = {}, self.ids
        if len(self.pairs) > 2 * CACHE_WORDS:
            self.pairs.clear()
        new = {w for words in documents for w in set(words) if w not in self.ids}
        known = new & self.older.keys()
        self.ids.update((w, self.older[w]) for w in known)
        new -= known
        for token in [w for w in new if isinstance(w, int)]:
            new.discard(token)
            self.ids[token] = np.array([token], "<u4").tobytes()
        if new:
            self.learn(list(new))
        get = self.ids.__getitem__
        return [b"".join(map(get, words)) for words in documents]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_words([self.split(t) if t else [] for t in texts])

    def decode(self, ids: bytes) -> str:
        """Token strings joined by a space: what a vocabulary without a decoder gives."""
        get = self.tokens.__getitem__
        return " ".join(map(get, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One encoder with its caches per worker process."""
    return WordBpe(path)
