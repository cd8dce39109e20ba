"""Token ids of many texts with a `tokenizers` file, by a bounded cache of words.

A vocabulary that lower-cases, drops white space and never joins characters across it gives a text the ids of its
words, one after another; each worker encodes a word once while it is in the cache. Words of a chunk are told apart by
numpy, by keyed hashes and then byte by byte, so Python sees each distinct word of a chunk once. Whether a file is of
this kind is tried on `PROBES` when it is read; texts of any other file, and texts that hold "<|" and may name special
tokens, go to the tokenizer whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np

from skarn.llm import wordhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER, _LATIN, _MARK = (np.isin(np.arange(256), x) for x in (range(97, 123), [x for x in range(0xA0, 0xC0) if x != 0xB7], list(b".,;:!?|#%&$*")))
_LETTERS, _AT_ONCE = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"), 500
PROBES = ("Hello World", " a  B\tc\nd ", "one, two.three! (four) 5|6#7", "Ünï\u00e9 ÀB\u00c7.x", "it's don't'll", "x\u00a0y \u2003z", "日本語 テスト.a", "a,b;c:d!e?f|g#h%i&j$k*l", "AbC123def 4.5e6", "é.é,é")


@lru_cache(maxsize=4)
def word_tokens(path: str, most_words: int = 500_000) -> WordTokens:
    """One cache per worker process and file."""
    return WordTokens(path, most_words)


class WordTokens:
    def __init__(self, path: str, most_words: int = 500_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_words = most_words
        self.key = wordhash.new_key()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.by_word = True
        self._clear()
        for text in PROBES:
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            if self.encode(raw, np.array([0, len(raw)]))[0].tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
                self.by_word = False
                break

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.off = np.zeros(1 << 14, dtype=np.int64)
        self.len = np.zeros(1 << 14, dtype=np.int64)
        self.hits = np.zeros(1 << 14, dtype=np.int64)

    def _shrink(self) -> None:
        """Keep the half of the cache that was used most, and halve its counts."""
        place, flat, off, size, hits = self.place, self.flat, self.off, self.len, self.hits
        least = np.partition(hits[: len(place)], len(place) // 2)[len(place) // 2]
        self._clear()
        for word, i in place.items():
            if hits[i] > least:
                at = self._put(word, flat[off[i] : off[i] + size[i]])
                self.hits[at] = hits[i] // 2

    def _put(self, word: bytes, ids) -> int:
        at, n = len(self.place), len(ids)
        if at >= len(self.off):
            self.off, self.len, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len, self.hits))
        if self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + n, dtype=np.uint32)])
        self.flat[self.used : self.used + n] = ids
        self.off[at], self.len[at] = self.used, n
        self.used += n
        self.place[word] = at
        return at

    def _encode(self, words: list[bytes]) -> None:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        # Words of letters alone are one token run each, which ends with a token that says so: many go in one call.
        plain = [w for w in words if _LETTERS.fullmatch(w)]
        runs = [got.ids for got in encode([b" ".join(plain[i : i + _AT_ONCE]).decode() for i in range(0, len(plain), _AT_ONCE)], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(runs), dtype=np.int64)
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) == len(plain) and (not len(flat) or ends[-1] == len(flat)):
            words = plain + [w for w in words if not _LETTERS.fullmatch(w)]
        else:
            plain, flat, ends = [], flat[:0], ends[:0]
        rest = [got.ids for got in encode([w.decode() for w in words[len(plain) :]], add_special_tokens=False)]
        size = np.concatenate([np.diff(ends, prepend=0), np.array([len(x) for x in rest], dtype=np.int64)]).astype(np.int64)
        at, n = len(self.place), int(size.sum())
        while at + len(words) > len(self.off):
            self.off, self.len, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len, self.hits))
        if self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + n, dtype=np.uint32)])
        self.flat[self.used : self.used + n] = np.concatenate([flat, np.fromiter(chain.from_iterable(rest), dtype=np.int64)])
        self.off[at : at + len(words)], self.len[at : at + len(words)] = self.used + np.cumsum(size) - size, size
        self.used += n
        self.place.update(zip(words, range(at, at + len(words)), strict=True))

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of each text data[bounds[i]:bounds[i + 1]], equal to tokenizer.encode(text, add_special_tokens=False).ids."""
        if not self.by_word:
            texts = [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            return [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.place) > self.most_words:
            self._shrink()
        raw = data.tobytes()
        texts = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        whole = [i for i, (a, b) in enumerate(texts) if b"<|" in raw[a:b]] if b"<|" in raw else []
        # A run of marks behind a letter is a token run of its own: a space before it changes nothing, and stems are shared.
        low = _LOWER[data]
        for i in whole:
            low[bounds[i] : bounds[i + 1]] = 32
        letter = _LETTER[low]
        letter[1:] |= (low[:-1] == 0xC3) & _LATIN[low[1:]]
        cut = np.flatnonzero(_MARK[low[1:]] & letter[:-1]) + 1
        at = bounds + np.searchsorted(cut, bounds)
        words = wordhash.split(np.insert(low, cut, 32), at, lower=False, key=self.key)
        counts = np.diff(words.first)
        _, first, inverse, uses = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
        if not wordhash.same(words, first[inverse]):  # two words share a hash: each is its own then
            first = inverse = np.arange(len(words.hash))
            uses = np.ones(len(first), dtype=np.int64)
        raw = words.data.tobytes()
        kinds = [raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
        found = np.fromiter(map(self.place.get, kinds, repeat(-1)), dtype=np.int64, count=len(kinds))
        if len(missing := np.flatnonzero(found < 0)):
            missing = missing.tolist()
            self._encode(list({kinds[i] for i in missing}))
            found[missing] = [self.place[kinds[i]] for i in missing]
        np.add.at(self.hits, found, uses)
        found = found[inverse]
        lens = self.len[found]
        ends = np.cumsum(lens)
        flat = self.flat[np.repeat(self.off[found] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        out = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(data[bounds[i] : bounds[i + 1]].tobytes().decode(), add_special_tokens=False).ids, dtype=np.uint32)
        return out
