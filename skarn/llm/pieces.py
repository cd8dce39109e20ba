"""SentencePiece encoding and decoding by a Viterbi search in batched numpy.

Words of equal length advance together, as rows of one matrix: hashes of all their substrings probe the sorted keys of
the pieces, each place takes the best step that ends there by vectorised maxima, and backpointers give the ids. For a
unigram model the best step has the highest sum of scores; for a BPE model, whose result is defined by merge order, it
is the one whose piece joins on the piece before it (see `Viterbi`), and the ids are the library's. Words of more than
`LONGEST` characters are searched one by one.

The model must leave text as it is but for white space marks (identity normalisation, a dummy prefix, no
removal of extra spaces), no piece may hold a mark behind another character, so that words can be encoded
apart, and no piece of a BPE model may be merged before its parts; all three are checked when the model is read.

Defined cases: null text counts as empty, and an empty text has no ids; a character without a piece falls back
to its bytes; the mark U+2581 in a text is read as a space, as the library does; repeated rows are encoded each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import wordhash
from skarn.llm.scratch import small_batches
from skarn.sources.shipping import ship

MARK, LONGEST, MOST_WORDS, CELLS, CHUNK = "▁", 256, 350_000, 1 << 17, 4 << 20
_UNKNOWN = 1 << 21
_SHIFT = 1 << 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rows(words: list[str], n: int) -> np.ndarray:
    """Words of n characters as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(-1, n).astype(np.int64)


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    lens = np.array([len(w) for w in words])
    order = np.argsort(lens, kind="stable")
    cuts = np.flatnonzero(np.diff(lens[order])) + 1
    for group in np.split(order, cuts) if len(order) else ():
        n = int(lens[group[0]])
        most = max(CELLS // max(n, 1), 1)  # rows of a matrix, so that its size is bounded whatever the length
        for i in range(0, len(group), most):
            yield n, group[i : i + most].tolist()


class Viterbi:
    """The best segmentation of batches of words, by a search over the places where pieces can end.

    Under a unigram model a step's value is its piece's score. A BPE model has no such sum: its result is defined by the
    order of merges. But a sequence of pieces is that result exactly if each two neighbours are (`joins`), and each
    beginning of a word has one such sequence; so a step is allowed where its piece joins on the one before it, and the
    same search finds the merges' result without merging.
    """

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], bpe: bool = False, unknown_score: float | None = None):
        self.longest = max((len(p) for p in pieces), default=1)
        self.powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.longest + 1, _BASE)]))
        self.unknown = min(scores.values(), default=0.0) - 10 if unknown_score is None else unknown_score
        self.bpe = bpe
        chars = sorted({c for p in pieces for c in p})
        self.symbol = dict(pieces)
        if bpe:  # characters that are no pieces, but parts of some, are symbols besides
            self.symbol |= {c: len(pieces) + _UNKNOWN // 2 + i for i, c in enumerate(chars) if c not in pieces}
        keyed = dict(zip(self._hashes(list(self.symbol)).tolist(), self.symbol, strict=True))
        if len(keyed) != len(self.symbol):
            raise ValueError("two pieces share a hash")
        self.keys = np.array(sorted(keyed), dtype=np.uint64)
        self.ids = np.array([self.symbol[keyed[k]] for k in self.keys.tolist()], dtype=np.int64)
        self.scores = np.array([scores.get(keyed[k], 0.0) for k in self.keys.tolist()])
        if bpe:
            self._derive(pieces, scores)
            self.bpe_cache: dict[tuple[int, int], bool] = {}

    # --- which pieces may stand side by side ---

    def _derive(self, pieces: dict[str, int], scores: dict[str, float]) -> None:
        """Ranks of pairs, and each piece's own last merge; pieces that merges never make are left out of the search."""
        order = {p: r for r, p in enumerate(sorted((p for p in pieces if len(p) > 1), key=lambda p: -scores[p]))}
        table = {self.symbol[p[:i]] * _SHIFT + self.symbol[p[i:]]: r for p, r in order.items() for i in range(1, len(p)) if p[:i] in self.symbol and p[i:] in self.symbol}
        self.pairs = np.array(sorted(table), dtype=np.int64)
        self.none = np.int64(len(order))
        self.pair_rank = np.array([*(table[k] for k in self.pairs.tolist()), len(order)], dtype=np.int64)
        size = max(self.symbol.values()) + 1
        self.rank, self.left, self.right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        made = np.zeros(size, dtype=bool)
        made[[self.symbol[p] for p in self.symbol if len(p) == 1]] = True
        by_length: dict[int, list[str]] = {}
        for p in order:
            by_length.setdefault(len(p), []).append(p)
        for n in sorted(by_length):
            splits = [(self.symbol[p], self.symbol[p[:i]], self.symbol[p[i:]], order[p]) for p in by_length[n] for i in range(1, n) if p[:i] in self.symbol and p[i:] in self.symbol]
            if not splits:
                continue
            whole, x, y, r = np.array(splits, dtype=np.int64).T
            ok = np.flatnonzero(made[x] & made[y])
            ok = ok[self.joins(x[ok], y[ok], r[ok])]
            if len(np.unique(whole[ok])) != len(ok):
                raise ValueError("a piece has two derivations")
            if (self.rank[x[ok]] >= r[ok]).any() or (self.rank[y[ok]] >= r[ok]).any():
                raise ValueError("a piece is merged before its parts")
            made[whole[ok]], self.rank[whole[ok]], self.left[whole[ok]], self.right[whole[ok]] = True, r[ok], x[ok], y[ok]
        usable = made[self.ids]
        self.keys, self.ids, self.scores = self.keys[usable], self.ids[usable], self.scores[usable]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which two neighbours merge."""
        key = a * _SHIFT + b
        at = np.searchsorted(self.pairs, key)
        hit = at < len(self.pairs)
        hit[hit] = self.pairs[at[hit]] == key[hit]
        return np.where(hit, self.pair_rank[np.where(hit, at, -1)], self.none)

    def joins(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves pieces a and b side by side: no merge across their border comes before one of theirs.

        Merges are undone from the last: the parts at the border at each moment may not merge earlier than the
        merge that is undone next (of equal merges the left one comes first).
        """
        ok = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        limit = np.full(len(a), self.none) if limit is None else limit
        rank = lambda s: np.where(s < len(self.rank), self.rank[np.minimum(s, len(self.rank) - 1)], -1)
        while len(at):
            bad = self._pair(a, b) < limit
            ok[at[bad]] = False
            ra, rb = rank(a), rank(b)
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            of_a = ra > rb
            limit = np.where(of_a, ra, rb + 1)
            a, b = np.where(of_a, self.right[np.where(of_a, a, 0)], a), np.where(of_a, b, self.left[np.where(of_a, 0, b)])
        return ok

    # --- the search ---

    def _hashes(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.uint64)
        for n, at in _by_length(words):
            out[at] = self._spans(self._prefix(_rows([words[i] for i in at], n)), n)[:, 0]
        return out

    def _prefix(self, points: np.ndarray) -> np.ndarray:
        run = np.zeros((len(points), points.shape[1] + 1), dtype=np.uint64)
        for i in range(points.shape[1]):
            run[:, i + 1] = run[:, i] * _BASE + wordhash.mix(points[:, i].astype(np.uint64) + np.uint64(1))
        return run

    def _spans(self, run: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all substrings of one width, a column for each start."""
        return wordhash.mix(run[:, width:] - run[:, :-width] * self.powers[width] + np.uint64(width))

    def batch(self, points: np.ndarray) -> np.ndarray:
        """Symbols of equally long words, -1 behind the last; _UNKNOWN + code point where no piece matches."""
        m, n = points.shape
        run, most = self._prefix(points), min(self.longest, n)
        found = []
        for width in range(1, most + 1):  # substrings probe the sorted keys, all of one width at once
            key = self._spans(run, width)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found.append(np.where(self.keys[at] == key, at, -1))
        best, back, how = np.full((m, n + 1), -np.inf), np.zeros((m, n + 1), np.int64), np.full((m, n + 1), -1)
        best[:, 0] = 0
        for end in range(1, n + 1):
            if self.bpe:
                open_rows = np.arange(m)
                for width in range(min(most, end), 0, -1):
                    at = found[width - 1][open_rows, end - width]
                    ids = np.where(at >= 0, self.ids[at], _UNKNOWN + points[open_rows, end - width] if width == 1 else -1)
                    maybe = np.flatnonzero(ids >= 0)
                    if end > width and len(maybe):
                        maybe = maybe[self.joins(how[open_rows[maybe], end - width], ids[maybe])]
                    rows = open_rows[maybe]
                    back[rows, end], how[rows, end] = end - width, ids[maybe]
                    open_rows = np.delete(open_rows, maybe)
                    if not len(open_rows):
                        break
                if len(open_rows):
                    raise ValueError("a word has no sequence of joined pieces")
                continue
            for width in range(1, min(most, end) + 1):
                at = found[width - 1][:, end - width]
                score = np.where(at >= 0, self.scores[at], self.unknown if width == 1 else -np.inf) + best[:, end - width]
                better = score > best[:, end]
                best[better, end], back[better, end] = score[better], end - width
                how[better, end] = np.where(at >= 0, self.ids[at], _UNKNOWN + points[:, end - width])[better]
        # Backpointers, of all rows together.
        out, at, rows, place = np.full((m, n), -1), np.full(m, n), np.arange(m), n
        while len(rows):
            place -= 1
            out[rows, place] = how[rows, at[rows]]
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return out

    def long(self, word: str) -> list[int]:
        """One long word, place by place; time grows with its length."""
        how, back, best = [-1] * (len(word) + 1), [0] * (len(word) + 1), [0.0] + [float("-inf")] * len(word)
        known = dict(zip(self.ids.tolist(), self.scores.tolist(), strict=True))
        for end in range(1, len(word) + 1):
            for width in range(min(self.longest, end), 0, -1):
                s = self.symbol.get(word[end - width : end], -1)
                s = s if s in known else _UNKNOWN + ord(word[end - 1]) if width == 1 else -1
                if s < 0:
                    continue
                if self.bpe:
                    if end == width or self._joins_one(how[end - width], s):
                        how[end], back[end] = s, end - width
                        break
                    continue
                value = best[end - width] + known.get(s, self.unknown)
                if value > best[end]:
                    best[end], how[end], back[end] = value, s, end - width
        out, at = [], len(word)
        while at:
            out.append(how[at])
            at = back[at]
        return out[::-1]

    def _joins_one(self, a: int, b: int) -> bool:
        if (a, b) not in self.bpe_cache:
            if len(self.bpe_cache) > MOST_WORDS:
                self.bpe_cache.clear()
            self.bpe_cache[a, b] = bool(self.joins(np.array([a]), np.array([b]))[0])
        return self.bpe_cache[a, b]

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, one after another, and how many each has."""
        order, counts, flat = [], [], []
        for n, at in _by_length(words):
            if n > LONGEST:
                rows = [np.array(self.long(words[i]), dtype=np.int64) for i in at]
                counts.append(np.array([len(r) for r in rows]))
                flat += rows
            else:
                got = self.batch(_rows([words[i] for i in at], n))
                counts.append((got >= 0).sum(axis=1))
                flat.append(got[got >= 0])
            order += at
        none = np.zeros(0, dtype=np.int64)
        counts, flat = np.concatenate([none, *counts]), np.concatenate([none, *flat])
        return _taken(flat, counts, np.argsort(np.array(order, dtype=np.int64), kind="stable"))


def _taken(flat: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `which` of rows that stand one after another in flat."""
    ends = np.cumsum(counts)
    n = counts[which]
    to = np.cumsum(n)
    return flat[np.repeat(ends[which] - n - (to - n), n) + np.arange(to[-1] if len(to) else 0)], n


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process and model file."""
    return Codec(path)


class Codec:
    """Ids of texts, and texts of ids, for one model file."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        if any(model.decode(model.encode(x)) != x for x in (" a  b ", "½ ﬁ", "\n\tc")):
            raise ValueError("the model normalises text")
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces, scores = {names[i]: i for i in usual}, {names[i]: model.get_score(i) for i in usual}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece crosses a word's end")
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.text = [b"" if model.is_control(i) else bytes([int(names[i][1:-1], 16)]) if model.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        # A BPE model scores pieces by merge order: whole numbers going down by one.
        steps = np.array([scores[names[i]] for i in usual])
        self.kind = "bpe" if np.array_equal(steps, np.round(steps)) and (steps <= 0).all() else "unigram"
        self.engine = Viterbi(pieces, scores, bpe=self.kind == "bpe")
        self.most = n
        # No piece holds the two characters of a border that is not listed here, so words can be cut there.
        inner = {ord(x) << 21 | ord(y) for p in pieces for x, y in zip(p, p[1:], strict=False)}
        self.inner = np.array(sorted(inner), dtype=np.int64)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _ids(self, symbols: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Ids of words as bytes; symbols without a piece become bytes of their character."""
        ends = np.cumsum(counts).tolist()
        raw = symbols.astype("<u4").tobytes()
        out = [raw[4 * (e - c) : 4 * e] for c, e in zip(counts.tolist(), ends, strict=True)]
        spelled = {v: k for k, v in self.engine.symbol.items() if v >= self.most}
        odd = np.unique(np.searchsorted(np.cumsum(counts), np.flatnonzero(symbols >= self.most), "right"))
        for i in odd.tolist():
            ids = []
            for s in symbols[ends[i] - counts[i] : ends[i]].tolist():
                ids += [s] if s < self.most else self.bytes[list((chr(s - _UNKNOWN) if s >= _UNKNOWN else spelled[s]).encode())].tolist()
            out[i] = np.array(ids, dtype="<u4").tobytes()
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Encode words that are not known yet: they are cut at borders that no piece crosses, and each part is searched once."""
        text = "\n".join([w.decode() for w in new]).replace(" ", MARK)
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        key = points[:-1] << 21 | points[1:]
        at = np.searchsorted(self.inner, key)
        inside = at < len(self.inner)
        inside[inside] = self.inner[at[inside]] == key[inside]
        line = points == 10
        cut = np.flatnonzero(~inside & ~line[:-1] & ~line[1:]) + 1
        parts = np.insert(points.astype("<u4"), cut, 10).tobytes().decode("utf-32-le").split("\n")
        word_ends = np.append(np.flatnonzero(line), len(points))
        n = np.diff(np.searchsorted(cut, word_ends), prepend=0) + 1
        if len(self.parts) > MOST_WORDS:
            self.parts.clear()
        unknown = list({p for p in parts if p not in self.parts})
        self.parts.update(zip(unknown, self._ids(*self.engine.segment(unknown)), strict=True))
        found, place = list(map(self.parts.__getitem__, parts)), 0
        for w, c in zip(new, n.tolist(), strict=True):
            self.words[w] = found[place] if c == 1 else b"".join(found[place : place + c])
            place += c

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, as 32-bit unsigned integers."""
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        split = [re.findall(rb" +[^ \n]*|[^ \n]+|\n", b" " + t.replace(MARK.encode(), b" ")) if t else [] for t in texts]
        new = set().union(*split).difference(self.words)
        if b"\n" in new:
            new.discard(b"\n")
            self.words[b"\n"] = self._ids(*self.engine.segment(["\n"]))[0]
        if new:
            self._learn(list(new))
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), dtype="<u4") for x in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids: the dummy prefix goes, bytes stand for themselves."""
        raw = b"".join([self.text[i] for i in ids.tolist()])
        return raw[1:] if raw.startswith(b" ") else raw


def _encoder(path: str):
    """Texts are gathered to about CHUNK bytes, whatever the size of Arrow batches, so equal lengths have company."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def encoded() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([i.tobytes() for i in own.encode(texts)], pa.binary())], names=["doc_id", "ids"])

        for batch in batches:
            data, bounds = wordhash.buffers(batch.column(1))
            for row, to in wordhash.chunks(bounds, CHUNK):
                ids += batch.column(0).slice(row, to - row).to_pylist()
                texts += [data[a:b].tobytes() for a, b in zip(bounds[row:to].tolist(), bounds[row + 1 : to + 1].tolist(), strict=True)]
                size += int(bounds[to] - bounds[row])
                if size >= CHUNK // 2:
                    yield encoded()
                    ids, texts, size = [], [], 0
        if ids:
            yield encoded()

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [np.frombuffer(x or b"", dtype="<u4") for x in batch.column(1).to_pylist()]
            texts = [own.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "text"],
            )

    return run


def encode(spark: SparkSession, docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (32-bit little-endian) of every row. Every executor has the model at this path."""
    ship(spark)
    small_batches(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoder(model), "doc_id long, ids binary")


def decode(spark: SparkSession, encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256 and text of rows of ids."""
    ship(spark)
    small_batches(spark)
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(model), "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded again; the digest is that of the decoded text."""
    return decode(spark, encode(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model()), default_model()).drop("text")
