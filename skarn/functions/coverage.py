"""Tokens counted in Arrow batches of texts: those that a few texts and many share, and those of all; no row of a token leaves its task."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa

# Most tokens of the few texts, which every task holds; and most cells, matches, tokens or terms that a task counts at a time.
MOST_TOKENS, CELLS = 1 << 18, 1 << 20
_KEPT = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def _tokens(text: str | None) -> list[str]:
    """As functions.text.tokens."""
    return (text or "").lower().encode().translate(_KEPT).decode("ascii").split()


class Index:
    """The few texts: which of them have a token for the k-th time, for each token and k."""

    def __init__(self, counts: pa.Table, keys: list[str]):
        rows = counts.select(keys).to_pandas()
        item = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(item, return_index=True)[1]
        self.keys = counts.select(keys).take(pa.array(first)).combine_chunks()
        words = counts.column("w").combine_chunks().dictionary_encode()
        word, n = words.indices.to_numpy().astype("int64"), counts.column("n").to_numpy().astype("int64")
        self.most = np.zeros(len(words.dictionary), "int64")  # of a token in one text; more of it never counts
        np.maximum.at(self.most, word, n)
        self.start = np.concatenate([[0], np.cumsum(self.most)])
        self.number = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
        place = np.repeat(self.start[word], n) + _within(n)
        order = np.argsort(place, kind="stable")
        self.items = np.repeat(item, n)[order]
        self.upto = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=self.start[-1]))])
        self.totals = np.bincount(item, weights=n, minlength=len(first)).astype("int64")


def _within(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each of n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _shared(index: Index, ids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, item and the number of tokens that both have, of pairs that have one; `ids` are tokens by number."""
    if not any(ids):
        return
    lengths = np.array([len(x) for x in ids], "int64")
    token = np.concatenate([np.array(x, "int64") for x in ids])
    key, n = np.unique(np.repeat(np.arange(len(ids)), lengths) * len(index.most) + token, return_counts=True)
    text, token = np.divmod(key, len(index.most))
    n = np.minimum(n, index.most[token])
    text, place = np.repeat(text, n), np.repeat(index.start[token], n) + _within(n)
    uses = index.upto[place + 1] - index.upto[place]
    width = len(index.totals)
    spent = np.cumsum(np.bincount(text, weights=uses, minlength=len(ids)) + width)
    part = (spent // CELLS).astype("int64")
    ends = np.flatnonzero(np.diff(part, append=part[-1] + 1)) + 1
    low = 0
    for high in ends:
        a, b = np.searchsorted(text, [low, high])
        own = uses[a:b]
        item = index.items[np.repeat(index.upto[place[a:b]], own) + _within(own)]
        cells = np.bincount(np.repeat(text[a:b] - low, own) * width + item, minlength=1)
        at = np.flatnonzero(cells)
        yield low + at // width, at % width, cells[at]
        low = high


def covered(index: Index, keep: list[str], names: list[str], least: float, once: bool, of_few: bool, least_total: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows with `text`: `keep`, the index's keys, covered, total of pairs that share `least` of total.

    total counts the tokens of the index's text if `of_few`, else of the row's. With `once`, a token counts once a text.
    """

    def pairs(batch: pa.RecordBatch, first: int, sizes: list[int], ids: list[list[int]]) -> Iterator[pa.RecordBatch]:
        for text, item, n in _shared(index, ids):
            total = index.totals[item] if of_few else np.array(sizes, "int64")[text]
            good = (n / total >= least) & (total >= least_total)
            if good.any():
                own, other = batch.select(keep).take(pa.array(first + text[good])), index.keys.take(pa.array(item[good]))
                columns = [own.column(c) for c in keep] + [_one(other.column(c)) for c in range(other.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n[good]), pa.array(total[good])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = index.number.get, set(index.number)

        def own(words: list[str] | set[str]) -> list[int]:
            """Known tokens of a row whose own tokens are the total; none where they are too few for any text of the index."""
            if not words or len(words) < least_total:
                return []
            shared = words & known if once else [w for w in words if w in known]
            return list(map(number, shared)) if len(shared) / len(words) >= least else []

        for batch in batches:
            first, held, sizes, ids = 0, 0, [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                words = _tokens(text.as_py())
                words = set(words) if once else words
                sizes.append(len(words))
                ids.append([x for x in map(number, words) if x is not None] if of_few else own(words))
                held += len(ids[-1])
                if held >= CELLS:
                    yield from pairs(batch, first, sizes, ids)
                    first, held, sizes, ids = first + len(ids), 0, [], []
            if ids:
                yield from pairs(batch, first, sizes, ids)

    return run


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def term_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (owned, text): term, df, cf, one row or a few for each term of a task; only owned rows count in df."""
    number: defaultdict[str, int] = defaultdict(count().__next__)
    seen, uses, unowned = [], [], []
    df, cf = np.zeros(0, "int64"), np.zeros(0, "int64")

    def fold() -> None:
        nonlocal df, cf
        size, at = len(number), np.array(seen, "int64")
        df = np.pad(df, (0, size - len(df))) + np.bincount(at, minlength=size) - np.bincount(np.array(unowned, "int64"), minlength=size)
        cf = np.pad(cf, (0, size - len(cf)))
        np.add.at(cf, at, np.array(uses, "int64"))
        for x in (seen, uses, unowned):
            x.clear()

    def totals() -> pa.RecordBatch:
        nonlocal df, cf
        fold()
        out = pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), pa.array(df), pa.array(cf)], names=["term", "df", "cf"])
        number.clear()
        number.default_factory, df, cf = count().__next__, df[:0], cf[:0]
        return out

    for batch in batches:
        for owned, text in zip(batch.column(0), batch.column(1), strict=True):
            words = Counter(_tokens(text.as_py()))
            ids = list(map(number.__getitem__, words))
            seen += ids
            uses += words.values()
            if not owned.as_py():
                unowned += ids
            if len(number) >= CELLS:
                yield totals()
            elif len(seen) >= CELLS:
                fold()
    yield totals()
