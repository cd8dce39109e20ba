"""Packing documents into training sequences with bounded memory.

Each partition keeps a fixed number of open windows. A document's full windows are emitted at once; its
remainder goes to the open window that it fills best. When none has room, the fullest is emitted: if its gap
is at least `split_gap`, the remainder is cut to fill it, else the gap becomes padding. Windows still open at
a partition's end are written with their ids, and a second pass packs those of many partitions together
and cuts what is left into full windows and powers of two, which need no padding.

Defined cases: null text counts as empty and gives the end id alone; a null doc_id is kept as it is; repeated
rows are packed once each; a text of any length is cut; columns other than doc_id and text are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import wordhash
from skarn.llm.scratch import Scratch

WINDOW, OPEN_WINDOWS, SPLIT_GAP, END_ID, CHUNK = 4096, 64, 48, 2, 2 << 20
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])

# A piece is (doc_id, start, ids, doc_tokens); start counts the document's ids before it.


class Packer:
    """Best fit into a fixed number of open windows. seal() gets each finished window's pieces."""

    def __init__(self, window: int, most_open: int, split_gap: int, seal):
        self.window, self.most_open, self.split_gap, self.seal = window, most_open, split_gap, seal
        self.free = np.zeros(most_open, dtype=np.int64)
        self.held: list[list] = []

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self.seal([(doc_id, start, ids[: self.window], total)])
            start, ids = start + self.window, ids[self.window :]
        if not len(ids):
            return
        n = len(self.held)
        gaps = self.free[:n] - len(ids)
        fits = np.flatnonzero(gaps >= 0)
        if len(fits):
            at = int(fits[np.argmin(gaps[fits])])
        elif n < self.most_open:
            at = n
            self.held.append([])
            self.free[at] = self.window
        else:
            at = int(np.argmin(self.free))
            gap = int(self.free[at])
            if gap >= self.split_gap:
                self.held[at].append((doc_id, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            self.seal(self.held[at])
            self.held[at], self.free[at] = [], self.window
        self.held[at].append((doc_id, start, ids, total))
        self.free[at] -= len(ids)
        if not self.free[at]:
            self.seal(self.held[at])
            last = len(self.held) - 1
            self.held[at], self.free[at] = self.held[last], self.free[last]
            self.held.pop()

    def rest(self) -> list[list]:
        """The windows still open, fullest first."""
        order = np.argsort(self.free[: len(self.held)], kind="stable")
        return [self.held[i] for i in order.tolist()]


class _Rows:
    """Rows of finished or open windows as Arrow batches."""

    def __init__(self, first_id: int, with_ids: bool):
        self.next, self.with_ids, self.rows = first_id, with_ids, []

    def seal(self, pieces: list, done: bool = True) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            raw = np.ascontiguousarray(ids, dtype="<u4").tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), total, self.next if done else None, offset, raw if self.with_ids or not done else None))
            offset += len(ids)
        self.next += 1

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def powers_of_two(n: int) -> list[int]:
    """Sizes of the set bits of n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _finish(windows: list[list], window: int, rows: _Rows) -> None:
    """Cut what is left into full windows, then into powers of two."""
    pieces = [p for held in windows for p in held]
    left = sum(len(p[2]) for p in pieces)
    for size in [window] * (left // window) + powers_of_two(left % window):
        out, room = [], size
        while room:
            doc_id, start, ids, total = pieces.pop(0)
            out.append((doc_id, start, ids[:room], total))
            if len(ids) > room:
                pieces.insert(0, (doc_id, start + room, ids[room:], total))
            room -= len(out[-1][2])
        rows.seal(out)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, split_gap: int = SPLIT_GAP, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids where with_ids.

    tokenizer: any `tokenizers` file (see `tokens`); every executor has it at this path.
    sequence_id is unique, not dense.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from skarn.llm.tokens import word_tokens

        words = word_tokens(tokenizer)
        rows = _Rows(TaskContext.get().partitionId() << 32, with_ids)
        packer = Packer(window, open_windows, split_gap, rows.seal)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            data, bounds = wordhash.buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for row, to in wordhash.chunks(bounds, CHUNK):
                part = bounds[row : to + 1]
                for doc_id, got in zip(ids[row:to], words.encode(data[part[0] : part[-1]], part - part[0]), strict=True):
                    packer.add(doc_id, 0, np.concatenate([got, end]), len(got) + 1)
                if len(rows.rows) > 2000:
                    yield rows.take()
        for held in packer.rest():
            rows.seal(held, done=False)
        yield rows.take()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(1 << 62 | TaskContext.get().partitionId() << 32, with_ids)
        packer = Packer(window, open_windows, split_gap, rows.seal)
        for batch in batches:
            for r in batch.to_pylist():
                packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], dtype="<u4"), r["doc_tokens"])
            if len(rows.rows) > 2000:
                yield rows.take()
        _finish(packer.rest(), window, rows)
        yield rows.take()

    pieces = Scratch(spark, "pack").cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(first, _SCHEMA), "pieces")
    merged = pieces.where("sequence_id is null").select("doc_id", "start", "doc_tokens", "ids").mapInArrow(merge, _SCHEMA)
    out = pieces.where("sequence_id is not null").unionByName(merged)
    return out if with_ids else out.drop("ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 4096 tokens."""
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
