"""Hierarchical packing of documents into windows of several lengths.

A document's ids, closed by an end id, are cut into full windows of the longest tier;
what is left is routed to the shortest tier whose window holds it.  Each task packs
the documents of its own input split, in pools of about ``POOL_TOKENS`` ids:

1. **Tiers, the longest first.** The largest piece of a tier opens a window; the gap is
   closed by the largest pieces that fit, of this tier and then of the shorter ones.
2. **Gaps.** If no piece fits, the smallest one that is left is cut, and its rest is
   routed anew; so every window is exactly full.  What cannot fill one waits for the
   next pool, and at the end of the task it is cut into windows at powers of two.
3. **Step groups.** The windows of one tier are dealt to training steps of
   ``STEP_TOKENS`` ids each, in turns from the costliest to the cheapest by the sum of
   squared piece lengths (what attention inside documents costs), forth and back, so
   that steps are alike in ids and in cost.  The last step of a task may be shorter.

There is no shuffle: lengths, cuts and checksums are made where the ids are, a task
holds a pool and one document, and a lost task is done again with the same numbers
(ids of sequences and steps begin with the number of the input split).

Cases: null and empty texts are the end id alone; texts are encoded whole, of any length;
repeated rows and ids are documents of their own, a null id is carried along; an empty
table has no pieces; other columns of the documents are not read.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandwork.llm.bpe import CUT, byte_letters, codec
from strandwork.llm.texts import pieces

#: Context lengths, shortest first; all are powers of two.
WINDOWS = (256, 512, 1024, 2048)
#: Ids that a task gathers before it packs them.
POOL_TOKENS = 1 << 20
#: Ids of a training step.
STEP_TOKENS = 1 << 16
END_ID = 1


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    """The published vocabulary file as ranks; one per worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(byte_of[c] for c in name): i for name, i in spec["model"]["vocab"].items() if name not in special}
    return tiktoken.Encoding("public", pat_str=CUT.pattern, mergeable_ranks=ranks, special_tokens=special)


def encoded(path: str, text: str) -> np.ndarray:
    """Ids of a text as unsigned 32-bit numbers; strings of added tokens are those tokens."""
    try:
        return encoder(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        # The pattern gives up on stretches of hundreds of thousands of blanks; the codec does not.
        return codec(path).encode([text])[0].astype(np.uint32)


class Piece:
    """Consecutive ids of one document."""

    __slots__ = ("key", "start", "ids", "total")

    def __init__(self, key, start: int, ids: np.ndarray, total: int):
        self.key, self.start, self.ids, self.total = key, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.key, self.start, self.ids[:n], self.total), Piece(self.key, self.start + n, self.ids[n:], self.total)


def _size(piece: Piece) -> int:
    return len(piece.ids)


class Packer:
    """Packs the documents of one task; rows come out by ``rows`` and are then forgotten."""

    def __init__(self, first: int, windows: tuple[int, ...] = WINDOWS, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS):
        if any(w & (w - 1) for w in windows) or list(windows) != sorted(set(windows)):
            raise ValueError("windows are different powers of two, shortest first")
        self.windows, self.pool_tokens, self.step_tokens = windows, pool_tokens, max(step_tokens, windows[-1])
        self.sequence = self.step = first
        self.pool: list[Piece] = []
        self.held = 0
        #: Closed windows of each length that wait for a step: (cost, rows without sequence and step).
        self.closed: dict[int, list[tuple[int, list[tuple]]]] = {}
        self.rows: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        longest, total = self.windows[-1], len(ids)
        whole = total - total % longest
        for start in range(0, whole, longest):
            self._close(longest, [Piece(key, start, ids[start : start + longest], total)])
        if whole < total:
            # A copy, so that the rest of a long document does not keep the whole of it.
            self.pool.append(Piece(key, whole, ids[whole:].copy() if whole else ids, total))
        self.held += total
        if self.held >= self.pool_tokens:
            self.pack()
            self.deal()
            self.held = sum(map(_size, self.pool))

    def finish(self) -> None:
        self.pack()
        left = sum(map(_size, self.pool))
        while left:
            window = 1 << (left.bit_length() - 1)
            own, gap = [], window
            while gap:
                piece = self.pool.pop()
                if _size(piece) > gap:
                    piece, rest = piece.cut(gap)
                    self.pool.append(rest)
                own.append(piece)
                gap -= _size(piece)
            self._close(window, own)
            left -= window
        self.deal(last=True)

    def pack(self) -> None:
        """Close as many windows as the pool fills, tier by tier."""
        pool = sorted(self.pool, key=_size)
        sizes = [_size(p) for p in pool]
        for tier in range(len(self.windows) - 1, -1, -1):
            window, shorter = self.windows[tier], self.windows[tier - 1] if tier else 0
            while sizes and sizes[-1] > shorter:
                sizes.pop()
                own = [pool.pop()]
                gap = window - _size(own[0])
                while gap and sizes:
                    at = bisect_right(sizes, gap) - 1
                    if at >= 0:
                        own.append(pool.pop(at))
                        gap -= sizes.pop(at)
                    else:
                        piece, rest = pool.pop(0).cut(gap)
                        sizes.pop(0)
                        own.append(piece)
                        insort(pool, rest, key=_size)
                        insort(sizes, _size(rest))
                        gap = 0
                if gap:
                    # The pool has run out inside this window.
                    self.pool = own
                    return
                self._close(window, own)
        self.pool = pool

    def _close(self, window: int, own: list[Piece]) -> None:
        rows, offset = [], 0
        for p in own:
            rows.append((p.key, p.start, _size(p), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, offset))
            offset += _size(p)
        self.closed.setdefault(window, []).append((sum(_size(p) ** 2 for p in own), rows))

    def deal(self, last: bool = False) -> None:
        """Deal closed windows to steps of equal ids and about equal cost; what fills no step waits, or is the last one."""
        for window, closed in self.closed.items():
            each = max(1, self.step_tokens // window)
            steps = len(closed) // each
            full, self.closed[window] = closed[: steps * each], closed[steps * each :]
            full.sort(key=lambda w: -w[0])
            for i, (_, rows) in enumerate(full):
                turn, place = divmod(i, steps)
                self._emit(window, rows, self.step + (steps - 1 - place if turn % 2 else place))
            self.step += steps
            if last and self.closed[window]:
                for _, rows in self.closed[window]:
                    self._emit(window, rows, self.step)
                self.step += 1
                self.closed[window] = []

    def _emit(self, window: int, rows: list[tuple], step: int) -> None:
        for key, start, length, crc, total, offset in rows:
            self.rows.append((key, start, length, crc, total, self.sequence, offset, window, step))
        self.sequence += 1


def packed(docs: DataFrame, vocabulary: str, windows: tuple[int, ...] = WINDOWS, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS,
           end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step)."""
    kind = docs.schema[key].dataType
    schema = (f"key {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "window int, step long")

    def run(batches) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 32, windows, pool_tokens, step_tokens)
        end = np.array([end_id], np.uint32)
        shape = None

        def out():
            columns = list(zip(*packer.rows))
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, shape.types)], schema=shape)

        for part, texts in pieces(batches):
            if shape is None:
                longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
                shape = pa.schema([("key", part.schema.field(0).type), *((n, pa.int64()) for n in longs), ("window", pa.int32()), ("step", pa.int64())])
            for k, t in zip(part.column(0).to_pylist(), texts):
                packer.add(k, np.append(encoded(vocabulary, t), end))
            if packer.rows:
                yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, schema).withColumnRenamed("key", key)
