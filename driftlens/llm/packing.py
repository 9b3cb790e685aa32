"""Packing token sequences into windows of fixed capacity by best-fit decreasing.

A document longer than a window is first cut into full windows; what is left of it, and every shorter document, is
placed, longest first, into the open window with the least room that still suffices. A segment tree indexed by
remaining capacity finds that window in O(log capacity). Each task packs its own rows, in pools of bounded size, so
there is no shuffle and a lost task is repeated alone; a pool's result depends on its rows only, not on their order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import slices
from driftlens.llm.token_counts import encoder


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts above a stack of windows for each capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        if room <= 0:
            return
        self.stacks[room].append(window)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        at, count = self.size + room, self.count
        while at:
            count[at] += by
            at >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window with the least room of at least ``need``: (room, window)."""
        at, count = self.size + need, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up, until a right sibling holds windows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not count[at]:
                    at += 1
        room = at - self.size
        self._change(room, -1)
        return room, self.stacks[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """For lengths in falling order the window and the offset of each, and the number of windows."""
    windows, offsets, used, free = [], [], 0, OpenWindows(capacity)
    for n in lengths:
        found = free.tightest(n)
        if found is None:
            found, used = (capacity, used), used + 1
        room, window = found
        windows.append(window)
        offsets.append(capacity - room)
        free.add(room - n, window)
    return windows, offsets, used


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    pool: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; a row's ids end with ``end_id``.

    Null and empty texts are one piece of one id. Repeated rows are packed each. Null ids stay null. No row is lost,
    cut short or capped: ``pool`` only bounds how many pieces one task sorts at once. An empty table gives no rows.
    """
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, "bytes")
        end = np.asarray([end_id], "<u4").tobytes()
        base, step, held = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal step
            held.sort(key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1], p[3]))
            windows, offsets, used = best_fit_decreasing([p[2] for p in held], capacity)
            ids = [base + step + w for w in windows]
            step += used
            for at in range(0, len(held), 20_000):
                part = held[at : at + 20_000]
                columns = [*zip(*part, strict=True), ids[at : at + 20_000], offsets[at : at + 20_000]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            held.clear()

        for batch in slices(batches, 128, keep=True):
            rows = batch.column(0).to_pylist()
            for doc, ids in zip(rows, own.texts([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    held.append((doc, start, len(piece) // 4, zlib.crc32(piece), n))
            if len(held) >= pool:
                yield from flush()
        if held:
            yield from flush()

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    out = source.mapInArrow(work, ", ".join(f"{n} long" for n in names))
    return out.select(F.col("id").alias(id_col), *names[1:])
