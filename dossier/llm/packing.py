"""Operator 5: sum-of-squares online packing of token ids into windows of a fixed length.

Each partition packs its own documents in reading order and keeps a level array: ``count[h]``
is its number of open windows filled up to ``h``.  A document's last piece goes to the level
(an open window or a new one) for which the sum of the squared counts afterwards is least;
whole windows of a long document are cut off first.  In the end the pieces of the least filled window go
through the levels again, over and over, and one is cut only where no open window has room for it, to complete
the fullest.  The last open window alone is cut into windows whose lengths are powers of two, so nothing is padded.

No row is shuffled: packing depends on nothing outside a partition, and a task that is repeated
gives the same sequence ids as long as it reads the same rows in the same order, as it does from files.
A partition holds the ids of its open windows, at most the last piece of each of its documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.tokens import encoder

CAPACITY = 1024
#: Texts encoded at a time.
SLICE = 512

SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple[object, int, int, bytes]  # document id, start in it, its number of ids, ids


class LevelPacker:
    """Windows of one partition.  ``add`` and ``close`` return the windows that are complete."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, list[list[Piece]]] = {}  # by level

    def level_for(self, size: int, new: bool = True) -> int:
        """The level, 0 for a new window, where the squared counts grow least; the fullest of equals.  Without ``new``, 0 if none has room."""
        levels = np.flatnonzero(self.count[: self.capacity - size + 1])
        if new:
            levels = np.append(levels, 0)
        if not len(levels):
            return 0
        after = levels + size
        growth = np.where(after < self.capacity, 2 * self.count[after] + 1, 0) - np.where(levels > 0, 2 * self.count[levels] - 1, 0)
        best = np.flatnonzero(growth == growth.min())
        return int(levels[best].max())

    def take(self, level: int) -> list[Piece]:
        """An open window of this level, which is no longer open."""
        self.count[level] -= 1
        return self.windows[level].pop()

    def put(self, window: list[Piece], level: int) -> list[list[Piece]]:
        """Open the window at its level, or return it if it is full."""
        if level == self.capacity:
            return [window]
        self.count[level] += 1
        self.windows.setdefault(level, []).append(window)
        return []

    def add(self, doc: object, ids: bytes) -> list[list[Piece]]:
        total, full = len(ids) // 4, []
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            full.append([(doc, start, total, ids[4 * start : 4 * (start + self.capacity)])])
        if size := total - whole:
            level = self.level_for(size)
            window = self.take(level) if level else []
            window.append((doc, whole, total, ids[4 * whole :]))
            full += self.put(window, level + size)
        return full

    def close(self) -> list[list[Piece]]:
        """Spread the least filled window over the others until one is left; cut that one into powers of two."""
        full: list[list[Piece]] = []
        while self.count.sum() > 1:
            for doc, start, total, ids in self.take(int(self.count.nonzero()[0][0])):
                while ids:
                    size = len(ids) // 4
                    level = self.level_for(size, new=False)
                    if not level and self.count.any():  # no window has room: complete the fullest
                        level = int(self.count.nonzero()[0][-1])
                        size = self.capacity - level
                    window = self.take(level) if level else []
                    window.append((doc, start, total, ids[: 4 * size]))
                    full += self.put(window, level + size)
                    start, ids = start + size, ids[4 * size :]
        return full + [part for level in self.count.nonzero()[0].tolist() for part in self.cut(self.take(level), level)]

    def cut(self, pieces: list[Piece], rest: int) -> list[list[Piece]]:
        """The ``rest`` ids of ``pieces`` as windows whose lengths are powers of two."""
        out, window, room = [], [], 0
        for doc, start, total, ids in pieces:
            while ids:
                if not room:
                    room = 1 << (rest.bit_length() - 1)
                    rest -= room
                    out.append(window := [])
                part, ids = ids[: 4 * room], ids[4 * room :]
                window.append((doc, start, total, part))
                start += len(part) // 4
                room -= len(part) // 4
        return out


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    capacity: int = CAPACITY, with_ids: bool = True,
) -> DataFrame:
    """Pack every document of ``docs`` into windows of ``capacity`` ids.

    A document is its token ids and then ``end_id``.  One row per piece: ``doc_id``, ``start``
    (ids of the document before it), ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset`` in the sequence, and with ``with_ids`` the ``ids`` (little-endian uint32).  A sequence is
    full or as long as a power of two.

    Null and empty texts are the end id alone; null ids stay null; repeated rows are packed each;
    an empty table gives no rows; other columns are not read; very long texts are cut into full
    windows; of levels that are equally good (a tie) the fullest is taken.
    """
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = frame.schema["id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer).encode_many, LevelPacker(capacity)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 36
        arrow_id = None

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for window in windows:
                offset = 0
                for doc, start, total, ids in window:
                    row = (doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset)
                    out.append((*row, ids) if with_ids else row)
                    offset += len(ids) // 4
                sequence += 1
            types = [arrow_id, *[pa.int64()] * 6, pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names[: len(out[0])])

        for batch in batches:
            arrow_id = batch.column(0).type
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                full = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    full += packer.add(doc, ids + end)
                if full:
                    yield rows(full)
        if rest := packer.close():
            yield rows(rest)

    schema = SCHEMA.format(id=id_type.simpleString()) + (", ids binary" if with_ids else "")
    return frame.mapInArrow(pack, schema)
