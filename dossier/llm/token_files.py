"""Operator 6: token ids in binary files with Elias-Fano encoded document boundaries.

A file holds the concatenated ids of consecutive documents.  Two Elias-Fano sequences stand
before them: where each document ends, and its document id less the smallest.  A sequence of
n values up to u takes about n * (2 + log2(u / n)) bits; a select directory with the place of
every 256th one bit returns any value without decoding the rest, and that is how files are read.

Layout, little-endian: ``magic`` 8 bytes; ``docs, ids, null_docs, first_doc`` int64; ``width``
(bytes an id takes) int64; then boundaries, document ids, token ids.  An Elias-Fano block is
``n, low_bits, low_bytes, high_bytes`` int64, the low bits, the high bits (unary gaps), and a
uint32 directory.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.shared import scratch, written
from dossier.llm.tokens import encoder

MAGIC = b"EFTOKEN1"
SAMPLE = 256
#: Bytes of token ids after which a file ends; a document is never split over files.
FILE_BYTES = 16 << 20
SLICE = 512
#: Most tasks that read files.
READERS = 10_000


def ef_encode(values: np.ndarray) -> bytes:
    """Elias-Fano block of ascending, non-negative integers."""
    n = len(values)
    values = values.astype(np.uint64)
    largest = int(values[-1]) if n else 0
    low_bits = max(0, (largest // n).bit_length() - 1) if n else 0
    low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if n else np.zeros(0, np.uint8)
    ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    lows, highs = np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()
    directory = ones[::SAMPLE].astype("<u4").tobytes()
    return np.array([n, low_bits, len(lows), len(highs)], "<i8").tobytes() + lows + highs + directory


class EliasFano:
    """A block read back: ``select(i)`` is value i; ``end`` is where the block ends.

    A select goes to the directory's place at or before one bit i and counts the ones of the words
    from there; nothing else is decoded.
    """

    def __init__(self, raw: bytes | memoryview, at: int):
        self.n, self.low_bits, lows, highs = (int(x) for x in np.frombuffer(raw, "<i8", 4, at))
        at += 32
        self.low, self.high = memoryview(raw)[at : at + lows], memoryview(raw)[at + lows : at + lows + highs]
        samples = -(-self.n // SAMPLE)
        self.directory = np.frombuffer(raw, "<u4", samples, at + lows + highs)
        self.end = at + lows + highs + 4 * samples

    def _place(self, i: int) -> int:
        """The bit at which one bit number i stands."""
        place = int(self.directory[i // SAMPLE])
        left, byte = i % SAMPLE, place // 8
        word = int.from_bytes(self.high[byte : byte + 8], "little") >> place % 8 << place % 8
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 8
            word = int.from_bytes(self.high[byte : byte + 8], "little")
        for _ in range(left):
            word &= word - 1
        return 8 * byte + (word & -word).bit_length() - 1

    def select(self, i: int) -> int:
        first = i * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little") >> first % 8
        return (self._place(i) - i) << self.low_bits | low & (1 << self.low_bits) - 1


def file_parts(docs: list[int | None], ids: list[bytes], width: int) -> list[bytes]:
    """A file's bytes in parts; ``docs`` ascend, nulls first; ``ids`` take ``width`` bytes each, little-endian."""
    nulls = sum(d is None for d in docs)
    known = np.array(docs[nulls:], np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) // width for x in ids])
    head = np.array([len(docs), int(ends[-1]) if len(ends) else 0, nulls, first, width], "<i8").tobytes()
    gaps = known.astype(np.uint64) - np.int64(first).astype(np.uint64)
    return [MAGIC, head, ef_encode(ends), ef_encode(gaps), *ids]


class TokenFile:
    """A file read back: document i of ``n`` has the id ``doc(i)``, the ids from ``bounds(i)`` and, as uint32, ``ids(i)``.

    Ids and boundaries are selected one at a time; no table of them is made.
    """

    def __init__(self, raw: bytes | memoryview):
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.n, total, self.nulls, self.first, width = (int(x) for x in np.frombuffer(raw, "<i8", 5, 8))
        self.boundaries = EliasFano(raw, 48)
        self.gaps = EliasFano(raw, self.boundaries.end)
        self.flat = np.frombuffer(raw, f"<u{width}", total, self.gaps.end)
        assert self.boundaries.n == self.n and self.gaps.n == self.n - self.nulls and (not self.n or self.boundaries.select(self.n - 1) == total)

    def doc(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.gaps.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.boundaries.select(i - 1) if i else 0, self.boundaries.select(i)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.flat[start:end].astype("<u4")


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Encode every document, append ``end_id``, write files in ascending document id to ``path``.

    ``path`` is a URI that every executor reaches (file system, hdfs, s3).  Returns the manifest, one
    row per file: ``name, part, seq, n_docs, n_ids``; (part, seq) is the order.  Each attempt of a
    task writes under names of its own, and only the attempt that counts is in the manifest.

    Null and empty texts are the end id alone; null ids come first; equal ids are kept, ordered by
    the text's hash; an empty table writes no file.
    """
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = frame.repartitionByRange("id", tie).sortWithinPartitions("id", tie)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode, end = encoder(tokenizer).encode_many, np.array([end_id], "<u4").tobytes()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        names, counts = [], []
        own: list[int | None] = []
        ids: list[bytes] = []

        def flush() -> None:
            name = f"tokens-{part:06d}-{len(names):06d}-{attempt}.eft"
            with store.open_output_stream(f"{folder}/{name}", buffer_size=1 << 20) as f:
                f.writelines(file_parts(own, ids, width))
            names.append(name)
            counts.append((len(own), sum(map(len, ids)) // width))
            own.clear()
            ids.clear()

        held = 0
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                rows = batch.slice(at, SLICE)
                for doc, text in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist())):
                    own.append(doc)
                    ids.append(np.frombuffer(text + end, "<u4").astype(f"<u{width}").tobytes())
                    held += len(ids[-1])
                    if held >= file_bytes:
                        flush()
                        held = 0
        if own:
            flush()
        columns = [names, [part] * len(names), range(len(names)), [c[0] for c in counts], [c[1] for c in counts]]
        types = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["name", "part", "seq", "n_docs", "n_ids"])

    return written(ordered.mapInArrow(write, "name string, part long, seq long, n_docs long, n_ids long"), "token-manifest")


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document from the files that the manifest names: ``doc_id, start, n_tokens, ids_crc32, ids``.

    ``start`` counts the ids of all documents before it, over all files in order.  Without ``with_ids``
    the ids themselves are left out.  The manifest's rows are dealt to tasks, which open the files they
    name by themselves, so no file's content is moved.
    """
    # one row a writing task, then one a file of a task: the files hold terabytes where these windows order thousands of rows
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("own")).select("part", F.coalesce(F.sum("own").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("part_base"))
    inside = F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    based = manifest.withColumn("inside", inside).join(parts, "part").select((F.col("part_base") + F.col("inside")).alias("base"), "name")
    files = manifest.count()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for base, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{folder}/{name}") as f:
                    file = TokenFile(memoryview(f.read()))
                end = 0
                for at in range(0, file.n, 4096):
                    docs, starts, sizes, sums, all_ids = [], [], [], [], []
                    for i in range(at, min(at + 4096, file.n)):
                        start, end = end, file.boundaries.select(i)  # a document begins where the one before it ends
                        ids = file.flat[start:end].astype("<u4").tobytes()
                        docs.append(file.doc(i))
                        starts.append(base + start)
                        sizes.append(end - start)
                        sums.append(zlib.crc32(ids))
                        if with_ids:
                            all_ids.append(ids)
                    columns, names = [pa.array(c, pa.int64()) for c in (docs, starts, sizes, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array(all_ids, pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return based.repartition(min(files, READERS), "name").mapInArrow(read, schema)


def token_folder(spark: SparkSession) -> str:
    """A new folder of this application under the shared one."""
    return f"{scratch(spark)}/token-files-{uuid.uuid4().hex}"
