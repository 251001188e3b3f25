"""Token files: patched frame-of-reference blocks, written in ascending order of document and read back.

A file holds whole documents. Its ids stand in blocks of BLOCK values; each block has its least
value subtracted and is packed at the bit width that holds a chosen percentile of what is left.
Values wider than that are exceptions: their place and their upper bits stand in a list of their own.
The place of every block's first byte and first exception is in an index, so that any range of ids
is read from the blocks that hold it.

Layout (little-endian): "OTF1"; counts of documents, ids, blocks and exceptions (4 x u64); document
ids (i64 each); first id of each document and the end (u64); then per block the least value (u32),
width (u8), first byte (u64, and the end), first exception (u64, and the end); places of the exceptions
in their blocks (u16), their upper bits (u32); packed bits.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from orrery.llm.common import put_file, shared_files, slices, small_batches
from orrery.llm.tokens import library

MAGIC, BLOCK = b"OTF1", 512
#: Stands for a null document id, which sorts first.
NO_ID = -(2**63)


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 needs none."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes."""
    if width == 0:
        return np.zeros((len(values), 0), np.uint8)
    if width == 16:
        return values.astype("<u2").view(np.uint8).reshape(len(values), -1)
    bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros((len(packed), BLOCK), np.uint32)
    if width == 16:
        return packed.reshape(-1).view("<u2").reshape(len(packed), BLOCK).astype(np.uint32)
    bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(-1, width)
    whole = np.zeros((len(bits), 32), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(len(packed), BLOCK)


def to_file(doc_ids: list[int | None], ids: list[np.ndarray], percentile: float = 90.0) -> bytes:
    """The bytes of a file of these documents. The percentile of widths that fits a block's packed part is a
    parameter: a higher one makes fewer exceptions and wider blocks."""
    lengths = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.uint32)
    blocks = -(-len(flat) // BLOCK)
    grid = np.full(blocks * BLOCK, flat[-1] if len(flat) else 0, np.uint32)
    grid[: len(flat)] = flat
    grid = grid.reshape(blocks, BLOCK)
    rank = min(BLOCK - 1, int(BLOCK * percentile / 100))
    least = grid.min(1) if blocks else np.zeros(0, np.uint32)
    rest = grid - least[:, None]
    # The least width that so many of a block's values have at most.
    width = bit_widths(np.partition(rest, rank, axis=1)[:, rank]) if blocks else np.zeros(0, np.uint8)
    upper = rest >> width[:, None]
    row, place = np.nonzero(upper)
    low = rest & ((np.uint64(1) << width[:, None].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    size = BLOCK // 8 * width.astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    packed = np.zeros(at[-1], np.uint8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        for some in np.array_split(own, max(1, len(own) // 512)):
            where = at[some][:, None] + np.arange(BLOCK // 8 * int(w))
            packed[where] = pack_bits(low[some], int(w))
    first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=blocks))))
    head = np.array([len(ids), len(flat), blocks, len(row)], "<u8")
    return b"".join(
        x if isinstance(x, bytes) else x.tobytes()
        for x in (
            MAGIC, head, np.array([NO_ID if i is None else i for i in doc_ids], "<i8"), np.concatenate(([0], np.cumsum(lengths))).astype("<u8"),
            least.astype("<u4"), width, at.astype("<u8"), first.astype("<u8"), place.astype("<u2"), upper[row, place].astype("<u4"), packed,
        )
    )


class TokenFile:
    """Reads a file's bytes; ids(a, b) unpacks only the blocks that hold ids a to b."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.data, self.at = data, 4
        docs, self.n_ids, blocks, exceptions = map(int, self.take("<u8", 4))
        self.doc_ids, self.starts = self.take("<i8", docs), self.take("<u8", docs + 1).astype(np.int64)
        self.least, self.width = self.take("<u4", blocks), self.take("u1", blocks)
        self.places, self.first = self.take("<u8", blocks + 1).astype(np.int64), self.take("<u8", blocks + 1).astype(np.int64)
        self.where, self.upper = self.take("<u2", exceptions), self.take("<u4", exceptions)
        self.packed = self.take("u1", len(data) - self.at)

    def take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def ids(self, a: int, b: int) -> np.ndarray:
        lo, hi = a // BLOCK, -(-b // BLOCK)
        out = np.zeros((hi - lo, BLOCK), np.uint32)
        width = self.width[lo:hi]
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            for some in np.array_split(own, max(1, len(own) // 512)):
                where = self.places[lo + some][:, None] + np.arange(BLOCK // 8 * int(w))
                out[some] = unpack_bits(self.packed[where], int(w))
        i, j = self.first[lo], self.first[hi]
        row = np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1]))
        out[row, self.where[i:j]] |= self.upper[i:j] << width[row].astype(np.uint32)
        out += self.least[lo:hi, None]
        return out.reshape(-1)[a - lo * BLOCK : b - lo * BLOCK]

    def documents(self, ids_at_once: int = 2_000_000) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document id, first id and ids of each document, unpacking about so many ids at once."""
        i = 0
        while i < len(self.doc_ids):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + ids_at_once, "right")) - 1)
            j = min(j, len(self.doc_ids))
            some = self.ids(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                a, b = (self.starts[[k, k + 1]] - self.starts[i]).tolist()
                yield None if self.doc_ids[k] == NO_ID else int(self.doc_ids[k]), int(self.starts[k]), some[a:b]
            i = j


def write_token_files(docs: DataFrame, path: str, end_id: int | None = 2, ids_per_file: int = 4_000_000, percentile: float = 90.0, special_as_text: bool = False) -> tuple[str, DataFrame]:
    """Encodes whole texts (null: empty), appends end_id, and writes files in ascending order of doc_id.

    Returns the folder and the list of its files: name, part (the range of documents that a task wrote),
    number (the file within it), n_docs, n_ids, and start (ids in all files before it). Texts are dealt
    by ranges of doc_id, so a task holds neighbours, and are encoded there: one pass and one shuffle. A
    task keeps at most about ids_per_file ids (and one document) in memory. A task that runs again
    writes under other names, and only files of the attempt that succeeded are listed. Repeated doc_ids
    stay next to each other, in the order of a hash of their texts; a null doc_id comes first. An empty table has no files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_files(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = library(path, True, special_as_text), TaskContext.get().partitionId()
        doc_ids, held, size, number = [], [], 0, 0
        end = np.array([] if end_id is None else [end_id], "<u4")

        def flush() -> pa.RecordBatch:
            name = put_file(folder, f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.otf", to_file(doc_ids, held, percentile))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64())], names=["name", "part", "number", "n_docs", "n_ids"])

        for batch in slices(batches, "text"):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                doc_ids.append(doc_id)
                held.append(np.concatenate((ids, end)))
                size += len(held[-1])
                if size >= ids_per_file:
                    yield flush()
                    doc_ids, held, size, number = [], [], 0, number + 1
        if held:
            yield flush()

    # A doc_id, or null, that very many rows share is dealt by its texts.
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    listed = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").mapInArrow(run, "name string, part long, number long, n_docs long, n_ids long")
    listed.write.parquet(f"{folder}-list")
    files = spark.read.parquet(f"{folder}-list")
    # Running totals in two steps, so that no task reads the list of all files.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = parts.select("part", (F.sum("part_ids").over(W.orderBy("part")) - F.col("part_ids")).alias("part_start"))
    within = F.sum("n_ids").over(W.partitionBy("part").orderBy("number")) - F.col("n_ids")
    return folder, files.withColumn("within", within).join(before, "part").withColumn("start", F.col("part_start") + F.col("within")).drop("part_start", "within")


def read_token_files(folder: str, files: DataFrame) -> DataFrame:
    """Per document of the listed files: doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    little-endian unsigned 32-bit)."""
    return _read(folder, files, lambda ids: ids.astype("<u4").tobytes(), pa.binary(), "ids binary")


def read_checksums(folder: str, files: DataFrame) -> DataFrame:
    """read_token_files with the unsigned crc32 of the ids, ids_crc32, in their stead."""
    return _read(folder, files, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "ids_crc32 long")


def _read(folder: str, files: DataFrame, last, kind: pa.DataType, column: str) -> DataFrame:
    spark = files.sparkSession
    small_batches(spark)
    start = files.select("name", "start")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.otf").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(d, s, len(ids), last(ids)) for d, s, ids in TokenFile(content).documents()]
                for i in range(0, len(rows), 4096):
                    d, s, n, x = zip(*rows[i : i + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(d)), pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(x, kind)], names=["name", "doc_id", "at", "n_tokens", column.split()[0]])

    rows = found.mapInArrow(run, f"name string, doc_id long, at long, n_tokens long, {column}")
    # The join also leaves out files of attempts that didn't succeed.
    return rows.join(start, "name").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", column.split()[0])
