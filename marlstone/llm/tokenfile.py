"""Token-id files of fixed-width bit packing.

A file holds the ids of consecutive documents in blocks of BLOCK ids, each id in as many bits as the vocabulary needs, then a footer:
the documents' ids and sizes, the offset of each block, and their numbers. A reader finds any id by its block's offset, without
reading those before, and unpacks a block in numpy. Files are written under a temporary name and moved, so a task that
runs twice leaves one whole file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Stash, read, ship, tidied
from .tokens import encoded

BLOCK, MAGIC, TAIL = 4096, b"MTOK1\0\0\0", struct.Struct("<8sqqqqq")
#: Documents of a file; more where there would be over MOST_FILES files, whose borders a task needs.
DOCS_PER_FILE, MOST_FILES = 5_000, 100_000
NULL_DOC = -(1 << 63)


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian: bit b of id i is bit i * bits + b of the result."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.rest, self.at = sink, bits, np.zeros(0, np.uint32), 0
        self.docs, self.sizes, self.offsets = [], [], []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.rest = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(self.rest) // BLOCK * BLOCK
        for b in range(0, whole, BLOCK):
            self._put(self.rest[b : b + BLOCK])
        self.rest = self.rest[whole:]

    def _put(self, block: np.ndarray) -> None:
        data = pack(block, self.bits)
        self.offsets.append(self.at)
        self.at += len(data)
        self.sink.write(data)

    def finish(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        for table in (self.docs, self.sizes, self.offsets):
            self.sink.write(np.array(table, "<i8").tobytes())
        self.sink.write(TAIL.pack(MAGIC, self.bits, BLOCK, len(self.docs), len(self.offsets), sum(self.sizes)))


class Reader:
    """Random access to one file; source: a seekable file of pyarrow."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - TAIL.size)
        magic, self.bits, self.block, docs, blocks, self.n = TAIL.unpack(source.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.end = size - TAIL.size - 8 * (2 * docs + blocks)
        source.seek(self.end)
        tables = np.frombuffer(source.read(8 * (2 * docs + blocks)), "<i8")
        self.docs, self.sizes, self.offsets = tables[:docs], tables[docs : 2 * docs], tables[2 * docs :]

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n, from the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        stop = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        held = min((last + 1) * self.block, self.n) - first * self.block
        data = self.source.read(stop - int(self.offsets[first]))
        per, parts = self.block * self.bits // 8, []
        for b in range(last - first + 1):
            parts.append(unpack(data[b * per : (b + 1) * per], min(self.block, held - b * self.block), self.bits))
        return np.concatenate(parts)[start - first * self.block :][:n]


def write_tokens(docs: DataFrame, tokenizer: str, end: int, stash: Stash, docs_per_file: int = DOCS_PER_FILE) -> tuple[str, DataFrame]:
    """Writes all documents in ascending doc_id order; the folder, and (part, n), each file's number and the ids in it. Null texts have the end id alone.

    The ranges of doc_id that files hold come from the column of doc_ids alone. Tasks encode what they read and send each document's
    ids, two or four bytes each, to the task of its range, so texts aren't shuffled and each is encoded once."""
    spark = docs.sparkSession
    ship(spark)
    from tokenizers import Tokenizer

    bits = bits_for(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1))
    kind, folder = "<u2" if bits <= 16 else "<u4", f"{stash.path}/tokens"
    number = docs.count()
    files = max(1, -(-number // max(docs_per_file, -(-number // MOST_FILES))))
    ranged = docs.select("doc_id").repartitionByRange(files, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("last"))
    lasts = np.array(sorted(r["last"] for r in ranged.collect() if r["last"] is not None), np.int64)  # one for each file, MOST_FILES at most
    borders, n_files = spark.sparkContext.broadcast(lasts[:-1]), max(1, len(lasts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, n in encoded(batches, tokenizer, end):
            part = np.searchsorted(borders.value, np.array([NULL_DOC if i is None else i for i in ids], np.int64)).astype(np.int32)
            data = [p.tobytes() for p in np.split(flat.astype(kind), np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["part", "doc_id", "data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        made = None
        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            for part, doc, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if made is None:
                    fs.create_dir(root, recursive=True)
                    number, temp = part, f"{root}/.{part}-{uuid.uuid4().hex}"
                    made = Writer(fs.open_output_stream(temp), bits)
                made.add(NULL_DOC if doc is None else doc, np.frombuffer(data, kind))
        if made is not None:
            made.finish()
            made.sink.close()
            fs.move(temp, f"{root}/{number:06d}.mtok")
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sum(made.sizes)], pa.int64())], ["part", "n"])

    coded = docs.select("doc_id", "text").mapInArrow(tidied(encode), "part int, doc_id long, data binary")
    dealt = coded.repartitionById(n_files, "part").sortWithinPartitions("doc_id", "data")
    return folder, stash.keep(dealt.mapInArrow(tidied(write), "part long, n long"), "files")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32. One task a file; it is told how many ids the files before hold."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # MOST_FILES rows at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            for part, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{root}/{part:06d}.mtok") as source:
                    file = Reader(source)
                    ends, crcs, at = np.cumsum(file.sizes), [], 0
                    while at < len(ends):  # stretches of about a hundred blocks at a time
                        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 100 * BLOCK)))
                        first = int(ends[at] - file.sizes[at])
                        ids = file.ids(first, int(ends[to - 1]) - first).astype("<u4").tobytes()
                        crcs += [zlib.crc32(ids[4 * int(e - s - first) : 4 * int(e - first)]) for e, s in zip(ends[at:to], file.sizes[at:to], strict=True)]
                        at = to
                    yield pa.RecordBatch.from_arrays([pa.array(file.docs, mask=file.docs == NULL_DOC), pa.array(base + ends - file.sizes), pa.array(file.sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    told = files.select("part", before.alias("base"))
    return told.repartitionByRange(max(1, files.count()), "part").mapInArrow(tidied(scan), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, tokenizer: str, end: int, stash: Stash | None = None, docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Encodes, writes and reads back: doc_id, start, n_tokens, ids_crc32, one row per row of docs.

    Null and empty texts have the end id alone, very long ones pass through in one piece; a null doc_id sorts first; rows that repeat a doc_id stay separate rows, in the
    order of their ids, and share a file; an empty table writes no file and gives no rows; other columns are ignored."""
    stash = stash or Stash(docs.sparkSession)
    return read_tokens(docs.sparkSession, *write_tokens(docs, tokenizer, end, stash, docs_per_file))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_file_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
