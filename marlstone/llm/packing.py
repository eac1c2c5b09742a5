"""Best-fit packing with certified bounds.

Pieces are dealt to partitions and packed best-fit decreasing. Lower bounds from dual-feasible functions certify a partition whose
number of sequences none can beat. Partitions with a gap, and the last open sequences of the others, give their emptiest
sequences' documents to an exchange, which deals them anew to fewer partitions and packs again, until the whole meets its bound or
one partition is left.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Stash, read, settle, ship, tidied
from .tokens import encoded

LENGTH = 2048
#: Pieces a partition is dealt; its task holds about 40 bytes for each.
PIECES, LEAST_PARTS = 50_000, 8
#: Room, in sequences, that a partition gives to the exchange, and again for each sequence of its gap.
ROOM = 4


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that counts[s] pieces of each size s need at least: the best of three families of dual-feasible functions."""
    cap = len(counts) - 1
    if not counts[1:].any():
        return 0
    s = np.arange(cap + 1)
    best = -(-int((counts * s).sum()) // cap)
    below, n_below = np.cumsum(counts * s), np.cumsum(counts)
    for a in range(1, cap // 2 + 1):  # pieces under a vanish, those over cap - a fill a sequence
        big = int(n_below[cap] - n_below[cap - a])
        best = max(best, -(-(big * cap + int(below[cap - a] - below[a - 1])) // cap))
    for k in range(1, 65):  # sizes rounded down to multiples of cap / k, those that divide evenly kept
        even = (k + 1) * s % cap == 0
        best = max(best, -(-int((counts * np.where(even, s * k, (k + 1) * s // cap * cap)).sum()) // (cap * k)))
    return best


def best_fit(sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each piece and the fill of each bin."""
    order = np.argsort(-sizes, kind="stable")
    where = np.zeros(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(cap + 1)]  # bins by room
    rooms, room_of = 0, []  # the bits of rooms: which lists have bins
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = rooms >> size
        if size and fit:
            room = size + (fit & -fit).bit_length() - 1
            at = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        elif size or not room_of:
            room, at = cap, len(room_of)
            room_of.append(cap)
        else:
            where[i] = 0
            continue
        where[i] = at
        room_of[at] = left = room - size
        if left:
            open_[left].append(at)
            rooms |= 1 << left
    return where, cap - np.array(room_of, np.int64)


def cut(n: int, cap: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than cap, and only if there are more."""
    first = n if n <= cap else n % cap or cap
    return [(0, first)] + [(at, cap) for at in range(first, n, cap)]


def pieces_of(docs: DataFrame, tokenizer: str, end: int, cap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, n in encoded(batches, tokenizer, end):
            raw, at, rows = memoryview(flat.astype("<u4").tobytes()), 0, []
            for doc, size in zip(ids, n.tolist(), strict=True):
                rows += [(doc, k, s, w, zlib.crc32(raw[4 * (at + s) : 4 * (at + s + w)])) for k, (s, w) in enumerate(cut(size, cap))]
                at += size
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    settle(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, again boolean"


def packer(cap: int, round_: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        table = table.drop_columns(["part"]).sort_by(order)
        sizes = table.column("length").to_numpy()
        bins, fill = best_fit(sizes, cap)
        gap = len(fill) - lower_bound(np.bincount(sizes, minlength=cap + 1))
        # The emptiest sequences go to the exchange, until their room makes up for ROOM sequences and as many for each of the gap.
        emptiest = np.argsort(fill, kind="stable")
        room = np.cumsum(cap - fill[emptiest])
        goes = np.zeros(len(fill), bool)
        goes[emptiest[: int(np.searchsorted(room, ROOM * cap * (1 + gap))) + 1]] = True
        goes &= fill < cap
        order = np.argsort(bins, kind="stable")
        run_, first = np.cumsum(sizes[order]) - sizes[order], np.searchsorted(bins[order], np.arange(len(fill)))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = run_ - run_[first][bins[order]]
        for name, column in (("sequence_id", ((round_ << 31 | part) << 28) + bins), ("offset", offset), ("again", goes[bins])):
            table = table.append_column(name, pa.array(column))
        return table

    return run


def pack(pieces: DataFrame, cap: int = LENGTH, stash: Stash | None = None, per_part: int = PIECES) -> DataFrame:
    """The pieces with sequence_id, offset and bound, the number of sequences that no packing of them can go below. Every piece is in one sequence,
    no sequence is longer than cap, none has gaps."""
    stash = stash or Stash(pieces.sparkSession)
    ship(pieces.sparkSession)
    pieces = stash.keep(pieces, "pieces")
    counts = np.zeros(cap + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # cap rows at most
        counts[r["length"]] = r["count"]
    bound, n = lower_bound(counts), int(counts.sum())
    done, left, settled, before, best = [], pieces, 0, None, None
    for r in itertools.count():
        parts = max(LEAST_PARTS, -(-n // per_part)) if r == 0 else max(1, min(-(-n // per_part), before - 1))
        dealt = left.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start", F.monotonically_increasing_id(), F.lit(r)), F.lit(parts)))
        packed = stash.keep(dealt.groupBy("part").applyInArrow(packer(cap, r), PACKED), f"packed{r}")
        tally = packed.groupBy("again").agg(F.countDistinct("sequence_id").alias("bins"), F.count("*").alias("n")).collect()
        open_ = next((t for t in tally if t.again), None)
        total = settled + sum(t.bins for t in tally)
        if open_ is None or total <= bound or parts == 1 or best is not None and total >= best:
            done.append(packed)
            break
        done.append(packed.where("not again"))
        settled += sum(t.bins for t in tally) - open_.bins
        left, n, before, best = packed.where("again").select("doc_id", "piece", "start", "length", "ids_crc32"), open_.n, parts, total
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionAll(d)
    return whole.drop("again").withColumn("bound", F.lit(bound).cast("long"))


def pack_documents(docs: DataFrame, tokenizer: str, end: int, cap: int = LENGTH, stash: Stash | None = None, per_part: int = PIECES) -> DataFrame:
    """One row per piece of every row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset, bound.

    A document is its ids and the end id; null and empty texts have the end id alone. Only documents longer than cap are cut.
    Pieces of one length go by doc_id (nulls last) and piece, so reruns agree on which sequences are full; rows that repeat a doc_id are packed each on
    its own; an empty table gives an empty result; other columns are ignored."""
    return pack(pieces_of(docs, tokenizer, end, cap), cap, stash, per_part)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
