"""Best-fit-decreasing packing of token sequences with a segment tree over remaining capacities."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.tokens import ENCODE_BYTES, crc32, encoder, steps
from claimweave.session import materialize

SEQUENCE_TOKENS = 2048
#: Pieces of one length that one window task numbers.
SALT_ROWS = 200_000


class Slots(NamedTuple):
    """Pieces number ``rank`` to ``rank + count - 1`` of a length go ``per_bin`` to a bin, from bin ``bin`` and ``offset`` on."""

    rank: int
    count: int
    bin: int
    per_bin: int
    offset: int


class CapacityTree:
    """Which remaining capacities have an open bin; finds the smallest one that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, remaining: int, value: bool) -> None:
        node = self.leaves + remaining
        self.open[node] = value
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, needed: int) -> int | None:
        """Smallest remaining capacity of at least ``needed`` with an open bin, in logarithmic time."""
        node = self.leaves + needed
        if self.open[node]:
            return needed
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> dict[int, list[Slots]]:
    """Slots of every length: best-fit decreasing over ``{length: pieces}``.

    Pieces of one length are interchangeable, so one step of the search serves all that go to
    bins of the same remaining capacity: after a piece is placed, its bin is the tightest one as
    long as another piece of the length fits.  The outcome is that of placing one by one,
    the work depends on the number of lengths (at most ``capacity``), not on the pieces.
    """
    tree = CapacityTree(capacity)
    bins: dict[int, list[tuple[int, int]]] = {}
    opened = 0
    slots: dict[int, list[Slots]] = {}

    def put(remaining: int, first: int, count: int) -> None:
        if count and remaining:
            bins.setdefault(remaining, []).append((first, count))
            tree.set(remaining, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        made = slots.setdefault(length, [])
        closed: list[tuple[int, int, int]] = []
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                per_bin = capacity // length
                first, count, remaining = opened, -(-left // per_bin), capacity
                opened += count
            else:
                first, count = bins[remaining].pop()
                if not bins[remaining]:
                    tree.set(remaining, False)
                per_bin = remaining // length
            full = min(count, left // per_bin)
            if full:
                made.append(Slots(rank, full * per_bin, first, per_bin, capacity - remaining))
                closed.append((remaining - per_bin * length, first, full))
                rank += full * per_bin
                left -= full * per_bin
            rest = count - full
            if rest and left:  # fewer pieces than one more bin takes
                made.append(Slots(rank, left, first + full, left, capacity - remaining))
                closed.append((remaining - left * length, first + full, 1))
                full, rest, left = full + 1, rest - 1, 0
            put(remaining if remaining < capacity else 0, first + full, rest)
        for remaining, first, count in closed:
            put(remaining, first, count)
    return slots


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = None,
    capacity: int = SEQUENCE_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document, cut only where it is longer than ``capacity``.

    Null and empty texts are the end id alone; repeated rows give their pieces again.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in steps(batches, limit=ENCODE_BYTES):
            rows: list[tuple] = []
            for doc_id, ids in zip(
                batch.column("doc_id").to_pylist(), encoder(tokenizer).encode(batch.column("text").to_pylist()), strict=True
            ):
                ids += tail
                total = len(ids) >> 2
                for piece, start in enumerate(range(0, total, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, piece, start, len(part) >> 2, crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces of ``length`` 1 to ``capacity``.

    Only the histogram of lengths (at most ``capacity`` rows) goes to the driver.  The pieces of
    a length are numbered in parallel: a length is spread over salts, each salt
    numbers its own, and a table of at most ``capacity x salts`` counts gives the base.
    The slots of a number are found by binary search in at most a few thousand runs per job.
    An empty table gives an empty table; pieces without ids do not exist.
    """
    histogram = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = best_fit_decreasing(histogram, capacity)
    salts = max(1, -(-max(histogram.values(), default=0) // SALT_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_count"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_salt", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("_own", F.row_number().over(own))
        .join(bases, ["length", "_salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_own") - 1).alias("rank"))
    )

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = {length: [s.rank for s in runs] for length, runs in slots.items()}
        for batch in batches:
            sequences, offsets = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                run = slots[length][bisect_right(begins[length], rank) - 1]
                nth, place_in = divmod(rank - run.rank, run.per_bin)
                sequences.append(run.bin + nth)
                offsets.append(run.offset + place_in * length)
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = None, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Cut, store once and pack all documents."""
    return pack(materialize(cut_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
