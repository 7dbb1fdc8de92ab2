"""Packing token streams into windows by Karmarkar-Karp multiway differencing.

Each task packs the documents it has read, group by group; nothing is shuffled.  A group is filled to a
little less than ``windows`` full windows by cutting its last document; its pieces are then spread over
the windows by differencing, which leaves the windows nearly equal.  Should a window exceed the capacity,
the group takes one window more and is spread again.  What is left at the end of a task is packed the same
way into as many windows as it nearly fills, and a remainder shorter than a window is cut into lengths
that are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import texts, to_arrow
from .encoder import encoder, vocabulary

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Spread items over ``k`` bins: which items each bin gets (Karmarkar-Karp, k-way).

    A partial partition is k sums in ascending order.  The two whose sums differ most are merged again and
    again, the largest sum of one with the smallest of the other, so that opposing imbalances cancel.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, [None] * (k - 1) + [(i, None, None)]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        total = a + b[::-1]
        order = np.argsort(total, kind="stable")
        bins = [x if y is None else y if x is None else (None, x, y) for x, y in zip(left, reversed(right))]
        total, tick = total[order], tick + 1
        heapq.heappush(heap, (int(total[0] - total[-1]), tick, total, [bins[j] for j in order]))
    out = []
    for tree in heap[0][3] if heap else [None] * k:
        items, stack = [], [tree]
        while stack:
            if (node := stack.pop()) is not None:
                if node[0] is not None:
                    items.append(node[0])
                else:
                    stack += node[1:]
        out.append(sorted(items))
    return out


def spread(sizes: list[int], k: int, capacity: int) -> list[list[int]]:
    """Bins of at most ``capacity``: at least ``k``, one more until every bin fits.  Empty bins are left out."""
    while True:
        bins = difference(sizes, k)
        if max((sum(sizes[i] for i in b) for b in bins), default=0) <= capacity:
            return [b for b in bins if b]
        k += 1


class Packer:
    """Takes documents one after another and returns finished groups of (piece, window, offset)."""

    def __init__(self, capacity: int, windows: int, slack: int):
        self.capacity, self.windows, self.full = capacity, windows, capacity - slack
        self.pieces: list[tuple] = []
        self.total = self.sequence = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        at, n = 0, len(ids)
        while at < n:
            take = min(self.capacity, n - at, self.windows * self.full - self.total)
            self.pieces.append((key, at, ids[at : at + take], n))
            self.total += take
            at += take
            if self.total == self.windows * self.full:
                yield from self._place(self.pieces, self.windows)
                self.pieces, self.total = [], 0

    def finish(self) -> Iterator[tuple]:
        """The last group: windows it nearly fills, then a remainder in powers of two."""
        k = self.total // self.full
        rest, tail = self.total - k * self.full, []
        while rest:
            key, at, ids, n = self.pieces.pop()
            take = min(rest, len(ids))
            tail.append((key, at + len(ids) - take, ids[len(ids) - take :], n))
            if take < len(ids):
                self.pieces.append((key, at, ids[:-take], n))
            rest -= take
        if self.pieces:
            yield from self._place(self.pieces, k)
        tail.reverse()
        left = sum(len(p[2]) for p in tail)
        while left:
            room = length = 1 << (left.bit_length() - 1)
            if length > self.capacity:
                room = length = self.capacity
            offset = 0
            while room:
                key, at, ids, n = tail.pop(0)
                take = min(room, len(ids))
                yield (key, at, ids[:take], n, self.sequence, offset)
                if take < len(ids):
                    tail.insert(0, (key, at + take, ids[take:], n))
                room, offset = room - take, offset + take
            self.sequence += 1
            left -= length

    def _place(self, pieces: list[tuple], k: int) -> Iterator[tuple]:
        for items in spread([len(p[2]) for p in pieces], k, self.capacity):
            offset = 0
            for i in items:
                yield (*pieces[i], self.sequence, offset)
                offset += len(pieces[i][2])
            self.sequence += 1


def pack_documents(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 2, capacity: int = 4096, windows: int = 192, slack: int = 8) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit), window and place in it.

    A null or empty text is the end id alone; a null ``doc_id`` and repeated rows are packed like any other.  ``sequence_id`` is
    the number of the input partition times 2**32 plus a count, so a task that is run again gives the same.
    """
    path = vocabulary_path or vocabulary("word_bpe_49k.json")
    schema = to_arrow(docs.sparkSession, PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, words = Packer(capacity, windows, slack), encoder(path, False)
        first = TaskContext.get().partitionId() << 32

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            keys, starts, ids, totals, sequences, offsets = zip(*rows)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": keys, "start": starts, "length": [len(x) for x in ids], "ids": [x.tobytes() for x in ids],
                    "doc_tokens": totals, "sequence_id": [first + s for s in sequences], "offset": offsets,
                },
                schema=schema,
            )

        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.append(np.frombuffer(words.encode(text), np.uint32), np.uint32(end_id))
                if rows := list(packer.add(key, ids)):
                    yield batch_of(rows)
        if rows := list(packer.finish()):
            yield batch_of(rows)

    return texts(docs).mapInArrow(run, PIECES)


def packing_rows(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    pieces = pack_documents(docs, vocabulary_path)
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
