"""Byte-level language model by context-tree weighting, and a smoothed unigram model of words beside it.

A byte is eight binary decisions.  Each decision has a context tree of its own (one per prefix of bits already known), whose
nodes are the last 0, 1, ... ``depth`` bytes.  A node estimates its bit by Krichevsky-Trofimov counts; its weighted probability
of the training text is the mean of its own and of the product of its children, so all depths are mixed with the
weights that their training text earns.  Upper- and lower-case ASCII letters are one.  A text begins and ends with
byte 255, which UTF-8 does not use.

How it is learned and applied.  Documents are stored in blocks of some megabytes.  A block asks for each distinct run of
``depth`` + 1 bytes, and each distinct word, that occurs in it, and says how often its training documents use it.  Requests
meet by a hash of the run or word, where counts are merged.  Distinct runs then go to tasks by their last two
context bytes, so that a task holds whole subtrees; the two top levels of the tree, at most 257 contexts, are finished on the
driver and broadcast.  Every run's log probability returns to the hash it was merged under, from there to the blocks that
asked, and blocks add up their documents.  Nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import shuffle_width

from .common import shared_folder, texts, to_arrow

BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 4 << 20
PART_BYTES = 16 << 20
MIX = 0x9E3779B97F4A7C15
END = 255
LOG2 = math.log(2.0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A frame written once in the shared folder, well compressed, and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


# ---------------------------------------------------------------- runs of bytes


def runs(bodies: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The run that ends at every byte of every text and at its end sign, and the number of runs per text.

    A run is one number: the last context byte first, then the one before it, ..., the predicted byte last.
    """
    pad = bytes([END]) * depth
    whole = np.frombuffer(pad + pad.join(bodies) + pad, np.uint8).astype(np.uint64)
    sizes = np.array([len(b) for b in bodies], np.int64) + 1
    keys = np.zeros(len(whole) - depth, np.uint64)
    for back in range(1, depth + 1):
        keys <<= np.uint64(8)
        keys |= whole[depth - back : len(whole) - back]
    keys <<= np.uint64(8)
    keys |= whole[depth:]
    keep = np.ones(len(keys), bool)
    ends = np.cumsum(sizes + depth - 1)
    for k in range(1, depth):  # further pads between texts are not predicted
        keep[ends - k] = False
    return keys[keep], sizes


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for numbers of 0.5 or more (Stirling's series after eight steps of the recurrence)."""
    product = x.copy()
    for i in range(1, 8):
        product = product * (x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of some zeros and ones in any one order."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - math.log(math.pi)


class Subtrees:
    """The nodes of some contexts of two bytes and all that lies below them.

    ``keys``: ascending distinct runs; ``counts``: their training occurrences, 0 for runs that only have to be scored.
    """

    TOP = 2

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.keys, self.depth = keys, depth
        self.rows: dict[int, np.ndarray] = {}  # per depth: distinct (context, byte)
        self.at: dict[int, np.ndarray] = {}  # per depth: the row of every run
        self.uses: dict[int, np.ndarray] = {}
        for d in range(depth, self.TOP - 1, -1):
            if d == depth:
                rows, at, uses = keys, np.arange(len(keys)), counts.astype(float)
            else:
                drop = np.uint64(8 * (depth - d + 1))
                rows, at = np.unique((keys >> drop) << np.uint64(8) | keys & np.uint64(255), return_inverse=True)
                uses = np.bincount(at, counts, len(rows))
            self.rows[d], self.at[d], self.uses[d] = rows, at, uses

    def level(self, d: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes that know ``bits`` bits at one depth: their keys, zeros, ones, and each row's node and next bit."""
        rows, uses = self.rows[d], self.uses[d]
        of_row = rows >> np.uint64(8 - bits)
        first = np.append(True, of_row[1:] != of_row[:-1])
        bit = (rows >> np.uint64(7 - bits)) & np.uint64(1)
        node = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        ones, every = np.add.reduceat(uses * bit, starts), np.add.reduceat(uses, starts)
        return of_row[starts], every - ones, ones, node, bit.astype(bool)

    def fold(self, bits: int) -> tuple[np.ndarray, ...]:
        """Bottom up for one number of known bits: nodes at the top depth, zeros, ones, log weighted probability,
        and the mix of the estimates from the deepest to the top depth for every run's next bit."""
        up = shares = None
        found = {}
        for d in range(self.depth, self.TOP - 1, -1):
            nodes, zeros, ones, node, bit = self.level(d, bits)
            own = log_kt(zeros, ones)
            if d == self.depth:
                log_w, stop = own, np.ones(len(nodes))
            else:
                low = np.uint64(bits)
                parent = (up >> np.uint64(8 + bits)) << low | up & np.uint64((1 << bits) - 1)
                below = np.bincount(np.searchsorted(nodes, parent), shares, len(nodes))
                log_w = np.logaddexp(own, below) - LOG2
                stop = np.exp(own - LOG2 - log_w)
            one = (ones + 0.5) / (zeros + ones + 1.0)
            found[d] = (stop[node], np.where(bit, one[node], 1 - one[node]))
            up, shares = nodes, log_w
        mixed = found[self.depth][1]
        for d in range(self.depth - 1, self.TOP - 1, -1):
            stop, estimate = (x[self.at[d]] for x in found[d])
            mixed = stop * estimate + (1 - stop) * mixed
        return nodes, zeros, ones, log_w, mixed

    def top(self) -> tuple[np.ndarray, ...]:
        """Sums for the level above: last byte, node (bits known, with a leading 1), zeros, ones, log weighted probability."""
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for bits in range(8):
            nodes, zeros, ones, log_w, _ = self.fold(bits)
            group = (nodes >> np.uint64(8 + bits)) << np.uint64(8) | np.uint64(1 << bits) | nodes & np.uint64((1 << bits) - 1)
            names, at = np.unique(group, return_inverse=True)
            out[0].append((names >> np.uint64(8)).astype(np.int32))
            out[1].append((names & np.uint64(255)).astype(np.int32))
            for column, x in zip(out[2:], (zeros, ones, log_w)):
                column.append(np.bincount(at, x, len(names)))
        return tuple(np.concatenate(x) for x in out)

    def log10(self, head: Head) -> np.ndarray:
        """Log10 probability of every run's last byte after its context."""
        last = (self.keys >> np.uint64(8 * self.depth)).astype(np.int64)
        byte = (self.keys & np.uint64(255)).astype(np.int64)
        total = np.zeros(len(self.keys))
        for bits in range(8):
            mixed = self.fold(bits)[-1]
            node, bit = (1 << bits) | byte >> (8 - bits), (byte >> (7 - bits) & 1).astype(bool)
            for stop, one in ((head.stop[last, node], head.one[last, node]), (head.root_stop[node], head.root_one[node])):
                mixed = stop * np.where(bit, one, 1 - one) + (1 - stop) * mixed
            total += np.log10(mixed)
        return total


class Head:
    """The two top levels of the tree: per last byte and node, and per node, the weight of stopping and the chance of a one."""

    def __init__(self, rows: list[tuple[int, int, float, float, float]]):
        zeros, ones, below = np.zeros((3, 256, 256))
        for last, node, z, o, b in rows:
            zeros[last, node], ones[last, node], below[last, node] = z, o, b
        self.stop, self.one, log_w = self._mix(zeros, ones, below)
        self.root_stop, self.root_one, _ = self._mix(zeros.sum(axis=0), ones.sum(axis=0), log_w.sum(axis=0))

    @staticmethod
    def _mix(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = log_kt(zeros, ones)
        log_w = np.logaddexp(own, below) - LOG2
        # a node without training text has probability 1 both ways
        empty = zeros + ones == 0
        log_w = np.where(empty, 0.0, log_w)
        return np.where(empty, 0.5, np.exp(own - LOG2 - log_w)), (ones + 0.5) / (zeros + ones + 1.0), log_w


# ---------------------------------------------------------------- packed exchange of keys and values


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys with their summed counts."""
    every = np.concatenate(keys)
    names, at = np.unique(every, return_inverse=True)
    return names, np.bincount(at, np.concatenate(counts), len(names)).astype(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """A well-mixed number below ``parts`` for every key."""
    with np.errstate(over="ignore"):
        mixed = keys * np.uint64(MIX)
    return (mixed >> np.uint64(33)) % np.uint64(parts)


def dealt(keys: np.ndarray, by: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """``(part, keys, values)`` as bytes for every part that occurs in ``by``; ascending keys stay ascending."""
    order = np.argsort(by, kind="stable")
    keys, by, values = keys[order], by[order], values[order]
    starts = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else []
    for a, b in zip(starts, [*starts[1:], len(by)]):
        yield int(by[a]), keys[a:b].tobytes(), values[a:b].tobytes()


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows by their first column, in which the batches are sorted; a group is one part of bounded bytes."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a few megabytes."""
    waiting, size = [], 0

    def send() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)

    for row in rows:
        waiting.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size > CHUNK_BYTES or len(waiting) >= 1000:
            yield send()
            waiting, size = [], 0
    if waiting:
        yield send()


def by_part(df: DataFrame, parts: int, work, ddl: str, *order: str) -> DataFrame:
    """``work(rows)`` of every part, whose results are rows of the DDL; a part is whole in one task."""
    schema = to_arrow(df.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            yield from packed(work(rows), schema)

    return df.repartition(parts, "part").sortWithinPartitions("part", *order).mapInArrow(run, ddl)


def _numbers(blob: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(blob, kind)


# ---------------------------------------------------------------- the model


def blocks(docs: DataFrame) -> DataFrame:
    """``block, doc_id, held_out, body``: lower-cased UTF-8 texts, stored in blocks that follow the input's partitions."""
    ddl = "block long, doc_id long, held_out boolean, body binary"
    schema = to_arrow(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids, held, bodies = batch.columns
            bodies = [(x or b"").lower() for x in bodies.to_pylist()]
            names = []
            for body in bodies:
                if size > BLOCK_BYTES:
                    block, size = block + 1, 0
                names.append(block)
                size += len(body) + 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), ids, held, pa.array(bodies, pa.binary())], schema=schema)

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = texts(docs).select("doc_id", held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, ddl), "blocks")


class _Asked:
    """What a block asks for: runs and words with their training occurrences, folded chunk by chunk."""

    def __init__(self, depth: int):
        self.depth = depth
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.words: Counter = Counter()
        self.waiting: dict[bool, list[bytes]] = {False: [], True: []}
        self.size = {False: 0, True: 0}

    def add(self, body: bytes, held_out: bool) -> None:
        words = body.split()
        if held_out:
            for word in dict.fromkeys(words):
                self.words.setdefault(word, 0)
            self.words.setdefault(b"", 0)
        else:
            self.words.update(words)
            self.words[b""] += 1  # the end of a text; no word is empty
        for at in range(0, max(1, len(body)), CHUNK_BYTES):
            if len(body) <= CHUNK_BYTES:
                self._wait(body, held_out)
            else:
                self._long(body, at, held_out)

    def _wait(self, body: bytes, held_out: bool) -> None:
        self.waiting[held_out].append(body)
        self.size[held_out] += len(body)
        if self.size[held_out] > CHUNK_BYTES:
            self._count(held_out)

    def _long(self, body: bytes, at: int, held_out: bool) -> None:
        """One chunk of a long text with the bytes before it."""
        self._take(long_runs(body, at, self.depth), held_out)

    def _count(self, held_out: bool) -> None:
        if self.waiting[held_out]:
            self._take(runs(self.waiting[held_out], self.depth)[0], held_out)
            self.waiting[held_out], self.size[held_out] = [], 0

    def _take(self, found: np.ndarray, held_out: bool) -> None:
        counts = pa.array(found).value_counts()
        self.keys.append(counts.field(0).to_numpy())
        n = counts.field(1).to_numpy()
        self.counts.append(np.zeros_like(n) if held_out else n)
        if len(self.keys) > 8:
            self._merge()

    def _merge(self) -> None:
        keys, counts = merge(self.keys, self.counts)
        self.keys, self.counts = [keys], [counts]

    def rows(self, block: int, parts: int) -> Iterator[tuple]:
        """``kind, part, block, keys, values``; kind 0 are runs, 1 words."""
        for held_out in (False, True):
            self._count(held_out)
        if self.keys:
            self._merge()
            keys, counts = self.keys[0], self.counts[0]
            for part, k, n in dealt(keys, part_of(keys, parts), counts):
                yield 0, part, block, k, n
        by: dict[int, list[bytes]] = {}
        for word in self.words:
            by.setdefault(zlib.crc32(word) % parts, []).append(word)
        for part, words in by.items():
            yield 1, part, block, b"\n".join(words), np.array([self.words[w] for w in words], np.int64).tobytes()


def long_runs(body: bytes, at: int, depth: int) -> np.ndarray:
    """The runs that end in one chunk of a long text, the end sign with the last one."""
    pad = bytes([END]) * depth
    before = (pad + body[:at])[-depth:] if at < depth else body[at - depth : at]
    chunk = body[at : at + CHUNK_BYTES]
    if at + CHUNK_BYTES < len(body):
        return runs([before + chunk], depth)[0][depth : depth + len(chunk)]
    return runs([before + chunk], depth)[0][depth:]


def requests(blocked: DataFrame, depth: int, parts: int) -> DataFrame:
    ddl = "kind int, part int, block long, keys binary, values binary"
    schema = to_arrow(blocked.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked = None, None

        for batch in batches:
            for name, held_out, body in zip(*(c.to_pylist() for c in batch.columns)):
                if name != block:
                    if asked:
                        yield from packed(asked.rows(block, parts), schema)
                    block, asked = name, _Asked(depth)
                asked.add(body, held_out)
        if asked:
            yield from packed(asked.rows(block, parts), schema)

    return stored(blocked.select("block", "held_out", "body").mapInArrow(run, ddl), "requests")


def learn(asked: DataFrame, depth: int, parts: int) -> DataFrame:
    """Log10 probability of every run that was asked for, packed under the part of its hash: ``part, keys, values``."""
    spark = asked.sparkSession

    def merged(rows: list[tuple]) -> Iterator[tuple]:
        keys, counts = merge([_numbers(r[1]) for r in rows], [_numbers(r[2], np.int64) for r in rows])
        yield from dealt(keys, part_of(keys >> np.uint64(8 * (depth - 1)), parts), counts)

    counted = stored(by_part(asked.where("kind = 0").select("part", "keys", "values"), parts, merged, "part int, keys binary, values binary"), "runs")

    def top(rows: list[tuple]) -> Iterator[tuple]:
        keys, counts = merge([_numbers(r[1]) for r in rows], [_numbers(r[2], np.int64) for r in rows])
        yield tuple(x.tolist() for x in Subtrees(keys, counts, depth).top())

    packed = by_part(counted, parts, top, "last array<long>, node array<long>, zeros array<double>, ones array<double>, below array<double>")
    rows = packed.select(F.explode(F.arrays_zip("last", "node", "zeros", "ones", "below")).alias("x")).select("x.*")
    sums = rows.groupBy("last", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    head = spark.sparkContext.broadcast(Head([tuple(r) for r in sums.collect()]))  # at most 256 x 255 rows

    def scored(rows: list[tuple]) -> Iterator[tuple]:
        keys, counts = merge([_numbers(r[1]) for r in rows], [_numbers(r[2], np.int64) for r in rows])
        yield from dealt(keys, part_of(keys, parts), Subtrees(keys, counts, depth).log10(head.value))

    return by_part(counted, parts, scored, "part int, keys binary, values binary")


def answers(asked: DataFrame, learned: DataFrame, parts: int) -> DataFrame:
    """The log probabilities of each block's runs: ``block, kind, keys, values``."""

    def look_up(rows: list[tuple]) -> Iterator[tuple]:
        own = [r for r in rows if r[2] is None]  # sorted before the requests
        keys = np.concatenate([_numbers(r[3]) for r in own])
        logs = np.concatenate([_numbers(r[4], np.float64) for r in own])
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        for r in rows[len(own) :]:
            yield r[2], 0, r[3], logs[np.searchsorted(keys, _numbers(r[3]))].tobytes()

    both = learned.select("part", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("block"), "keys", "values").unionByName(
        asked.where("kind = 0").select("part", F.lit(1).alias("rank"), "block", "keys", "values")
    )
    return by_part(both, parts, look_up, "block long, kind int, keys binary, values binary", "rank")


def word_answers(asked: DataFrame, parts: int) -> DataFrame:
    """Training counts of each block's words, ``block, kind, keys, values``; rows without a block hold a part's
    number of training tokens and of distinct training words."""

    def count(rows: list[tuple]) -> Iterator[tuple]:
        total: Counter = Counter()
        for _, _, words, uses in rows:
            for word, n in zip(words.split(b"\n"), _numbers(uses, np.int64).tolist()):
                total[word] += n
        for _, block, words, _ in rows:
            yield block, 1, words, np.array([total[w] for w in words.split(b"\n")], np.int64).tobytes()
        yield None, 1, b"", np.array([sum(total.values()), sum(map(bool, total.values()))], np.int64).tobytes()

    words = asked.where("kind = 1").select("part", "block", "keys", "values")
    return stored(by_part(words, parts, count, "block long, kind int, keys binary, values binary"), "words")


class _Block:
    """Answers of one block, then the scores of its documents."""

    def __init__(self, depth: int, tokens: int, distinct: int):
        self.depth, self.tokens, self.below = depth, tokens, tokens + 0.5 * (distinct + 1)
        self.keys: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.words: dict[bytes, float] = {}
        self.unknown = math.log10(0.5 / self.below)

    def answer(self, kind: int, keys: bytes, values: bytes) -> None:
        if kind == 0:
            self.keys.append(_numbers(keys))
            self.logs.append(_numbers(values, np.float64))
        else:
            logs = np.log10((_numbers(values, np.int64) + 0.5) / self.below)
            self.words.update(zip(keys.split(b"\n"), np.where(_numbers(values, np.int64) == 0, self.unknown, logs).tolist()))

    def _sorted(self) -> None:
        if len(self.keys) > 1:
            keys, logs = np.concatenate(self.keys), np.concatenate(self.logs)
            order = np.argsort(keys)
            self.keys, self.logs = [keys[order]], [logs[order]]

    def logs_of(self, found: np.ndarray) -> np.ndarray:
        self._sorted()
        return self.logs[0][np.searchsorted(self.keys[0], found)]

    def scores(self, bodies: list[bytes]) -> list[float]:
        """Log10 probability of each text with its end sign; a long text goes chunk by chunk."""
        out = [0.0] * len(bodies)
        short: list[int] = []
        size = 0

        def flush() -> None:
            if short:
                found, sizes = runs([bodies[i] for i in short], self.depth)
                starts = np.append(0, np.cumsum(sizes)[:-1])
                for i, x in zip(short, np.add.reduceat(self.logs_of(found), starts).tolist()):
                    out[i] = x
                short.clear()

        for i, body in enumerate(bodies):
            if len(body) > CHUNK_BYTES:
                out[i] = math.fsum(float(self.logs_of(long_runs(body, at, self.depth)).sum()) for at in range(0, len(body), CHUNK_BYTES))
                continue
            short.append(i)
            size += len(body)
            if size > CHUNK_BYTES:
                flush()
                size = 0
        flush()
        return out

    def base(self, body: bytes) -> tuple[int, int, float]:
        """Tokens, known tokens and the unigram score of a text."""
        words = body.split()
        words.append(b"")
        logs = list(map(self.words.__getitem__, words))
        return len(logs), len(logs) - logs.count(self.unknown), sum(logs)


def score_documents(docs: DataFrame, depth: int = 4) -> DataFrame:
    """Unigram and context-tree scores of every document.

    Columns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` and ``bits_per_byte``, the code length of
    the text with its end sign.  A document is held out, that is not learned from, when crc32 of its id as text leaves 1
    modulo 5; a null id is never held out.  A null text is empty: one token, its end.  Repeated rows count each.
    Without training documents every token is equally likely and every bit costs one bit.  Extra columns are ignored.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7 bytes")
    spark = docs.sparkSession
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    schema = to_arrow(spark, ddl)
    blocked = blocks(docs)
    size = blocked.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = max(shuffle_width(spark), size // PART_BYTES + 1)
    asked = requests(blocked, depth, parts)
    words = word_answers(asked, parts)
    totals = words.where("block is null").select("values")
    found = totals.mapInArrow(_totals, "tokens long, distinct_words long").agg(F.sum("tokens"), F.sum("distinct_words")).first()
    tokens, distinct = found[0] or 0, found[1] or 0

    none = F.lit(None)
    rows = (
        answers(asked, learn(asked, depth, parts), parts)
        .unionByName(words.where("block is not null"))
        .select("block", "kind", none.cast("long").alias("doc_id"), none.cast("boolean").alias("held_out"), "keys", "values")
        .unionByName(blocked.select("block", F.lit(2).alias("kind"), "doc_id", "held_out", F.col("body").alias("keys"), none.cast("binary").alias("values")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block = None, None
        for batch in batches:
            texts_of: list[tuple] = []

            def send() -> Iterator[pa.RecordBatch]:
                if texts_of:
                    ids, held, bodies = zip(*texts_of)
                    base, scores = [block.base(b) for b in bodies], block.scores(list(bodies))
                    n, known, sums = zip(*base)
                    per_byte = [-s / (math.log10(2) * (len(b) + 1)) for s, b in zip(scores, bodies)]
                    columns = [ids, held, n, known, [tokens] * len(ids), sums, scores, per_byte]
                    texts_of.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

            for at, kind, key, held_out, keys, values in zip(*(c.to_pylist() for c in batch.columns)):
                if at != name:
                    yield from send()
                    name, block = at, _Block(depth, tokens, distinct)
                if kind < 2:
                    block.answer(kind, keys, values)
                else:
                    texts_of.append((key, held_out, keys))
            yield from send()

    return rows.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(run, ddl)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [_numbers(x, np.int64).tolist() for x in batch.column(0).to_pylist()]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*pairs)], names=["tokens", "distinct_words"])
