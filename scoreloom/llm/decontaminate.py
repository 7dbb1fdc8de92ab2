"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so the similarity of the two whole sets says little.  Items are
partitioned by size: an item of up to c shingles (c = 16, 32, 64, ...) is searched in windows of 2 c shingles taken every c
shingles, one of which holds any passage of that length whole.  An item of at least c / 2 distinct shingles that a window
contains to 0.8 then has a similarity of at least 0.19 with it, and one of 64 minima agrees but for one case in 700,000.
The minima of larger windows are minima over smaller ones, so a document's shingles are hashed once for all sizes.  Items
with fewer distinct shingles, short or repetitive ones, are looked up shingle by shingle.

Candidates are confirmed by exact containment: distinct shingles of the item that the whole document holds, at least
``percent`` of all.  Items are taken in blocks of bounded size; each block is one pass over the documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import store

from .common import DOCUMENT_COLUMNS, texts, to_arrow
from .neardup import PRIME, shingles

HASHES, BASE = 64, 16
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
TOGETHER = 400_000
_ODD = np.random.RandomState(11).randint(0, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and white space separate them."""
    return text.encode().translate(_TABLE).split() if text else []


def run_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words, in text order; none if the text is shorter."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        run = each[:n].copy()
        for i in range(1, size):
            run = run * PRIME + each[i : n + i]
        return (run ^ (run >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES x chunks: smallest value of each hash function in each chunk."""
    out = np.empty((HASHES, len(starts)), np.uint32)
    with np.errstate(over="ignore"):
        for i, odd in enumerate(_ODD):
            out[i] = np.minimum.reduceat(((hashes * odd) >> np.uint64(32)).astype(np.uint32), starts)
    return out


class Items:
    """One block of test items: exact shingles, and per size class the minima that lead to them."""

    def __init__(self, rows: list[tuple], size: int):
        self.size = size
        self.ids = [r[0] for r in rows]
        self.sets, self.lengths = [], []
        self.few: dict[int, dict[int, list[int]]] = {}
        self.clashes: dict[int, int] = {}
        by_class: dict[int, list[int]] = {}
        signatures = {}
        for i, (_, text) in enumerate(rows):
            words = words_of(text)
            width = min(size, len(words))
            self.sets.append(shingles(words, size))
            self.lengths.append(width)
            if not words:
                continue
            hashes = run_hashes(words, width)
            level = max(BASE, 1 << (len(hashes) - 1).bit_length())
            if 2 * len(self.sets[i]) < level:
                distinct = np.unique(hashes).tolist()
                self.clashes[i] = len(self.sets[i]) - len(distinct)
                for h in distinct:
                    self.few.setdefault(width, {}).setdefault(h, []).append(i)
                continue
            by_class.setdefault(level, []).append(i)
            signatures[i] = minima(hashes, np.array([0]))[:, 0]
        self.classes = {}
        for level, members in sorted(by_class.items()):
            table = np.stack([signatures[i] for i in members])  # items x hashes
            order = np.argsort(table, axis=0, kind="stable")
            seen = np.zeros((HASHES, 1 << 16), bool)
            for j in range(HASHES):
                seen[j, table[:, j] & 0xFFFF] = True
            self.classes[level] = (np.array(members), table, order, seen)


def candidates(items: Items, hashes: np.ndarray, lengths: np.ndarray) -> set[tuple[int, int]]:
    """``(document, item)`` of documents laid end to end, ``lengths`` shingles each, whose windows share a minimum."""
    found: set[tuple[int, int]] = set()
    if not items.classes or not len(hashes):
        return found
    chunks = -(-lengths // BASE)
    owner = np.repeat(np.arange(len(lengths)), chunks)
    first = np.cumsum(chunks) - chunks
    starts = (np.cumsum(lengths) - lengths)[owner] + (np.arange(len(owner)) - first[owner]) * BASE
    values, level = minima(hashes, starts), BASE
    top = max(items.classes)
    while True:
        if level in items.classes:
            members, table, order, seen = items.classes[level]
            windows = values.copy()
            same = owner[1:] == owner[:-1]
            windows[:, :-1] = np.where(same, np.minimum(values[:, :-1], values[:, 1:]), values[:, :-1])
            for j in range(HASHES):
                hit = np.flatnonzero(seen[j, windows[j] & 0xFFFF])
                if not len(hit):
                    continue
                column = table[order[:, j], j]
                lo, hi = (np.searchsorted(column, windows[j, hit], side) for side in ("left", "right"))
                for w, a, b in zip(hit[lo < hi], lo[lo < hi], hi[lo < hi]):
                    found.update((int(owner[w]), int(members[m])) for m in order[a:b, j])
        if level >= top:
            return found
        count = np.bincount(owner, minlength=len(lengths))
        place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        heads = np.flatnonzero(place % 2 == 0)
        values, owner, level = np.minimum.reduceat(values, heads, axis=1), owner[heads], level * 2


def search(items: Items, bodies: list[str | None], percent: int) -> list[tuple[int, int, int, int]]:
    """``(document, item, shared shingles, item's shingles)`` of all pairs that reach the containment."""
    out = []
    words = [words_of(t) for t in bodies]
    hashes = [run_hashes(w, items.size) for w in words]
    filled = [i for i, h in enumerate(hashes) if len(h)]
    pairs: set[tuple[int, int]] = set()
    if filled:
        joined = np.concatenate([hashes[i] for i in filled])
        pairs = {(filled[d], m) for d, m in candidates(items, joined, np.array([len(hashes[i]) for i in filled]))}
    for width, table in items.few.items():
        keys = np.array(sorted(table), np.uint64)
        for d, w in enumerate(words):
            own = hashes[d] if width == items.size else run_hashes(w, width)
            shared = Counter(m for h in np.unique(own[np.isin(own, keys)]).tolist() for m in table[h])
            pairs.update((d, m) for m, n in shared.items() if 100 * (n + items.clashes[m]) >= percent * len(items.sets[m]))
    last, whole = None, {}
    for d, m in sorted(pairs):
        if d != last:
            last, whole = d, {}
        width = items.lengths[m]
        if width not in whole:
            whole[width] = set(zip(*(words[d][i:] for i in range(width))))
        shared = len(items.sets[m] & whole[width])
        if shared and 100 * shared >= percent * len(items.sets[m]):
            out.append((d, m, shared, len(items.sets[m])))
    return out


def _parts(bodies: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of a batch of bounded total length; a long text is a run of its own."""
    start = size = 0
    for i, text in enumerate(bodies):
        size += len(text or "") // 6
        if size >= TOGETHER:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(bodies):
        yield start, len(bodies)


def item_blocks(benchmark: DataFrame, size: int) -> Iterator[Items]:
    """The items in blocks of at most about BLOCK_ITEMS rows and BLOCK_BYTES of text, by a hash of the row."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    count, length = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-count // BLOCK_ITEMS), -(-length // BLOCK_BYTES))
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()
        yield Items(sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0], r[1] or "")), size)


LEAKS = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document and test item that it holds; documents without one are not in the result.

    A null or empty text, of a document or an item, matches nothing; an item of fewer words than a shingle is one
    shingle.  Repeated rows and null ids are reported like any other.
    """
    schema = to_arrow(docs.sparkSession, LEAKS)
    found = None
    for items in item_blocks(benchmark, size):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, bodies = (c.to_pylist() for c in batch.columns)
                for a, b in _parts(bodies):
                    hits = search(items, bodies[a:b], percent)
                    rows = [(ids[a + d], items.ids[m], shared, n, shared / n) for d, m, shared, n in hits]
                    if rows:
                        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))), schema=schema)

        part = texts(docs).mapInArrow(run, LEAKS)
        found = part if found is None else found.union(part)
    return found


def drop_leaked(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that hold no test item; columns of ``documents``."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    for n, items in enumerate(item_blocks(benchmark, size)):
        if n:
            docs = store(docs)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bodies = batch.column("text").to_pylist()
                leaked = {a + d for a, b in _parts(bodies) for d, *_ in search(items, bodies[a:b], percent)}
                if clean := [i for i in range(len(bodies)) if i not in leaked]:
                    yield batch.take(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
