"""Near-duplicate documents: HyperMinHash sketches, banded registers, exact confirmation.

1. A text becomes its words, the words their distinct shingles, the shingles 64-bit hashes.  The top bits of a
   hash pick a register; a register keeps the smallest remainder in compressed form, the number of leading
   zeros and the next ten bits.  An empty register borrows from another by a fixed rule, so that the
   chance that two documents agree in a register stays their Jaccard similarity.
2. Texts with equal words are one node from here on, however many rows they have.
3. Four registers make a band.  With 32 bands a pair at similarity 0.85 misses all of them with probability
   6e-11, at 0.80 with 5e-8.
4. Nodes that share a band are likely copies if the similarity estimated from all registers, less the matches
   expected by chance, comes within six standard deviations of the threshold.  Each band is compared with
   one pivot first; only bands whose nodes are then still apart are compared in blocks, and a block
   reports no more pairs than it takes to join its nodes.  Nodes joined this way are a group: it
   holds both ends of every link, and copies of one text never give all their pairs.
5. Inside a group the full shingle sets decide: a block of at most 2 * BLOCK texts becomes a 0/1 matrix of texts by
   shingles, whose product with itself gives all intersections at once.  Again a block reports only links that
   join what was apart.  Blocks of one hash part come first, pairs of parts only where a large group is not yet one component.
6. Links make components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import store

from .common import DOCUMENT_COLUMNS, map_batches, texts, to_arrow
from .components import connected_components

REGISTERS, BUCKET_BITS, ROWS, BANDS = 128, 7, 4, 32
MANTISSA = 10
BLOCK = 512
WIDTH = 4096
PRIME = np.uint64(0x9E3779B185EBCA87)
_BORROW = np.random.RandomState(7).randint(0, REGISTERS, (REGISTERS, 4096))


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space."""
    return text.encode().lower().split() if text else []


def shingles(words: list[bytes], size: int) -> set[tuple]:
    """Distinct runs of ``size`` words; all words as one run when there are fewer."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    size = min(size, n)
    with np.errstate(over="ignore"):
        run = each[: n - size + 1].copy()
        for i in range(1, size):
            run = run * PRIME + each[i : n - size + 1 + i]
        run = (run ^ (run >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        run = (run ^ (run >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return np.unique(run ^ (run >> np.uint64(33)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16: leading zeros, then mantissa) of a sorted, non-empty hash set."""
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = (hashes[first] << np.uint64(BUCKET_BITS)) | np.uint64((1 << BUCKET_BITS) - 1)
    zeros = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros = np.where((rest >> (63 - np.clip(zeros, 0, 63)).astype(np.uint64)) == 0, zeros + 1, zeros)
    shifted = rest << (np.clip(zeros, 0, 62) + 1).astype(np.uint64)
    value = (np.clip(zeros, 0, 62) << MANTISSA) | (shifted >> np.uint64(64 - MANTISSA)).astype(np.int64)
    out = np.full(REGISTERS, -1, np.int64)
    out[bucket[first]] = value
    filled = out >= 0
    empty = np.flatnonzero(~filled)
    step = 0
    while len(empty):
        source = _BORROW[empty, step]
        hit = filled[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
        step += 1
        if step == _BORROW.shape[1]:  # not reached in practice; any fixed rule will do
            out[empty] = out[np.flatnonzero(filled)[0]]
            break
    return out.astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (last axis), less the share that agrees by chance.

    Two unrelated minima agree with probability 0.17 / 2**10 when the sets are of like size, less otherwise; the
    larger value is subtracted.
    """
    chance = 0.16991949 / (1 << MANTISSA)
    same = (a == b).mean(axis=-1)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """Per row: id, a hash that finds its text again, key of its words, number of shingles, registers as 32 longs.

    A null text, or one without words, has no key and no registers.
    """

    def work(columns: dict[str, list]) -> Iterator[dict[str, list]]:
        keys, counts, sketches = [], [], []
        for text in columns["text"]:
            words = words_of(text)
            hashes = shingle_hashes(words, size)
            counts.append(len(hashes))
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
            sketches.append(registers(hashes).view(np.int64).tolist() if words else None)
        yield {"doc_id": columns["doc_id"], "tie": columns["tie"], "key": keys, "n_shingles": counts, "regs": sketches}

    schema = "doc_id long, tie long, key binary, n_shingles long, regs array<long>"
    return map_batches(texts(docs, F.xxhash64("text").alias("tie")), work, schema)


def _likely(pairs: DataFrame, nodes: DataFrame, cutoff: float) -> DataFrame:
    """The pairs whose estimated similarity reaches ``cutoff``."""
    sides = [nodes.select(F.col("key").alias(s), F.col("regs").alias(f"regs_{s}")) for s in "ab"]

    def work(columns: dict[str, list]) -> Iterator[dict[str, list]]:
        left, right = (np.array(columns[f"regs_{s}"], np.int64).view(np.uint16) for s in "ab")
        good = np.flatnonzero(estimate(left, right) >= cutoff)
        yield {s: [columns[s][i] for i in good] for s in "ab"}

    return map_batches(pairs.join(sides[1], "b").join(sides[0], "a"), work, "a binary, b binary")


def _joining(linked: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Of the pairs set in a matrix, those that join nodes whose labels differ, until none is left.

    ``rows`` names the matrix's rows where it does not have all.
    """
    labels = labels.copy()
    for at, i in enumerate(range(len(labels)) if rows is None else rows.tolist()):
        for j in np.flatnonzero(linked[at]):
            if labels[j] != labels[i]:
                yield i, int(j)
                labels[labels == labels[j]] = labels[i]


def _by_group(rows: DataFrame, compare, keys: int) -> DataFrame:
    """Pairs from ``compare`` over each run of rows with equal first ``keys`` columns; the rows are dealt and sorted by these."""
    names = rows.columns[:keys]
    schema = to_arrow(rows.sparkSession, "a binary, b binary")

    def batch_of(group: list[tuple]) -> pa.RecordBatch:
        pairs = list(compare(group)) if len(group) > 1 else []
        return pa.RecordBatch.from_pydict({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][:keys] != row[:keys]:
                    yield batch_of(group)
                    group = []
                group.append(row)
        if group:
            yield batch_of(group)

    dealt = rows.repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "a binary, b binary")


def _in_blocks(rows: DataFrame, of: str, size: str, other) -> DataFrame:
    """Deals the ``size`` rows of each ``of`` into parts by a hash of the key and pairs the parts as ``other`` says."""
    rows = rows.withColumn("parts", F.ceil(F.col(size) / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", other)
    return rows.select(of, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "key", "label", *(c for c in ("regs", "text") if c in rows.columns))


def _apart(rows: DataFrame, links: DataFrame, of: str) -> DataFrame:
    """The rows of every ``of`` whose keys are in several components, with ``label`` (component) and ``n`` (rows)."""
    parts = connected_components(links).withColumnsRenamed({"node": "key", "component": "label"})
    rows = rows.drop("label").join(parts, "key", "left").withColumn("label", F.coalesce("label", "key"))
    ends = rows.groupBy(of).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
    return rows.drop("n").join(ends.where("lo <> hi").select(of, "n"), of)


def _to_pivot(members: DataFrame) -> DataFrame:
    """Pairs of each band's pivot and every other member, dealt by the latter, which is in no more than BANDS of them."""
    pairs = members.where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    return pairs.repartition("b").distinct()


def _likely_joins(members: DataFrame, nodes: DataFrame, cutoff: float) -> DataFrame:
    """Likely pairs that join what is apart in a band."""

    def compare(group: list[tuple]) -> Iterator[tuple]:
        labels = np.unique([g[5] for g in group], return_inverse=True)[1]
        if labels.max():
            own = np.array([g[3] for g in group])
            regs = np.array([g[6] for g in group], np.int64).view(np.uint16)
            few = np.flatnonzero(labels != np.bincount(labels).argmax())  # every pair of unequal labels has an end here
            linked = np.stack([estimate(r, regs) >= cutoff for r in regs[few]])
            if group[0][1] != group[0][2]:
                linked &= own[few, None] != own
            yield from ((group[i][4], group[j][4]) for i, j in _joining(linked, labels, few))

    every = F.explode(F.expr("sequence(0, parts - 1)"))
    return _by_group(_in_blocks(members.join(nodes.select("key", "regs"), "key"), "band", "n", every), compare, 3).distinct()


def _links(bodies: DataFrame, size: int, percent: int, other) -> DataFrame:
    """Links with 100 * intersection >= percent * union on full shingle sets that join what is apart in a group."""

    def compare(group: list[tuple]) -> Iterator[tuple]:
        labels = np.unique([g[5] for g in group], return_inverse=True)[1]
        if labels.max():
            sets = [shingle_hashes(words_of(g[6]), size) for g in group]
            sizes = np.array([len(x) for x in sets])
            common = intersections(sets)
            linked = 100 * common >= percent * (sizes[:, None] + sizes - common)
            if group[0][1] != group[0][2]:
                own = np.array([g[3] for g in group])
                linked &= own[:, None] != own
            yield from ((group[i][4], group[j][4]) for i, j in _joining(linked, labels))

    return _by_group(_in_blocks(bodies, "group", "n", other), compare, 3)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of hash sets, by products of 0/1 matrices of bounded width."""
    columns, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    out = np.zeros((len(sets), len(sets)))
    edges = np.searchsorted(place, np.arange(0, len(columns) + WIDTH, WIDTH))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        part = np.zeros((len(sets), WIDTH), np.float32)
        part[rows[a:b], place[a:b] - k * WIDTH] = 1
        part = part[:, part.sum(0) > 1]
        out += part @ part.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, tie: str | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and ``class_key`` (null without words).

    ``component_id`` is the smallest id reachable over links, itself included; a text without words is linked
    with nothing.  A null id counts only where its whole component has no other; such rows are kept with a null
    component.  Rows that share an id are rows of their own.  ``tie`` adds the row's text hash under that name.
    """
    threshold = percent / 100
    cutoff = threshold - 6 * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    rows = store(sketch(docs, size))
    nodes = store(
        rows.where("key is not null")
        .groupBy("key")
        .agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "tie")).alias("spot"), F.first("regs").alias("regs"))
    )
    bands = nodes.select("key", "first_id", F.posexplode("regs").alias("j", "v"))
    rank = F.struct(F.coalesce("first_id", F.lit(2**63 - 1)), "key")
    bands = bands.select(F.xxhash64("j", "v").alias("band"), "key", rank.alias("rank"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("rank")["key"].alias("pivot")).where("n > 1").drop("n")
    members = store(bands.drop("rank").join(shared, "band"))
    likely = store(_likely(_to_pivot(members), nodes, cutoff))
    still = store(_apart(members.drop("pivot"), likely, "band"))
    likely = likely.union(_likely_joins(still, nodes, cutoff))
    groups = connected_components(likely).withColumnsRenamed({"node": "key", "component": "group"})

    null = F.lit(-(2**63))
    spots = nodes.join(groups, "key").select("key", "group", F.coalesce("spot.doc_id", null).alias("doc_id"), "spot.tie")
    spots = spots.join(groups.groupBy("group").agg(F.count("*").alias("n")), "group")
    bodies = texts(docs, F.xxhash64("text").alias("tie")).withColumn("doc_id", F.coalesce("doc_id", null))
    bodies = bodies.join(spots, ["doc_id", "tie"]).select("key", "group", "n", "text", F.col("key").alias("label"))
    bodies = store(bodies.dropDuplicates(["key"]))
    links = store(_links(bodies, size, percent, F.col("own")))
    if not (large := bodies.where(F.col("n") > BLOCK)).isEmpty():
        large = store(_apart(large, links, "group"))
        others = F.explode(F.expr("filter(sequence(0, parts - 1), x -> x <> own)"))
        links = store(links.union(_links(large, size, percent, others)))

    parts = connected_components(links)
    members = parts.join(nodes.select(F.col("key").alias("node"), "first_id"), "node")
    least = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = members.join(least, "component").select(F.col("node").alias("key"), F.col("component").alias("class_key"), "component_id")
    names = nodes.select("key", "first_id").join(linked, "key", "left")
    names = names.select("key", F.coalesce("class_key", "key").alias("class_key"), F.coalesce("component_id", "first_id").alias("component_id"))
    found = rows.drop("regs").join(names, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "class_key", *([F.col("tie").alias(tie)] if tie else []))
    return out


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents less all but one row of every group of near copies; columns of ``documents``."""
    found = near_duplicates(docs, size, percent, "tie").where("kept").drop("n_shingles", "component_id", "kept")
    single = found.where("class_key is null").drop("class_key")
    single = single.union(found.where("class_key is not null").groupBy("class_key", "doc_id").agg(F.min("tie").alias("tie")).drop("class_key"))
    single = single.dropDuplicates(["doc_id", "tie"]).withColumnsRenamed({"doc_id": "kept_id", "tie": "kept_tie"})
    own = docs.select(*DOCUMENT_COLUMNS).withColumn("tie", F.xxhash64(F.col("text").cast("string")))
    chosen = own.join(single, own["doc_id"].eqNullSafe(single["kept_id"]) & (own["tie"] == single["kept_tie"]))
    return chosen.dropDuplicates(["doc_id", "tie"]).select(*DOCUMENT_COLUMNS)
