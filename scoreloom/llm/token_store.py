"""Token ids in binary shard files with a minimal perfect hash index.

A shard file holds, in this order:

* payload: the ids of its documents one after another, raw little-endian, 2 or 4 bytes each;
* directory: per document the key (int64), whether it has one (uint8), and the first id (uint64, one more
  entry for the end);
* index: per level a bit array in words of 64 and the rank of every word; a key's level and the rank of its
  bit give its slot;
* slots: a fingerprint (uint32) and the directory row (uint32) of each key;
* footer: JSON with the counts and the place of every section, its length (uint32) and ``IDSHARD1``.

The index is built level by level: every key sets one bit of an array twice as large as the keys left;
keys that are alone on their bit stay, the others go to the next level with another hash.  The rank of a
key's bit among all set bits is its slot, so n keys fill exactly n slots and a lookup reads a constant
expected number of bits.  A key that was never stored is refused by its fingerprint.

``manifest.json`` in the folder is written last and names the shards with the first and last key of each, so
a store can be opened again: a key's range gives its shard, the shard's index its place, and a single look-up
reads a handful of numbers from the file, whatever its size.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.session import shuffle_width

from .common import shared_folder, texts, to_arrow
from .encoder import encoder, vocabulary

MAGIC = b"IDSHARD1"
MANIFEST = "shard long, file string, docs long, keys long, ids long, first long, last long"
MANIFEST_FILE = "manifest.json"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
READ_ROWS = 4096
READ_IDS = 2**24
SHARD_BYTES = 2**30  # text per shard: bounds the keys a writer holds
FEW = 16


def mix64(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over seeded keys; wraps silently."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys with a stored fingerprint per slot."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]], fingerprints: np.ndarray):
        self.levels = levels  # number of bits, words, slots before each word
        self.fingerprints = fingerprints

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels, base = keys, [], 0
        while len(left):
            size = max(64, 2 * len(left))
            place = mix64(left, len(levels)) % np.uint64(size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            words = np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view("<u8")
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            levels.append((size, words, (base + np.append(0, ones[:-1])).astype("<u4")))
            base += int(ones[-1])
            left = left[~alone[place.astype(np.int64)]]
        index = cls(levels, np.zeros(len(keys), np.uint32))
        index.fingerprints[index._slots(keys)] = cls._fingerprint(keys)
        return index

    @staticmethod
    def _fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix64(keys, 1000) >> np.uint64(32)).astype(np.uint32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            place = mix64(keys[open_], level) % np.uint64(size)
            at, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            word = words[at]
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            slots[open_[hit]] = ranks[at[hit]] + np.bitwise_count(below).astype(np.int64)
            open_ = open_[~hit]
            if not len(open_):
                break
        return slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the key was never stored (but for one in 2**32 of foreign keys)."""
        keys = np.asarray(keys, np.int64)
        if not len(self.fingerprints):
            return np.full(len(keys), -1, np.int64)
        slots = self._slots(keys)
        own = (slots >= 0) & (self.fingerprints[np.maximum(slots, 0)] == self._fingerprint(keys))
        return np.where(own, slots, -1)


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class ShardWriter:
    """Writes the payload as documents arrive; directory, index and footer when closed."""

    def __init__(self, uri: str, width: int):
        fs, path = _filesystem(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.width, self.ids = fs.open_output_stream(path), width, 0
        self.keys, self.valid, self.starts = array("q"), bytearray(), array("Q", [0])

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.ids += len(ids)
        self.keys.append(0 if key is None else key)
        self.valid.append(key is not None)
        self.starts.append(self.ids)

    def close(self) -> tuple[int, int, int, int | None, int | None]:
        """Numbers of documents, distinct keys and ids, smallest and largest key."""
        valid, keys = np.frombuffer(self.valid, np.uint8), np.array(self.keys, "<i8")
        distinct, first = np.unique(keys[valid == 1], return_index=True)
        rows = np.flatnonzero(valid)[first].astype("<u4")
        index = PerfectHash.build(distinct)
        by_slot = np.zeros(len(distinct), "<u4")
        by_slot[index._slots(distinct)] = rows
        sections, at = {}, self.ids * self.width
        parts = {"keys": keys, "valid": valid, "starts": np.array(self.starts, "<u8"), "fingerprints": index.fingerprints.astype("<u4"), "rows": by_slot}
        for i, (_, words, ranks) in enumerate(index.levels):
            parts |= {f"level{i}": words, f"ranks{i}": ranks}
        for name, values in parts.items():
            data = values.tobytes()
            sections[name] = [at, len(data), str(values.dtype)]
            self.out.write(data)
            at += len(data)
        footer = {"docs": len(keys), "keys": len(distinct), "ids": self.ids, "width": self.width, "levels": [size for size, *_ in index.levels], "sections": sections}
        data = json.dumps(footer).encode()
        self.out.write(data + struct.pack("<I", len(data)) + MAGIC)
        self.out.close()
        ends = (int(distinct[0]), int(distinct[-1])) if len(distinct) else (None, None)
        return len(keys), len(distinct), self.ids, *ends


class Section:
    """One column of a shard file: a few elements are read where they lie, more load the column."""

    def __init__(self, file, at: int, length: int, kind: str):
        self.file, self.at, self.length, self.kind = file, at, length, np.dtype(kind)
        self.loaded = None

    def __len__(self) -> int:
        return self.length // self.kind.itemsize

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        size = self.kind.itemsize
        if self.loaded is None and len(rows) <= FEW:
            return np.frombuffer(b"".join(self.file.read_at(size, self.at + int(r) * size) for r in rows), self.kind)
        if self.loaded is None:
            self.loaded = np.frombuffer(self.file.read_at(self.length, self.at), self.kind)
        return self.loaded[rows]


class ShardReader:
    """Keyed access to one shard file; opening it reads the footer only."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        length, magic = struct.unpack("<I8s", self.file.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not an id shard")
        self.meta = json.loads(self.file.read_at(length, size - 12 - length))
        self.keys, self.valid, self.starts = (self._section(n) for n in ("keys", "valid", "starts"))
        levels = [(n, self._section(f"level{i}"), self._section(f"ranks{i}")) for i, n in enumerate(self.meta["levels"])]
        self.index = PerfectHash(levels, self._section("fingerprints"))
        self.rows = self._section("rows")

    def _section(self, name: str) -> Section:
        return Section(self.file, *self.meta["sections"][name])

    def row(self, keys: np.ndarray) -> np.ndarray:
        """First directory row of each key, -1 where the shard does not hold it."""
        slots = self.index.find(keys)
        return np.where(slots >= 0, self.rows[np.maximum(slots, 0)].astype(np.int64) if len(self.rows) else -1, -1)

    def ids_of_rows(self, first: int, end: int) -> list[np.ndarray]:
        """The ids of each document from row ``first`` up to ``end``, by one read."""
        width, starts = self.meta["width"], self.starts[np.arange(first, end + 1)].astype(np.int64)
        data = self.file.read_at(int(starts[-1] - starts[0]) * width, int(starts[0]) * width)
        ids = np.frombuffer(data, f"<u{width}").astype("<u4")
        return np.split(ids, starts[1:-1] - starts[0])

    def runs(self) -> Iterator[tuple[int, int]]:
        """Rows in runs of at most READ_ROWS documents and READ_IDS ids; a longer document is a run of its own."""
        docs, at = self.meta["docs"], 0
        starts = self.starts[np.arange(docs + 1)].astype(np.int64)
        while at < docs:
            end = int(np.searchsorted(starts, starts[at] + READ_IDS, "right")) - 1
            end = max(at + 1, min(end, at + READ_ROWS, docs))
            yield at, end
            at = end

    def get(self, key: int) -> np.ndarray | None:
        """The ids stored under a key; None if there are none."""
        row = int(self.row(np.array([key], np.int64))[0])
        return None if row < 0 else self.ids_of_rows(row, row + 1)[0]

    def close(self) -> None:
        self.file.close()


class TokenStore:
    """Shard files in ascending key order and the list of them (one row per shard)."""

    def __init__(self, spark: SparkSession, folder: str, shards: list[dict]):
        self.spark, self.folder, self.shards = spark, folder, shards
        self.keyed = [s for s in shards if s["keys"]]
        self.last_keys = [s["last"] for s in self.keyed]

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TokenStore:
        """A store that was written before; an unfinished one has no manifest and raises."""
        fs, path = _filesystem(f"{folder}/{MANIFEST_FILE}")
        with fs.open_input_file(path) as file:
            return cls(spark, folder, json.loads(file.read()))

    def get(self, key: int) -> np.ndarray | None:
        """The ids stored under a key (of the first document, where several share it); None if there are none."""
        at = bisect_left(self.last_keys, key)
        if at == len(self.keyed) or key < self.keyed[at]["first"]:
            return None
        reader = ShardReader(f"{self.folder}/{self.keyed[at]['file']}")
        try:
            return reader.get(key)
        finally:
            reader.close()

    @classmethod
    def write(cls, docs: DataFrame, vocabulary_path: str, end_id: int | None = 2, folder: str | None = None, shards: int | None = None) -> TokenStore:
        """Encode every whole text (null: no ids), append ``end_id`` and write range-partitioned shards.

        A null key sorts first and is not indexed; rows that share a key keep the order of a hash of their
        text, and the index finds the first.  A task writes a file of its own and names it in its result, so a
        repeated or speculative task leaves at most a file that no list names.
        """
        spark = docs.sparkSession
        folder = folder or shared_folder(spark, "ids")
        if shards is None:
            size = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
            shards = max(shuffle_width(spark), -(-size // SHARD_BYTES))
        ordered = (
            texts(docs)
            .withColumn("tie", F.xxhash64("text"))
            .repartitionByRange(shards, "doc_id", "tie")
            .sortWithinPartitions("doc_id", "tie")
            .withColumn("shard", F.spark_partition_id().cast("long"))
            .drop("tie")
        )
        schema = to_arrow(spark, MANIFEST)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import uuid

            writer = shard = name = None
            for batch in batches:
                for key, text, shard in zip(*(c.to_pylist() for c in batch.columns)):
                    if writer is None:
                        words = encoder(vocabulary_path, True)
                        largest = max(words.vocabulary_size() - 1, end_id or 0)
                        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"
                        writer = ShardWriter(f"{folder}/{name}", 2 if largest < 2**16 else 4)
                    ids = np.frombuffer(words.encode(text), np.uint32)
                    writer.add(key, ids if end_id is None else np.append(ids, np.uint32(end_id)))
            if writer is not None:
                counts = writer.close()
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (shard, name, *counts)))], schema=schema)

        made = ordered.mapInArrow(run, MANIFEST).collect()  # one row per shard
        listed = [r.asDict() for r in sorted(made, key=lambda r: r["shard"])]
        fs, path = _filesystem(f"{folder}/{MANIFEST_FILE}")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as file:
            file.write(json.dumps(listed).encode())
        return cls(spark, folder, listed)

    def read(self) -> DataFrame:
        """Per document, from the files: key, ids before it, number of ids, crc32 of the ids as 4-byte integers.

        Every keyed document goes through its shard's index; rows without a key, or after the first of their
        key, are read by their place in the directory.
        """
        before, base = {}, 0
        for i, shard in enumerate(self.shards):
            before[i] = (base, f"{self.folder}/{shard['file']}")
            base += shard["ids"]
        schema = to_arrow(self.spark, ROWS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    base, name = before[i]
                    reader = ShardReader(name)
                    for at, end in reader.runs():
                        here = np.arange(at, end)
                        keys, valid = reader.keys[here], reader.valid[here] == 1
                        found = reader.row(keys)
                        if (found[valid] < 0).any() or (reader.keys[found[valid]] != keys[valid]).any():
                            raise ValueError(f"{name}: a stored key is not in its index")
                        # The index gives the first document of a key; later ones are read by their place.
                        rows = np.where(valid & (found >= here), found, here)
                        ids = reader.ids_of_rows(at, end)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": [int(k) if ok else None for k, ok in zip(keys, valid)],
                                "start": base + reader.starts[rows].astype(np.int64),
                                "n_tokens": [len(ids[r - at]) for r in rows],
                                "ids_crc32": [zlib.crc32(ids[r - at].tobytes()) for r in rows],
                            },
                            schema=schema,
                        )
                    reader.close()

        n = len(self.shards)
        return self.spark.range(0, n, 1, max(1, n)).mapInArrow(run, ROWS)


def token_rows(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Write the documents' ids and read them back: the digest of what the files hold."""
    return TokenStore.write(docs, vocabulary_path or vocabulary("byte_bpe_50k.json")).read()
