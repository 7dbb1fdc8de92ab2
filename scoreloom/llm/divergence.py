"""How far the sources of a language differ in their words, by in-mapper stripes.

A task folds whole documents into stripes, one per language and term: the number of documents that hold the term and its
occurrences per source.  A full table of stripes is spilled; stripes of one key meet after a shuffle, in key order, and are
merged as they stream by.  Merged stripes that enough documents share directly give every term's divergence and
their part of every pair of sources, so neither a (term, source) table nor a pair of documents is ever built.

All arithmetic is on whole numbers: a share is ``1 + floor(10^9 (count + 1) / (N + V))`` and a divergence
``floor((p - q)^2 / q)``.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.session import store

from .common import to_arrow

#: Letters are A-Z (lower-cased), a-z and everything above ASCII; all other bytes of UTF-8 separate terms.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
SPILL_CELLS = 1_000_000
SEND_ROWS = 20_000
PAIR_CELLS = 2_000_000
STRIPE = "lang string, term string, documents long, sources array<string>, counts array<long>"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(LETTERS).split() if text else []


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``1 + floor(10^9 (count + 1) / total)`` in whole 64-bit numbers, by long division in thousands; total below 9e15."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)^2 / q)``; shares stay below 2 * 10^9, so the square fits."""
    gap = p - q
    return gap * gap // q


class _Stripes:
    """Stripes of one language: per term a number while one document holds it, then counts by source.

    The number is ``occurrences * 2^32 + source``; a stripe of several documents has their number under -1.
    """

    def __init__(self, lang: str):
        self.lang, self.table = lang, {}

    def fold(self, terms: list[bytes], source: int) -> int:
        """Add a document; tells how many cells the table has gained."""
        table, gained = self.table, 0
        get = table.get
        for term, n in Counter(terms).items():
            stripe = get(term)
            if stripe is None:
                table[term] = n << 32 | source
                gained += 1
            elif type(stripe) is int:
                table[term] = {-1: 2, stripe & 0xFFFFFFFF: stripe >> 32}
                table[term][source] = table[term].get(source, 0) + n
                gained += 3
            else:
                stripe[-1] += 1
                if source not in stripe:
                    gained += 1
                stripe[source] = stripe.get(source, 0) + n
        return gained

    def rows(self, names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        single = {k: v for k, v in self.table.items() if type(v) is int}
        shared = {k: v for k, v in self.table.items() if type(v) is not int}
        every, packed = list(single), np.fromiter(single.values(), np.int64, len(single))
        for at in range(0, len(every), SEND_ROWS):
            part = packed[at : at + SEND_ROWS]
            yield self._batch(every[at : at + SEND_ROWS], np.ones(len(part), np.int64), np.ones(len(part), np.int64), part & 0xFFFFFFFF, part >> 32, names, schema)
        every = list(shared)
        for at in range(0, len(every), SEND_ROWS):
            part = [shared[k] for k in every[at : at + SEND_ROWS]]
            sources, counts = [x for s in part for x in s if x >= 0], [n for s in part for x, n in s.items() if x >= 0]
            yield self._batch(every[at : at + SEND_ROWS], [s[-1] for s in part], [len(s) - 1 for s in part], sources, counts, names, schema)

    def _batch(self, terms, documents, sizes, sources, counts, names, schema) -> pa.RecordBatch:
        columns = [
            pa.array([self.lang]).take(pa.array(np.zeros(len(terms), np.int64))), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(documents, pa.int64()),
            lists(sizes, pa.array(names, pa.string()).take(pa.array(sources, pa.int64()))), lists(sizes, pa.array(counts, pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def lists(sizes: list[int] | np.ndarray, values: pa.Array) -> pa.Array:
    """A list column from the lists' sizes and all their values."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def stripes(docs: DataFrame) -> DataFrame:
    """Spilled stripes of all documents: several rows per language and term, at most one per task and spill."""
    schema = to_arrow(docs.sparkSession, STRIPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, _Stripes] = {}
        places: dict[str, int] = {}
        cells = 0

        def spill() -> Iterator[pa.RecordBatch]:
            names = list(places)
            for table in tables.values():
                yield from table.rows(names, schema)
            tables.clear()

        for batch in batches:
            for body, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
                if lang not in tables:
                    tables[lang] = _Stripes(lang)
                cells += tables[lang].fold(terms_of(body), places.setdefault(source, len(places)))
                if cells > SPILL_CELLS:
                    yield from spill()
                    cells = 0
        yield from spill()

    return docs.select(F.col("text").cast("binary"), "lang", "source").mapInArrow(run, STRIPE)


def merge_sorted(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Merged stripes of a batch in which equal keys are neighbours, and their numbers of documents."""
    n = batch.num_rows
    lang, term, documents, sources, counts = batch.columns
    first = np.ones(n, bool)
    for column in (lang, term):
        if n > 1:
            change = pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first[1:] = change if column is lang else first[1:] | change
    starts = np.flatnonzero(first)
    held = np.add.reduceat(documents.to_numpy(), starts)
    if len(starts) == n:
        return batch, held
    names = sources.flatten().dictionary_encode()
    group = np.repeat(np.cumsum(first) - 1, sources.value_lengths().to_numpy())
    cell = group * len(names.dictionary) + names.indices.to_numpy()
    order = np.argsort(cell, kind="stable")
    cell, uses = cell[order], counts.flatten().to_numpy()[order]
    at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    sizes = np.bincount(cell[at] // len(names.dictionary), minlength=len(starts))
    rows = pa.array(starts)
    columns = [
        lang.take(rows), term.take(rows), pa.array(held), lists(sizes, names.dictionary.take(pa.array(cell[at] % len(names.dictionary)))),
        lists(sizes, pa.array(np.add.reduceat(uses, at))),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema), held


def merged(spilled: DataFrame, least: int) -> DataFrame:
    """One stripe per language and term that at least ``least`` of the language's documents hold."""
    schema = to_arrow(spilled.sparkSession, STRIPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the stripe that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, schema=schema)
            whole, held = merge_sorted(batch if last is None else pa.concat_batches([last, batch]))
            last = whole.slice(whole.num_rows - 1)
            yield whole.slice(0, whole.num_rows - 1).filter(pa.array(held[:-1] >= least))
        if last is not None and last.column(2)[0].as_py() >= least:
            yield last

    keys = ("lang", "term")
    return spilled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, STRIPE)


class SourceTotals:
    """Per language the number of kept terms, and the occurrences of kept terms in every source, in UTF-8 order.

    The result of the audit has a row per ordered pair of sources of a language, so this list is about the square root of it.
    """

    def __init__(self, kept: dict[str, int], totals: dict[str, dict[str, int]]):
        self.kept = kept
        self.sources = {lang: sorted(t, key=str.encode) for lang, t in totals.items()}
        self.totals = {lang: np.array([t[s] for s in self.sources[lang]], np.int64) for lang, t in totals.items()}
        self.place = {lang: {s: i for i, s in enumerate(names)} for lang, names in self.sources.items()}

    @classmethod
    def of(cls, docs: DataFrame, table: DataFrame) -> SourceTotals:
        kept = {r[0]: r[1] for r in table.groupBy("lang").count().collect()}
        uses = table.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source"))
        totals: dict[str, dict[str, int]] = {}
        for r in docs.select("lang", "source").distinct().collect():
            totals.setdefault(r.lang, {})[r.source] = 0
        for r in uses.agg(F.sum("x.counts").alias("n")).collect():
            totals[r.lang][r.source] = r.n
        return cls(kept, totals)

    def none(self, lang: str) -> np.ndarray:
        """The share of a term that a source does not use, per source."""
        return shares(np.zeros(len(self.totals[lang]), np.int64), self.totals[lang] + self.kept[lang])


class _Pairs:
    """Sums over terms of the divergence of every ordered pair of sources of one language, less that of two absent terms.

    Only terms that one of the two sources uses differ from the share of an absent term.  Rows of sums are made when a source
    is first used and handed on when they hold too many cells.
    """

    def __init__(self, none: np.ndarray):
        self.none, self.rows = none, {}

    def absent(self, g: int) -> np.ndarray:
        return divergence(self.none[g], self.none)

    def add(self, used: np.ndarray, p: np.ndarray) -> None:
        """``p``: shares of some terms (rows) in every source; ``used``: whether the source has the term."""
        for g in np.flatnonzero(used.any(axis=0)):
            here = used[:, g]
            mine, others, theirs = p[here, g][:, None], p[here], used[here]
            row = self._row(g)
            row += (divergence(mine, others) - self.absent(g)).sum(axis=0)
            # the other side: g is the reference, and the first source does not use the term
            back = np.where(theirs, 0, divergence(self.none, mine) - divergence(self.none, self.none[g])).sum(axis=0)
            for h in np.flatnonzero(back):
                self._row(h)[g] += back[h]

    def _row(self, g: int) -> np.ndarray:
        if g not in self.rows:
            self.rows[g] = np.zeros(len(self.none), np.int64)
        return self.rows[g]

    def cells(self) -> int:
        return len(self.rows) * len(self.none)

    def take(self) -> Iterator[tuple[int, int, int]]:
        for g, row in self.rows.items():
            for h in np.flatnonzero(row):
                yield int(g), int(h), int(row[h])
        self.rows = {}


class _Leaders:
    """The terms of largest value per source, up to ``top``; on ties the smaller term."""

    def __init__(self, top: int):
        self.top, self.best = top, {}

    def add(self, source: int, values: np.ndarray, terms: list[bytes]) -> None:
        best = self.best.get(source, [])
        if len(best) >= self.top:
            fit = values >= -best[-1][0]
        else:
            fit = np.ones(len(values), bool)
        new = [(-int(values[i]), terms[i]) for i in np.flatnonzero(fit)]
        if new:
            self.best[source] = heapq.nsmallest(self.top, best + new)


def parts(table: DataFrame, totals: SourceTotals, top: int) -> DataFrame:
    """Each task's share of the pair sums, and its leading terms, as ``lang, source, part, item, value``."""
    ddl = "lang string, source string, part string, item string, value long"
    schema = to_arrow(table.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, _Pairs] = {}
        leaders: dict[str, _Leaders] = {}

        def send(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
            rows = list(rows)
            for at in range(0, len(rows), SEND_ROWS):
                columns = [list(c) for c in zip(*rows[at : at + SEND_ROWS])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, x in pairs.items():
                names = totals.sources[lang]
                yield from send((lang, names[g], "pair", names[h], v) for g, h, v in x.take())

        for batch in batches:
            by_lang: dict[str, list[tuple]] = {}
            for lang, term, _, sources, counts in zip(*(c.to_pylist() for c in batch.columns)):
                by_lang.setdefault(lang, []).append((term.encode(), sources, counts))
            for lang, rows in by_lang.items():
                place, kept = totals.place[lang], totals.kept[lang]
                below = totals.totals[lang] + kept
                if lang not in pairs:
                    pairs[lang], leaders[lang] = _Pairs(totals.none(lang)), _Leaders(top)
                width = max(1, PAIR_CELLS // len(place))
                for at in range(0, len(rows), width):
                    part = rows[at : at + width]
                    terms = [r[0] for r in part]
                    uses = np.zeros((len(part), len(place)), np.int64)
                    for i, (_, sources, counts) in enumerate(part):
                        uses[i, [place[s] for s in sources]] = counts
                    p = shares(uses, below)
                    q = shares(uses.sum(axis=1), int(below.sum()) - kept * (len(place) - 1))
                    pairs[lang].add(uses > 0, p)
                    for g in np.flatnonzero(uses.any(axis=0)):
                        at_g = np.flatnonzero((uses[:, g] > 0) & (p[:, g] > q))
                        leaders[lang].add(int(g), divergence(p[at_g, g], q[at_g]), [terms[i] for i in at_g])
                if sum(x.cells() for x in pairs.values()) > PAIR_CELLS:
                    yield from sums()
        yield from sums()
        for lang, x in leaders.items():
            names = totals.sources[lang]
            yield from send((lang, names[g], "term", term.decode(), -v) for g, best in x.best.items() for v, term in best)

    return table.mapInArrow(run, ddl)


def audit_sources(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """Per language and source: every other source by divergence (``pair``), and the terms that stand out (``term``).

    Columns ``lang, source, part, item, value, rank``.  Null text, language and source count as ``''``; repeated rows are
    documents of their own.  A source without terms has its pairs; a language of one source has no pair; an empty
    table gives no row.  Ranks go from the largest value, on ties from the smaller item in UTF-8 order; of
    terms only the first ``top`` are a result.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    table = store(merged(stripes(rows), least))
    totals = SourceTotals.of(rows, table)
    found = store(parts(table, totals, top))

    groups = spark.createDataFrame([(lang, i) for lang, names in totals.sources.items() for i in range(len(names))], "lang string, g int")
    base = _absent_pairs(groups, totals)
    pairs = found.where("part = 'pair' and source <> item").unionByName(base).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # A task hands on up to ``top`` terms of a group; they are thinned out in parts of a group before its ranks are given.
    some = Window.partitionBy("lang", "source", "part", F.pmod(F.xxhash64("item"), F.lit(64))).orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("_some", F.row_number().over(some)).where(F.col("_some") <= top).drop("_some")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(terms).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def _absent_pairs(groups: DataFrame, totals: SourceTotals) -> DataFrame:
    """Every pair with the value that all kept terms would give if neither source used any; made in tasks, a source a row."""
    ddl = "lang string, source string, part string, item string, value long"
    schema = to_arrow(groups.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, g in zip(*(c.to_pylist() for c in batch.columns)):
                names, kept = totals.sources[lang], totals.kept.get(lang, 0)
                none = totals.none(lang) if kept else None
                values = kept * divergence(none[g], none) if kept else np.zeros(len(names), np.int64)
                others = [h for h in range(len(names)) if h != g]
                for at in range(0, len(others), SEND_ROWS):
                    part = others[at : at + SEND_ROWS]
                    columns = [[lang] * len(part), [names[g]] * len(part), ["pair"] * len(part), [names[h] for h in part], values[part].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return groups.mapInArrow(run, ddl)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
AUDIT_SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
    SELECT row_id, lang, source, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row_id) >= 3
), size AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), used AS (
    SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sums AS (
    SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL
), cells AS (
    SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS uses,
        1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 1)) // (coalesce(s.total, 0) + z.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (k.n + 1)) // (z.total + z.v)::HUGEINT AS q
    FROM groups g JOIN kept k USING (lang) JOIN size z USING (lang)
    LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
    LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM cells WHERE uses > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
