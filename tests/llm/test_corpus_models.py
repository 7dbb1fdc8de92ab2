"""Language scores, clusters and divergences of sources against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from oracle import TABLES, compare

from scoreloom.llm import centroids, divergence, tree_weighting

WORDS = "the a of river stone cloud Light under over green small house water morning seven letter Straße l'été 東京 naïve".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "\n", "\x00"]) for _ in range(n))


TEXTS = [
    (1, prose(1, 120), "en", "a"), (2, prose(2, 60), "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, prose(3, 90), "de", "a"),
    (6, prose(4, 300), "en", "c"), (7, prose(4, 300), "en", "c"), (7, prose(4, 300), "en", "c"), (None, prose(5, 80), "de", "b"),
    (8, " \t\n ", "en", "only empty"), (9, prose(6, 4000), "de", "a"), (10, "Zzz Zzz zzz", "xx", ""), (11, "river", "de", "ß"), (12, prose(7, 50), "en", "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, source, 0, 1, "x") for i, t, lang, source in TEXTS]
    names = "doc_id long, text string, lang string, source string, block long, part int, term string"  # the last three clash
    return spark.createDataFrame(rows, names).repartition(3, "source")


# ------------------------------------------------------------------ context-tree weighting


def slow_scores(texts: list[bytes], train: list[bytes], depth: int) -> list[float]:
    """Context-tree weighting written as its definition: a dictionary of nodes, weighted recursively."""
    counts: dict = collections.defaultdict(lambda: [0, 0])
    children: dict = collections.defaultdict(set)

    def steps(text):
        whole = bytes([255]) * depth + text + b"\xff"
        for i in range(depth, len(whole)):
            known = ""
            for bit in f"{whole[i]:08b}":
                yield [(whole[i - d : i], known) for d in range(depth + 1)], int(bit)
                known += bit

    for text in train:
        for path, bit in steps(text):
            for above, node in zip([None, *path], path):
                counts[node][bit] += 1
                if above:
                    children[above].add(node)

    def own(node):
        a, b = counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted: dict = {}

    def log_w(node):
        if node not in weighted:
            if node not in counts:
                return 0.0
            if len(node[0]) == depth:
                weighted[node] = own(node)
            else:
                x, y = own(node), sum(log_w(c) for c in children[node])
                weighted[node] = np.logaddexp(x, y) - math.log(2)
        return weighted[node]

    out = []
    for text in texts:
        total = 0.0
        for path, bit in steps(text):
            a, b = counts.get(path[-1], (0, 0))
            p = ((a, b)[bit] + 0.5) / (a + b + 1)
            for node in reversed(path[:-1]):
                a, b = counts.get(node, (0, 0))
                stop = math.exp(own(node) - math.log(2) - log_w(node)) if node in counts else 0.5
                p = stop * ((a, b)[bit] + 0.5) / (a + b + 1) + (1 - stop) * p
            total += math.log10(p)
        out.append(total)
    return out


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 1


@pytest.mark.parametrize("depth, chunk, block", [(4, 1 << 22, 1 << 25), (3, 700, 2000), (2, 64, 300)])
def test_scores_match_the_definition(docs, depth, chunk, block, monkeypatch):
    monkeypatch.setattr(tree_weighting, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(tree_weighting, "BLOCK_BYTES", block)
    bodies = [lowered(t) for _, t, _, _ in TEXTS]
    known = [not held_out(i) for i, *_ in TEXTS]
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", b), None] for b in bodies]
    uses = collections.Counter(w for t, k in zip(tokens, known) if k for w in t)
    n, below = sum(uses.values()), sum(uses.values()) + 0.5 * (len(uses) + 1)
    scores = slow_scores([b.encode() for b in bodies], [b.encode() for b, k in zip(bodies, known) if k], depth)
    want = sorted(
        (str(i), held_out(i), len(t), sum(w in uses for w in t), n, round(sum(math.log10((uses[w] + 0.5) / below) for w in t), 6), round(s, 6))
        for (i, *_), t, s in zip(TEXTS, tokens, scores)
    )
    rows = tree_weighting.score_documents(docs, depth).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=2e-6)
    assert any(w[1] for w in want) and any(w[3] < w[2] for w in want)
    for r in rows:
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / (len(bodies[[i for i, *_ in TEXTS].index(r.doc_id)].encode()) + 1))


def test_chances_of_all_next_bytes_sum_to_one():
    texts = [prose(i, 40).lower().encode() for i in range(3)]
    keys, counts = np.unique(tree_weighting.runs(texts, 3)[0], return_counts=True)
    context = b"the"
    asked = np.array([int.from_bytes(context[::-1] + bytes([x]), "big") for x in range(256)], np.uint64)
    every, uses = tree_weighting.merge([keys, asked], [counts, np.zeros(256, np.int64)])
    part = tree_weighting.Subtrees(every, uses, 3)
    logs = part.log10(tree_weighting.Head(list(zip(*part.top()))))
    assert 10 ** logs[np.searchsorted(every, asked)] @ np.ones(256) == pytest.approx(1, abs=1e-9)


def test_model_beats_flat_bytes_on_held_out_text(spark):
    rows = [(i, " ".join(random.Random(i).choices(WORDS, k=60))) for i in range(200)]
    out = tree_weighting.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert len(out) > 20 and np.mean([r.bits_per_byte for r in out]) < 1.5


def test_empty_documents(docs):
    assert tree_weighting.score_documents(docs.limit(0)).collect() == []
    lone = tree_weighting.score_documents(docs.where("doc_id = 3")).collect()[0]
    assert (lone.n_tokens, lone.n_known) == (1, 0 if held_out(3) else 1)
    assert divergence.audit_sources(docs.limit(0)).collect() == []


# ------------------------------------------------------------------ centroids


def slow_clusters(rows, clusters, rounds, seed, size):
    kept = [(k, [math.floor(256 * float(x)) for x in v]) for k, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [r[1] for r in sorted(kept, key=name)[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        for i, group in members.items():
            centres[i] = [sum(x) // len(group) for x in zip(*group)]
    found = [(k, *near(v)[::-1]) for k, v in kept]
    inertia = collections.Counter()
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return collections.Counter((k, c, d, inertia[c], sum(inertia.values()), digest[c]) for k, c, d in found)


def vectors(seed, n, size, step):
    r = np.random.RandomState(seed)
    rows = [(i, [float(np.float32(x)) for x in np.round(r.randn(size) / step) * step]) for i in range(n)]
    bad = [(n, None), (n + 1, rows[0][1][:-1]), (n + 2, [*rows[0][1][:-1], None]), (n + 3, [*rows[0][1][:-1], float("nan")]), (n + 4, [*rows[0][1][:-1], float("-inf")]), (n + 5, [])]
    return [*rows, rows[0], rows[1], (None, rows[2][1]), (None, rows[3][1]), *bad]


@pytest.mark.parametrize("n, size, step, clusters, leaf", [(120, 64, 0.001, 40, 6), (150, 3, 1.0, 20, 2), (10, 4, 0.5, 40, 1), (90, 2, 1.0, 12, 1)])
def test_clusters_match_brute_force(spark, n, size, step, clusters, leaf, monkeypatch):
    monkeypatch.setattr(centroids, "BATCH", 37)
    monkeypatch.setattr(centroids.VantageTree.__init__, "__defaults__", (leaf,))
    rows = vectors(n, n, size, step)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cluster int, vector int").repartition(3)
    got = centroids.cluster_vectors(table, clusters, 5, 2, size)
    assert collections.Counter(map(tuple, got.collect())) == slow_clusters(rows, clusters, 5, 2, size)
    assert centroids.cluster_vectors(table.limit(0)).columns == got.columns and centroids.cluster_vectors(table.limit(0)).count() == 0


def test_tree_finds_the_smallest_number_on_ties():
    r = np.random.RandomState(3)
    points = r.randint(-2, 3, (60, 3)).astype(np.int64)  # many equal centroids and equal distances
    asked = r.randint(-3, 4, (500, 3)).astype(np.int64)
    number, square = centroids.VantageTree(points, 2).nearest(asked)
    every = centroids.squared(asked, points)
    assert (number == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all()


def test_far_components_are_refused(spark):
    table = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds"):
        centroids.cluster_vectors(table, 2, 1, 2, 2).collect()


# ------------------------------------------------------------------ divergence of sources


def slow_audit(rows, least=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    rows = [(lowered(t), lang or "", source or "") for _, t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        found = [(s, term.findall(t)) for t, x, s in rows if x == lang]
        documents = collections.Counter(w for _, words in found for w in set(words))
        kept = [w for w, n in documents.items() if n >= least]
        uses = {s: collections.Counter() for s, _ in found}
        for s, words in found:
            uses[s].update(w for w in words if documents[w] >= least)
        share = lambda n, total: 1 + 10**9 * (n + 1) // (total + len(kept))
        p = {s: {w: share(u[w], sum(u.values())) for w in kept} for s, u in uses.items()}
        total = sum(sum(u.values()) for u in uses.values())
        q = {w: share(sum(u[w] for u in uses.values()), total) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in uses:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in uses if o != s]
            terms = [(-f(p[s][w], q[w]), w.encode()) for w in kept if uses[s][w] and p[s][w] > q[w]]
            for part, found_here in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found_here, 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("spill, pairs, top", [(400_000, 2_000_000, 200), (5, 3, 4)])
def test_audit_matches_brute_force(docs, spill, pairs, top, monkeypatch):
    monkeypatch.setattr(divergence, "SPILL_CELLS", spill)
    monkeypatch.setattr(divergence, "PAIR_CELLS", pairs)
    monkeypatch.setattr(divergence, "SEND_ROWS", 7)
    assert collections.Counter(map(tuple, divergence.audit_sources(docs, 3, top).collect())) == slow_audit(TEXTS, 3, top)


def test_shares_are_exact_for_large_counts():
    counts, total = np.array([0, 1, 10**12, 3 * 10**14]), 7 * 10**14 + 3
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (n + 1) // total for n in counts.tolist()]


# ------------------------------------------------------------------ SQL twins


def test_sql_twins(spark, sf_dir):
    import duckdb

    from scoreloom.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    for name, sql in ORACLES.items():
        assert compare(QUERIES[name](spark, sf_dir), con, sql) is None, name
