"""Training-data operators against brute force, on small frames with nulls, repeats, empty and long texts."""

import collections
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

from scoreloom.llm import decontaminate, html_text, language, licenses, neardup, packing, pii, pii_rules, quality, sharding, token_store
from scoreloom.llm.components import connected_components
from scoreloom.llm.encoder import encoder, vocabulary

VOCABULARY = "the a of and in on to for river stone cloud light under over green small house water morning seven letter field road".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", ",", "."]) for _ in range(n))


LONG = prose(99, 30_000)
BASE = prose(1, 300)
EDITED = " ".join(w if i != 150 else "changed" for i, w in enumerate(BASE.split()))
TEXTS = [
    (1, BASE), (2, EDITED), (3, BASE.upper()), (4, None), (5, ""), (6, " \n\t "), (7, "two words"), (8, "two words"), (9, LONG), (10, prose(2, 80)),
    (11, prose(3, 40) + " mail me at jo.doe@mail.example.com or +1 (514) 555-8389, 10.0.0.255, 4111 1111 1111 1111. " + prose(4, 40)),
    (12, "Released under the MIT License.\n" + prose(5, 60)), (13, "x " * 400), (13, "x " * 400), (None, prose(6, 50)), (14, "3.4 日本語 naïve\x1c a b  c <|endoftext|> it's"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), i or 0, 1) for i, t in TEXTS]
    names = "doc_id long, text string, lang string, source string, n_chars long, shard int, key int"  # the last two clash
    return spark.createDataFrame(rows, names).repartition(3, "source")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def components(texts, size, percent):
    sets = [neardup.shingles(neardup.words_of(t), size) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label, sets


@pytest.mark.parametrize("size, percent, block", [(3, 85, 512), (5, 80, 2)])
def test_near_duplicates_match_all_pairs(docs, size, percent, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, size, percent).collect())
    label, sets = components([t for _, t in TEXTS], size, percent)
    least = {x: min((i for (i, _), y in zip(TEXTS, label) if y == x and i is not None), default=None) for x in label}
    assert got == collections.Counter((i, len(s), least[x], least[x] == i) for (i, _), s, x in zip(TEXTS, sets, label))


def test_one_row_of_each_group_stays(docs):
    ids = sorted(str(r.doc_id) for r in neardup.keep_one_of_each(docs).collect())
    assert ids == sorted(map(str, [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, None, 14]))


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_in_one_task_and_in_rounds_agree(spark, kind):
    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(190)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for a, b in pairs:
        if a != b:
            low, high = sorted((label[a], label[b]))
            label = {x: low if y == high else y for x, y in label.items()}
    value = (lambda x: x) if kind == "long" else (lambda x: x.to_bytes(2, "big"))
    links = spark.createDataFrame([(value(a), value(b)) for a, b in pairs], f"a {kind}, b {kind}").repartition(3)
    want = {(value(x), value(y)) for x, y in label.items()}
    for at_once in (0, 200_000):
        found = [tuple(map(lambda v: bytes(v) if kind == "binary" else v, x)) for x in connected_components(links, at_once=at_once).collect()]
        assert len(found) == len(want) and set(found) == want
        assert connected_components(links.limit(0), at_once=at_once).count() == 0


def test_registers_estimate_jaccard():
    r, errors = np.random.RandomState(0), []
    for _ in range(60):
        pool = np.unique(r.randint(0, 2**63, 1500).astype(np.uint64) * np.uint64(2))
        a, b = pool[:1200], pool[300:]
        errors.append(float(neardup.estimate(neardup.registers(a), neardup.registers(b))) - 900 / len(pool))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_intersections_match_sets(monkeypatch):
    monkeypatch.setattr(neardup, "WIDTH", 7)
    sets = [np.unique(np.random.RandomState(i).randint(0, 40, 20 + i)).astype(np.uint64) for i in range(6)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert neardup.intersections(sets).tolist() == want


def test_ids_match_the_library_and_survive_the_files(docs):
    name = vocabulary("byte_bpe_50k.json")
    plain = Tokenizer.from_file(name)
    want, at = collections.Counter(), 0
    tail = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    for key, text in tail:
        ids = array("I", plain.encode(text or "", add_special_tokens=False).ids + [2])
        want[(key, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    assert collections.Counter(map(tuple, token_store.token_rows(docs).collect())) == want


def test_perfect_hash_is_minimal_and_refuses_foreign_keys(tmp_path):
    keys = np.random.RandomState(1).permutation(200_000)[:50_000].astype(np.int64)
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.find(keys)) == list(range(len(keys)))
    assert (index.find(np.arange(10**6, 10**6 + 50_000)) >= 0).sum() <= 1
    writer = token_store.ShardWriter(f"file://{tmp_path}/a.ids", 2)
    for key in (5, None, 9, 9):
        writer.add(key, np.arange(key or 3, dtype=np.uint32))
    writer.close()
    reader = token_store.ShardReader(f"file://{tmp_path}/a.ids")
    assert reader.get(9).tolist() == list(range(9)) and reader.get(5).tolist() == list(range(5)) and reader.get(7) is None


def test_token_store_opens_again_and_finds_keys(spark, tmp_path):
    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = {i * 7: f"text {i} " + "word " * (i % 50) for i in range(300)} | {-5: "", 2**62: None}
    rows = [*texts.items(), (None, "no key"), (None, None), (14, texts[14])]
    folder = f"file://{tmp_path}/store"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    written = token_store.TokenStore.write(docs, vocabulary("byte_bpe_50k.json"), folder=folder, shards=3)
    store = token_store.TokenStore.open(spark, folder)
    assert store.shards == written.shards and len(store.shards) == 3
    for key, text in texts.items():
        assert store.get(key).tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2]
    assert all(store.get(key) is None for key in (-6, 1, 15, 2**61, 2**63 - 1))
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(map(tuple, written.read().collect()), key=str)
    with pytest.raises(FileNotFoundError):
        token_store.TokenStore.open(spark, f"file://{tmp_path}/none")


def test_long_runs_are_cut(docs, monkeypatch, tmp_path):
    writer = token_store.ShardWriter(f"file://{tmp_path}/a.ids", 4)
    sizes = [0, 5, 30, 0, 2, 2, 9, 0]
    for key, n in enumerate(sizes):
        writer.add(key, np.arange(n, dtype=np.uint32))
    writer.close()
    reader = token_store.ShardReader(f"file://{tmp_path}/a.ids")
    monkeypatch.setattr(token_store, "READ_IDS", 10)
    monkeypatch.setattr(token_store, "READ_ROWS", 3)
    runs = list(reader.runs())
    assert [r for at, end in runs for r in range(at, end)] == list(range(len(sizes)))
    assert all(end - at <= 3 and (end - at == 1 or sum(sizes[at:end]) <= 10) for at, end in runs)
    assert [len(x) for at, end in runs for x in reader.ids_of_rows(at, end)] == sizes


def test_encoder_cuts_like_the_library():
    odd = ["a  b\n\n c \t d's  ", "  x", "x\n", " 's it's\n 'll", "a b  c", "é́ ΑΣ Σ", "日本語 123  45", " \n\n a\r\nb", "٣٤ x²", "a\x1cb \x1c"]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        plain = Tokenizer.from_file(vocabulary(name))
        for text in odd + [t for _, t in TEXTS if t]:
            assert encoder(vocabulary(name), spaced).encode(text) == array("I", plain.encode(text, add_special_tokens=False).ids).tobytes()


def test_pieces_tile_documents_and_windows(docs):
    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = packing.pack_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    ids = {i: array("I", plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in TEXTS}
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, bytes(r.ids)))
        by_window[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 and r.doc_tokens == len(ids[r.doc_id])
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in by_doc.items()} == {i: x.tobytes() for i, x in ids.items() if i is not None}
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_differencing_balances():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in b) for b in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    sizes = np.random.RandomState(3).randint(1, 2000, 400).tolist()
    sums = [sum(sizes[i] for i in b) for b in packing.difference(sizes, 32)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) < 200


def test_jump_hash_matches_the_scalar_rule_and_moves_little(docs):
    def scalar(key, n):
        key, b, j = key & (2**64 - 1), -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) & (2**64 - 1)
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    keys = np.random.RandomState(2).randint(-(2**62), 2**62, 3000)
    few, more = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert few.tolist() == [scalar(int(k), 24) for k in keys]
    assert set(more[more != few]) == {24} and 60 < (more != few).sum() < 190
    rows = sharding.shard_documents(docs, 3).collect()
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r.slot)
    assert len(rows) == len(TEXTS) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert {(r.doc_id, r.size) for r in rows} == {(i, len((t or "").encode()) + 8) for i, t in TEXTS}


def test_leaks_match_brute_force(spark, docs):
    cut = LONG.split()[20_000:20_040]
    changed = [w if i != 20 else "changed" for i, w in enumerate(cut)]
    items = [(1, " ".join(cut)), (2, " ".join(changed)), (3, "two words"), (4, None), (5, ""), (6, prose(77, 30)), (None, " ".join(cut)), (7, " ".join(LONG.split()[5000:5150]))]
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, text in TEXTS:
        words = decontaminate.words_of(text)
        for m, item in items:
            own = decontaminate.words_of(item)
            width = min(5, len(own))
            need = set(zip(*(own[i:] for i in range(width)))) if own else set()
            have = set(zip(*(words[i:] for i in range(width)))) if own else set()
            if need and 100 * len(need & have) >= 80 * len(need):
                want.add((d, m))
    assert found == want and {(9, 1), (9, 2), (9, 7), (9, None), (7, 3)} <= found
    left = decontaminate.drop_leaked(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert collections.Counter(r.doc_id for r in left.collect()) == collections.Counter(i for i, _ in TEXTS if i not in {d for d, _ in want})


@pytest.mark.parametrize("n, distinct", [(300, 10), (300, 20), (604, 10), (300, 60), (300, 100), (300, 130)])
def test_leaks_of_repetitive_items(n, distinct):
    items, bodies = [], []
    for i in range(30):
        cycle = [f"w{i}x{j}" for j in range(distinct)]
        passage = (cycle * n)[:n]
        items.append((i, " ".join(passage)))
        r = random.Random(i)
        filler = [f"f{r.randrange(10**6)}" for _ in range(3000)]
        bodies.append(" ".join(filler[: 100 * i] + passage + filler[100 * i :]))
    found = decontaminate.search(decontaminate.Items(items, 5), bodies, 80)
    assert found == [(i, i, distinct, distinct) for i in range(30)]
    near = [" ".join(b.split()).replace(f"w{i}x0 ", f"v{i} ") for i, b in enumerate(bodies)]  # a cycle without one of its words
    assert [x[:2] for x in decontaminate.search(decontaminate.Items(items, 5), near, 80)] == [(i, i) for i in range(30) if distinct - 5 >= 0.8 * distinct]


def quality_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, seen = len(words), collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(n - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, 0), (None, 1, 0), (13, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge_documents(docs, labels).collect()
    got = collections.Counter((r.doc_id, *tuple(r)[1:6]) for r in rows)
    assert got == collections.Counter((i, *quality_counts(t)) for i, t in TEXTS)
    failed = {(r.doc_id, r.base_failed) for r in rows}
    assert failed == {(i, n[0] < 20 or 100 * n[4] > 30 * n[0]) for i, t in TEXTS for n in [quality_counts(t)]}
    kept = [r.doc_id for r in rows if r.kept]
    assert sorted(map(str, kept)) == sorted(str(r.doc_id) for r in quality.keep_good(docs, labels).collect())


def test_licences(docs):
    assert licenses.scan_text("Sold under CC BY 2.0; all rights reserved")["base_labels"] == "cc-by,reserved"
    text = "x licensed under the terms of the MIT License, GNU General Public License version 3, general public license"
    found = licenses.scan_text(text)
    assert found["labels"] == "gpl,gpl-3.0,mit-notice" and (found["n_base"], found["first_word"], found["last_word"]) == (2, 10, 15)
    full = licenses.MARK.sub("", licenses.TEMPLATES["mit"]).replace("IN NO EVENT SHALL", "IN NO EVENT SHALL Jo Doe")
    assert "mit" in licenses.scan_text(full)["labels"].split(",")
    assert "mit" not in licenses.scan_text(full.replace("without restriction", "with restriction"))["labels"].split(",")
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert rows[12].labels == "mit-notice" and rows[4].n_words == 0 and rows[4].first_word is None and rows[4].labels == ""


def test_licences_need_all_their_wording():
    labels = lambda t: set(licenses.scan_text(t)["labels"].split(","))
    spans = lambda t: licenses.scan_text(t)["spans"]
    holder = " ".join(f"Holder{i}," for i in range(60))
    filled = {k: licenses.MARK.sub(lambda m: f" {holder} " if m[1] == "var" else "", t) for k, t in licenses.TEMPLATES.items() if k in ("mit", "isc", "bsd-2-clause", "bsd-3-clause")}
    assert all(labels(t) == {k} for k, t in filled.items())
    two, third = filled["bsd-2-clause"], "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    assert labels(two.replace("THIS SOFTWARE IS", third + " THIS SOFTWARE IS")) == {"bsd-3-clause"}
    assert labels(two[: two.index("THIS SOFTWARE IS")]) == labels(two.replace("ARE DISCLAIMED", "ARE GIVEN")) == {""}
    assert labels(filled["isc"][: filled["isc"].index("IN NO EVENT")]) == {""}
    n = len(licenses.words_of(filled["mit"]))
    assert spans(f"{filled['mit']} and {filled['mit']}") == [f"mit:0:{n}", f"mit:{n + 1}:{2 * n + 1}"]
    begun = filled["mit"][: filled["mit"].index("BE LIABLE")]
    assert spans((begun + "\n") * 300 + filled["mit"].replace("BE LIABLE FOR", "be liable of")) == []
    assert spans(f"{begun} {filled['mit']} {begun}")[0].startswith("mit:0:")


def test_word_regions_have_no_limit():
    for match, least in ((".+", 1), (".*", 0)):
        a = licenses.Automaton(f'one <<var;original="x";match="{match}">> two')
        assert [a.longest([b"one", *[b"x"] * k, b"two"], 0, {}) for k in (0, 1, 39, 41, 500)] == [2 + k if k >= least else -1 for k in (0, 1, 39, 41, 500)]
    assert licenses.Automaton('one <<var;original="x";match=".+">>').longest([b"one", b"x", b"y", b"z"], 0, {}) == 4


def test_base_rules_match_plain_patterns():
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice("a1@.. -+(0é4") for _ in range(30)) + r.choice(["", " 4111111111111111", " a@b@c.de.f", " 1.2.3.4.5.6.7.8"])
        want = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text):
                digits = pii_rules.digits_of(m[0])
                ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and pii_rules.luhn(digits), "phone": 9 <= len(digits) <= 15}
                if ok[kind]:
                    want.append((kind, *m.span()))
        assert sorted(pii_rules.base_spans(text)) == sorted(want), text


def test_tagger_learns_and_masks(docs, empty):
    windows = [t[a:b] for _, t in TEXTS if t for z in pii.zones(t) for a, b in pii.cuts(*z)] + [prose(i, 12)[:64] for i in range(100)]
    tagger = pii.Tagger.fresh()
    losses = tagger.train(*pii.training_set(windows))
    chars, gold = pii.training_set(windows[-50:], seed=77)
    spans = lambda row: set(pii._spans({i: (0, int(x)) for i, x in enumerate(row) if x}))
    found, want = [spans(x) for x in tagger.decode(chars)], [spans(x) for x in gold]
    hits = sum(len(a & b) for a, b in zip(found, want))
    assert losses[-1] < losses[0] / 5 and hits / sum(map(len, found)) > 0.8 and hits / sum(map(len, want)) > 0.8
    rows = {r.doc_id: r for r in pii.find_personal_data(docs, tagger).collect()}
    assert (rows[11].n_email, rows[11].n_ip, rows[11].n_card, rows[11].n_phone) == (1, 1, 1, 1) and rows[4].spans == "" and rows[10].spans == ""
    clean = {r.doc_id: r for r in pii.mask_personal_data(docs, tagger).collect()}
    assert "@" not in clean[11].text and "[EMAIL]" in clean[11].text and clean[11].n_chars == len(clean[11].text)
    assert clean[10].text == dict(TEXTS)[10] and clean[4].text is None


def test_forward_pass_sums_all_cuts():
    lattice = language.Lattice(vocabulary("piece_bpe_32k.model"))
    p = np.random.RandomState(0).rand(2, lattice.size)
    unigrams = language.Unigrams(lattice, p / p.sum(1, keepdims=True))

    def cuts(marked):
        if not marked:
            yield ()
        for k in range(1, len(marked) + 1):
            piece = lattice.pieces.get(marked[:k])
            ids = (piece,) if piece is not None else tuple(lattice.first_byte + b for b in marked[0].encode()) if k == 1 else None
            if ids:
                yield from (ids + rest for rest in cuts(marked[k:]))

    words = ["the", "hello", "über", "東x"]
    for word, row in zip(words, unigrams.words(words)):
        total = [sum(np.prod(unigrams.p[k, list(c)]) for c in cuts(language.START + word)) for k in (0, 1)]
        assert np.allclose(np.log(total), row) and np.allclose(unigrams.word(word), row)
        used, want = np.zeros(lattice.size), np.zeros(lattice.size)
        unigrams.expected_words(0, [word], [3], used)
        for c in cuts(language.START + word):
            np.add.at(want, list(c), 3 * np.prod(unigrams.p[0, list(c)]) / total[0])
        assert np.allclose(used, want)


def test_words_hold_combining_marks():
    assert language.words_of("हिन्दी भाषा, ภาษาที่ 1 Cafe\u0301s x_y ा") == ["हिन्दी", "भाषा", "ภาษาที่", "cafe\u0301s", "x", "y"]
    assert language.words_of("The quick-brown fox2go naïve") == ["the", "quick", "brown", "fox", "go", "naïve"]


def test_language_of_held_out_texts(spark):
    other = "der die das und ist nicht ein kleines haus wasser morgen stein wolke".split()
    rows = [(i, prose(i, 20) if i % 2 else " ".join(random.Random(i).choices(other, k=20)), "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "12 !", "en"), (102, "house", None), (None, "water", "en")]
    got = {r.doc_id: r for r in language.language_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:40])
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].lang_pred == "en" and not got[None].held_out
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows[:43])


PAGE = """<html><body><header>Site</header><div id="cookie-notice">Cookies, many, of them, ok</div><div><div class="sidebar">Side</div><div>
<h2>Head &amp; line</h2><p>One, two<br>break.<p>Second para, with a <a href=y>link</a> inside it.<ul><li>item<li>two</ul></div></div>
<section id="comments"><p>Reader says, a long, long, thing, with, many, commas, here.</p></section><form>Name</form><footer>f</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nOne, two break.\nSecond para, with a link inside it.\nitem\ntwo"
    article = '<nav>n</nav><article><h1>T</h1><p><b>a.<br><p>b &am</article><div class="ad">x, y, z</div><script>var a="</p>";</script>'
    assert html_text.main_text(article) == "T\na.\nb &am"
    assert [html_text.main_text(x) for x in (None, "", "<a <b <c", "plain", "<div>" * 5000 + "deep")] == ["", "", "", "plain", "deep"]


def test_main_text_in_named_containers():
    lines = [prose(i, 40).strip(" ,") for i in range(4)]
    body = "".join(f"<p>{x}</p>" for x in lines)
    links = '<ul><li><a href="a">One, two, three</a></li><li><a href="b">Four, five</a></li></ul>'
    noise = f'<div class="sidebar">{links}</div><div id="comments"><p>{prose(50, 90)}</p><p>{prose(51, 90)}</p></div>'
    for attrs in ("form id=aspnetForm", 'div class="wrap no-sidebar"', "div class=has-sidebar", "div class=content-widget", "div class=page-hidden-nav", "div class=cookies-recipe"):
        tag = attrs.split()[0]
        assert html_text.main_text(f"<body><{attrs}><h1>T</h1>{body}</{tag}><p>Ours</p></body>").split("\n")[:5] == ["T", *lines], attrs
        if "cookies" not in attrs:
            assert html_text.main_text(f"<body><{attrs}>{body}{noise}</{tag}></body>").split("\n") == lines, attrs
    assert html_text.main_text(f"<body><form><div class=no-sidebar>{body}</div></form></body>").split("\n") == lines
    widgets = "".join(f'<div class="x-widget"><p>{x}</p></div>' for x in lines)
    assert html_text.main_text(f"<body><div>{widgets}</div></body>").split("\n") == lines
    parts = f'<section class="related-work"><p>{lines[1]}</p></section><p class="notice">Note this</p><div class="related">{links}</div><form><p>Mail, name</p></form>'
    assert html_text.main_text(f"<article><p>{lines[0]}</p><p>{lines[2]}</p>{parts}</article>").split("\n") == [lines[0], lines[2]]
    consent = f'<div id="cookie-consent">{"".join(f"<p>{prose(i, 90)}</p>" for i in range(60, 80))}</div>'
    assert html_text.main_text(f"<body>{consent}<div>{body}</div></body>").split("\n") == lines


def test_pages(spark):
    rows = [(1, "u", PAGE, 1), (None, None, None, 2), (3, "v", "", 3)]
    got = [tuple(r) for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()]
    assert got[1:] == [(None, None, "", 0), (3, "v", "", 0)] and got[0][3] == len(got[0][2])


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    tagger = pii.Tagger.fresh()
    frames = [
        neardup.keep_one_of_each(empty), token_store.token_rows(empty), packing.packing_rows(empty), sharding.shard_documents(empty),
        decontaminate.find_leaks(empty, items), decontaminate.drop_leaked(empty, items), quality.judge_documents(empty, labels),
        licenses.scan_licenses(empty), pii.find_personal_data(empty, tagger), language.language_rows(empty),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
