"""Cases that once went wrong in the training-data operators, and the corpus pipeline as a whole."""

import collections
import random
import time
import zlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from scoreloom.llm import html_text, language, pii
from scoreloom.llm.encoder import WordEncoder, vocabulary

WORDS = "the river went under a stone bridge and many small houses stood there with green light on water".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ","]) for _ in range(n)).strip(", ")


# ------------------------------------------------------------------ token ids


@pytest.mark.parametrize("name, keeps_space", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_every_code_point_inside_a_word(name, keeps_space):
    path = vocabulary(name)
    texts = [f"un a{chr(c)}b {chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    ours, library = WordEncoder(path, keeps_space), Tokenizer.from_file(path)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, want) if array("I", w.ids).tobytes() != ours.encode(t)] == []


# ------------------------------------------------------------------ language


def test_numbers_are_no_letters():
    assert language.words_of("² ½ ① Ⅷ x² ⅷ") == ["x"]
    assert language.words_of("Plain ASCII-text 4you, ª") == ["plain", "ascii", "text", "you", "ª"]


def test_long_words_count_over_their_middle():
    """Halves of a long word give other counts than the word; the counts of a periodic word follow from short ones."""
    lattice = language.Lattice(vocabulary("piece_bpe_32k.model"))
    r = np.random.RandomState(0)
    probabilities = r.dirichlet(np.ones(lattice.size), 1)
    model = language.Unigrams(lattice, probabilities)
    for word in ("abracadabra", "nationalization" * 40, "日本" * 300):
        used = np.zeros(lattice.size)
        model.expected(0, word, 1.0, used)
        # every cut covers the marked word exactly once; a byte piece is a third of one of these letters
        names = sorted(lattice.pieces, key=lattice.pieces.get)
        covered = sum(u * len(n) for u, n in zip(used, names)) + used[lattice.first_byte :].sum() / 3
        assert covered == pytest.approx(len(word) + 1, rel=1e-9)
    # the derivative of the log probability by a log piece probability is the expected use of the piece
    word, step = "nationalization" * 20, 1e-4
    used = np.zeros(lattice.size)
    model.expected(0, word, 1.0, used)
    piece = int(np.argmax(used))
    moved = [probabilities.copy(), probabilities.copy()]
    moved[0][0, piece] *= np.exp(step)
    moved[1][0, piece] *= np.exp(-step)
    high, low = (language.Unigrams(lattice, p).word(word)[0] for p in moved)
    assert used[piece] == pytest.approx((high - low) / (2 * step), rel=1e-5)


# ------------------------------------------------------------------ main text


LINES = [prose(i, 45) for i in range(4)]
BODY = "".join(f"<p>{x}</p>" for x in LINES)
BLURB = "All rights to this text stay with us, and nobody may copy it or any part of it without a written word from our office."


@pytest.mark.parametrize(
    "part",
    [
        f"<p class=notice>{BLURB}</p>", f"<div class=notice><p>{BLURB}</p></div>", f'<div class="alert"><p>{BLURB}</p></div>', f"<div class=related><p>{BLURB}</p></div>",
        f"<div class=promotion>{BLURB}</div>", f"<div class=widget><p>{BLURB}</p></div>", f"<div class=hidden><p>{BLURB}</p></div>",
        f"<ol class=commentlist><li><p>{BLURB}</p></li></ol>", f"<div class=legal>{BLURB}</div>",
    ],
)
def test_parts_that_are_no_article(part):
    if "legal" not in part:
        assert html_text.main_text(f"<body><article>{BODY}{part}</article></body>").split("\n") == LINES
    assert html_text.main_text(f"<body><div class=content>{BODY}</div>{part}</body>").split("\n") == LINES


def test_deep_pages_take_linear_time():
    pages = ["<div>" * 10_000 + prose(1, 30) + "</div>" * 10_000, "<b>" * 20_000 + "</i>x" * 20_000, "<div class=menu>" * 5_000 + "t", "<div>a, b" * 10_000]
    for page in pages:
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 5


PAGE_PARTS = ["p", "div", "section", "ul", "blockquote"]


def test_generated_articles_come_back_whole():
    """Pages made from known blocks: the article's blocks come back in order, nothing else does."""
    for seed in range(60):
        r = random.Random(seed)
        want, inner = [], []
        for i in range(r.randint(3, 9)):
            text = prose(1000 * seed + i, r.randint(25, 60))
            kind = r.choice(PAGE_PARTS)
            marked = f"<b>{text[:9]}</b>{text[9:].replace(' and ', ' &#97;nd ')}"
            want.append(text)
            inner.append({"ul": f"<ul><li>{marked}</ul>", "blockquote": f"<blockquote><p>{marked}</p></blockquote>"}.get(kind, f"<{kind}>\n {marked}\n</{kind}>"))
        links = "".join(f'<li><a href="/{i}">{prose(i, 3)}</a>' for i in range(8))
        noise = [
            f"<nav><ul>{links}</ul></nav>", f'<div class="sidebar"><ul>{links}</ul><p>{prose(7, 20)}</p></div>', f"<footer><p>{prose(8, 30)}</p></footer>",
            f"<form><label>Mail</label><input name=m><p>{prose(9, 5)}</p></form>", f'<div id="comments"><p>{prose(10, 30)}</p></div>', "<script>if (a<b) {}</script>",
            f'<div class="ad-banner"><p>{prose(11, 10)}</p></div>', f"<style>p {{}}</style><aside><p>{prose(12, 30)}</p></aside>",
        ]
        r.shuffle(noise)
        cut = r.randint(0, len(noise))
        wrap = r.choice(["article", "main", "div class=post"])
        page = f"<html><head><title>T</title></head><body>{''.join(noise[:cut])}<{wrap}>{''.join(inner)}</{wrap.split()[0]}>{''.join(noise[cut:])}</body></html>"
        assert html_text.main_text(page).split("\n") == want, seed


# ------------------------------------------------------------------ personal data


def test_stretches_end_between_words():
    long = "a" * 90
    for text in (f"write to {long}@{long}.example now", f"x {long} @ {long}.example.edu, y", f"1{long} 2", "no digit"):
        for a, b in pii.zones(text):
            assert a == 0 or text[a - 1].isspace()
            assert b == len(text) or text[b].isspace()
    assert list(pii.zones("no digit")) == []


def test_long_and_spaced_addresses_are_masked_whole(spark):
    texts = [
        "Please ask first.last @ department.university.example.edu about it.", "Schreib an müller@universitätsbibliothek-heidelberg.example bitte.",
        f"{prose(1, 20)} jane.roe@example.org {prose(2, 20)}",
    ]
    forms = pii.Forms(3)
    more = [(i, f"{prose(i, 30)} mail {forms.email()} or {forms.look_alike()} {forms.phone()} {prose(i + 500, 12)}", "en", "s", 1) for i in range(100, 700)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + more, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in pii.mask_personal_data(docs).where("doc_id < 3").collect()}
    for i, rest in enumerate(("university", "heidelberg", "example.org")):
        assert rest not in out[i] and "[EMAIL]" in out[i], out[i]


# ------------------------------------------------------------------ the pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    good = [(i, prose(i, 120), "en", "s", 0, 9, "x") for i in range(60)]
    odd = [
        (100, good[0][1], "en", "t", 0, 9, "x"), (101, good[1][1] + " indeed", "en", None, 0, 9, "x"), (102, None, None, None, None, None, None), (103, "", "en", "s", 0, 9, "x"),
        (104, "short", "en", "s", 0, 9, "x"), (105, prose(105, 110) + " " + prose(900, 30), "en", "s", 0, 9, "x"), (106, prose(106, 110) + " mail jo@host.example.com now", "en", "s", 0, 9, "x"),
        (107, "spam spam " * 200, "en", "s", 0, 9, "x"), (2, good[2][1], "en", "s", 0, 9, "x"), (None, prose(108, 130), "en", "s", 0, 9, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, block long, ids string"  # the last two clash
    spark.createDataFrame(good + odd, schema).repartition(3, "source").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, prose(900, 30)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline(spark, folder):
    """Every stage against what has to happen to planted documents, the ids against the library on the masked texts."""
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, folder))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    assert not ids["quality rules"] & {102, 103, 104, 107}
    assert len(ids["quality rules"] & set(range(60))) >= 50 and None in ids["quality rules"]
    copies = [r.text for r in kept["near duplicates"]]
    assert len(copies) == len(set(copies)) and not {100, 101} & ids["near duplicates"]
    assert 105 in ids["near duplicates"] and 105 not in ids["decontamination"]
    assert ids["decontamination"] == ids["near duplicates"] - {105}
    clean = {r.doc_id: r.text for r in kept["personal data"]}
    assert set(clean) == ids["decontamination"] and "jo@host" not in clean[106] and "[EMAIL]" in clean[106]
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = collections.defaultdict(list)
    for r in kept["packing"]:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, np.uint32).tolist()))
    assert {k: [x for _, part in sorted(v) for x in part] for k, v in pieces.items()} == {
        k: library.encode(t, add_special_tokens=False).ids + [2] for k, t in clean.items()
    }


def test_pipeline_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
