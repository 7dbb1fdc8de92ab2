"""Language identification with segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary; each language has its own piece probabilities.  The
probability of a word in a language is the sum, over all ways to cut the word into pieces, of the product of
piece probabilities, found by a forward pass.  Pieces never cross words, so a text's probability is the
product over its words and every distinct word is scored once.

Training is expectation maximisation on distributed word counts: a task adds up the expected use of every
piece over all cuts of its words, Spark sums these per language and piece, and a piece's share becomes its next
probability.  Expected counts are rounded to millionths before they are summed, so the model does not depend on
the order of tasks.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import store

from .common import texts, to_arrow
from .encoder import vocabulary

MARKS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Mn", "Mc"))
_MARK = "[" + "".join(sorted(MARKS)) + "]"
WORD = re.compile(rf"[^\W\d_]+(?:(?=[\u0300-\U0010ffff]){_MARK}+[^\W\d_]*)*")  # no mark comes before U+0300
#: For ASCII texts: letters in lower case, everything else a space.
PLAIN = bytes(c | 32 if 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(128)) + bytes(128)
#: Signs that the pattern takes for letters but are numbers: superscripts, fractions, Roman numerals.
NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl") and c.isalnum())
NUMBER = re.compile("[" + "".join(sorted(NUMBERS)) + "]+")
START = "▁"
FLUSH_WORDS = 300_000
KEPT_WORDS = 300_000
BATCH_WORDS = 20_000
LONG_WORD = 24
SMOOTHING = 0.1
MICRO = 1_000_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and the combining marks that follow them."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(PLAIN).decode().split()
    words = WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    out = []
    for word in words:
        out += [word] if NUMBERS.isdisjoint(word) else WORD.findall(NUMBER.sub(" ", word))
    return out


class Lattice:
    """All ways to cut words into pieces of one vocabulary.

    Pieces are the vocabulary's entries made of letters and combining marks, with or without the word-start mark, in lower case.  A
    character that is no piece is one piece per UTF-8 byte, so every word has a cut.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        letters = lambda x: x.isalpha() or bool(x) and all(c.isalpha() or c in MARKS for c in x)
        own = [p for p in names if letters(bare := p.removeprefix(START)) and bare == bare.lower()]
        self.longest = max(map(len, own), default=1)
        self.pieces = {p: i for i, p in enumerate([START, *dict.fromkeys(own)])}
        self.first_byte = len(self.pieces)
        self.size = self.first_byte + 256
        # beginnings of pieces; ``size`` for one that is no piece itself
        self.starts = {p[:k]: self.size for p in self.pieces for k in range(1, len(p))} | self.pieces

    def arcs(self, word: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """``(start, end, pieces)`` of every arc over the marked word, by end."""
        marked, get, out = START + word, self.pieces.get, []
        n = len(marked)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                if (piece := get(marked[start:end])) is not None:
                    out.append((start, end, (piece,)))
                elif end - start == 1:
                    out.append((start, end, tuple(self.first_byte + b for b in marked[start].encode())))
        return out


class Unigrams:
    """Log-free forward and backward passes for all languages at once; scaled so that long words do not underflow."""

    def __init__(self, lattice: Lattice, probabilities: np.ndarray):
        self.lattice, self.p = lattice, probabilities  # languages x pieces

    def _weights(self, arcs: list) -> np.ndarray:
        """Languages x arcs."""
        single = self.p[:, [a[2][0] for a in arcs]]
        for i, a in enumerate(arcs):
            for piece in a[2][1:]:
                single[:, i] *= self.p[:, piece]
        return single

    def _forward(self, n: int, arcs: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alpha, scale = np.zeros((n + 1, len(self.p))), np.zeros((n + 1, 1))
        alpha[0] = 1
        at = 0
        for end in range(1, n + 1):
            base = scale[end - 1].copy()
            while at < len(arcs) and arcs[at][1] == end:
                start = arcs[at][0]
                alpha[end] += alpha[start] * w[:, at] * np.exp(scale[start] - base)
                at += 1
            top = alpha[end].max()
            if top < 1e-100:
                alpha[end] /= top
                base = base + np.log(top)
            scale[end] = base
        return alpha, scale

    def word(self, word: str) -> np.ndarray:
        """Log probability of a word in every language."""
        arcs = self.lattice.arcs(word)
        alpha, scale = self._forward(len(word) + 1, arcs, self._weights(arcs))
        return np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1]

    def _alike(self, words: list[str]) -> tuple[dict[int, list[int]], list[int]]:
        """Positions of the words by length, and of those that :meth:`word` must take one by one."""
        by_length, odd, pieces = {}, [], self.lattice.pieces
        for i, word in enumerate(words):
            if len(word) > LONG_WORD or not all(c in pieces for c in word):
                odd.append(i)
            else:
                by_length.setdefault(len(word), []).append(i)
        return by_length, odd

    def _table_arcs(self, words: list[str]) -> list[tuple[int, int, np.ndarray]]:
        """Arcs of words of one length: per stretch the piece of every word, ``lattice.size`` where there is none.

        From each place stretches grow only in the words whose stretch still begins a piece.
        """
        get, none, n, out = self.lattice.starts.get, self.lattice.size, len(words[0]) + 1, []
        marked = [START + w for w in words]
        for start in range(n):
            rows, left = np.arange(len(words)), marked
            for end in range(start + 1, min(n, start + self.lattice.longest) + 1):
                found = np.array([get(m[start:end], -1) for m in left])
                rows, found = rows[found >= 0], found[found >= 0]
                if not len(rows):
                    break
                if (found != none).any():
                    ids = np.full(len(words), none)
                    ids[rows] = found
                    out.append((start, end, ids))
                if end < n:
                    left = [marked[i] for i in rows.tolist()]
        return sorted(out, key=lambda arc: arc[1])

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities, words x languages; words of one length are passed together."""
        out = np.zeros((len(words), len(self.p)))
        table = np.concatenate((self.p, np.zeros((len(self.p), 1))), axis=1).T  # the last piece does not exist
        by_length, odd = self._alike(words)
        for i in odd:
            out[i] = self.word(words[i])
        for length, rows in by_length.items():
            alpha = np.zeros((length + 2, len(rows), len(self.p)))
            alpha[0] = 1
            for start, end, ids in self._table_arcs([words[i] for i in rows]):
                alpha[end] += alpha[start] * table[ids]
            out[rows] = np.log(np.maximum(alpha[-1], 1e-300))
        return out

    def expected_words(self, language: int, words: list[str], counts: list[int], into: np.ndarray) -> None:
        """Add the expected use of each piece in all copies of the words of one language."""
        p, n = np.append(self.p[language], 0.0), np.array(counts, float)
        by_length, odd = self._alike(words)
        for i in odd:
            self.expected(language, words[i], counts[i], into)
        for length, rows in by_length.items():
            arcs = self._table_arcs([words[i] for i in rows])
            alpha, beta = np.zeros((2, length + 2, len(rows)))
            alpha[0] = beta[-1] = 1
            for start, end, ids in arcs:
                alpha[end] += alpha[start] * p[ids]
            for start, end, ids in reversed(arcs):
                beta[start] += beta[end] * p[ids]
            share = n[rows] / alpha[-1]
            used = [alpha[start] * p[ids] * beta[end] * share for start, end, ids in arcs]
            into += np.bincount(np.concatenate([a[2] for a in arcs]), np.concatenate(used), len(p))[:-1]

    def expected(self, language: int, word: str, n: float, into: np.ndarray) -> None:
        """Add the expected number of times each piece is used in ``n`` copies of a word."""
        arcs = self.lattice.arcs(word)
        w = self._weights(arcs)[language].tolist()
        size = len(word) + 2
        alpha, beta = [0.0] * size, [0.0] * size
        alpha[0] = beta[-1] = 1.0
        for (start, end, _), x in zip(arcs, w):
            alpha[end] += alpha[start] * x
        if not alpha[-1] > 1e-250:
            return self._expected_logs(language, word, n, into)
        for (start, end, _), x in zip(reversed(arcs), reversed(w)):
            beta[start] += beta[end] * x
        for (start, end, pieces), x in zip(arcs, w):
            use = n * alpha[start] * x * beta[end] / alpha[-1]
            for piece in pieces:
                into[piece] += use

    def _expected_logs(self, language: int, word: str, n: float, into: np.ndarray) -> None:
        """The same in logarithms, for words whose probability is too small for plain numbers."""
        arcs = self.lattice.arcs(word)
        w = np.log(self.p[language])
        logs = [sum(float(w[piece]) for piece in pieces) for _, _, pieces in arcs]
        size = len(word) + 2
        alpha, beta = [-math.inf] * size, [-math.inf] * size
        alpha[0] = beta[-1] = 0.0
        for (start, end, _), x in zip(arcs, logs):
            alpha[end] = _log_sum(alpha[end], alpha[start] + x)
        for (start, end, _), x in zip(reversed(arcs), reversed(logs)):
            beta[start] = _log_sum(beta[start], beta[end] + x)
        for (start, end, pieces), x in zip(arcs, logs):
            use = n * math.exp(alpha[start] + x + beta[end] - alpha[-1])
            for piece in pieces:
                into[piece] += use


def _log_sum(a: float, b: float) -> float:
    """``log(exp(a) + exp(b))``."""
    high, low = max(a, b), min(a, b)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


class LanguageModel:
    """Languages, their priors and piece probabilities."""

    def __init__(self, languages: list[str], probabilities: np.ndarray, vocabulary_path: str):
        self.languages, self.probabilities, self.path = languages, probabilities, vocabulary_path

    @classmethod
    def fit(cls, docs: DataFrame, vocabulary_path: str | None = None, rounds: int = 2) -> LanguageModel:
        """Learn from rows with a ``lang`` (nulls are left out) and a ``text``; all their words count."""
        path = vocabulary_path or vocabulary("piece_bpe_32k.model")
        counts = store(word_counts(docs.where("lang is not null and text is not null")))
        languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
        size = Lattice(path).size
        probabilities = np.full((len(languages), size), 1 / size)
        model = cls(languages, probabilities, path)
        for _ in range(rounds if languages else 0):
            model = cls(languages, model._next(counts), path)
        return model

    def _next(self, counts: DataFrame) -> np.ndarray:
        schema = to_arrow(counts.sparkSession, "language int, piece int, uses long")
        languages, probabilities, path = self.languages, self.probabilities, self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unigrams, into = Unigrams(Lattice(path), probabilities), np.zeros(probabilities.shape)
            place = {x: i for i, x in enumerate(languages)}
            waiting: list[tuple[list, list]] = [([], []) for _ in languages]
            for batch in batches:
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                    words, uses = waiting[place[lang]]
                    words.append(word)
                    uses.append(n)
                    if len(words) >= BATCH_WORDS:
                        unigrams.expected_words(place[lang], words, uses, into[place[lang]])
                        waiting[place[lang]] = ([], [])
            for i, (words, uses) in enumerate(waiting):
                if words:
                    unigrams.expected_words(i, words, uses, into[i])
            rows, pieces = np.nonzero(into)
            uses = np.rint(into[rows, pieces] * MICRO).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(pieces, pa.int32()), pa.array(uses)], schema=schema)

        used = counts.select("lang", "word", "n").mapInArrow(run, "language int, piece int, uses long")
        total = np.full(self.probabilities.shape, SMOOTHING)
        for row in used.groupBy("language", "piece").agg(F.sum("uses").alias("uses")).collect():  # languages x pieces at most
            total[row.language, row.piece] += row.uses / MICRO
        return total / total.sum(axis=1, keepdims=True)

    def scores(self, rows: list[list[str]], unigrams: Unigrams, known: dict[str, int], table: np.ndarray) -> list[np.ndarray]:
        """Log probability per language of texts given as words; ``known`` and ``table`` keep words between calls."""
        counted = [Counter(words) for words in rows]
        if len(known) > KEPT_WORDS:
            known.clear()
        new = list(dict.fromkeys(w for c in counted for w in c if w not in known))
        for at in range(0, len(new), BATCH_WORDS):
            part, first = new[at : at + BATCH_WORDS], len(known)
            if first + len(part) > len(table):
                table.resize((2 * len(table) + len(part), table.shape[1]), refcheck=False)
            table[first : first + len(part)] = unigrams.words(part)
            known.update(zip(part, range(first, first + len(part))))
        out = []
        for c in counted:
            spots = np.fromiter(map(known.__getitem__, c), np.int64, len(c))
            out.append(np.fromiter(c.values(), float, len(c)) @ table[spots])
        return out

    def predict(self, docs: DataFrame) -> DataFrame:
        """Per row of ``doc_id`` and ``text``: ``lang_pred`` and ``score``, the posterior under equal priors.

        ``und`` with score 0 if the text is null or has no letter, or if nothing was learned.
        """
        schema = to_arrow(docs.sparkSession, "doc_id long, lang_pred string, score double")
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unigrams, known, table = _scorer(model)
            for batch in batches:
                ids, bodies = (c.to_pylist() for c in batch.columns)
                for at in range(0, len(ids), 500):
                    rows = [words_of(t) for t in bodies[at : at + 500]]
                    found, scores = [], []
                    for words, s in zip(rows, model.scores(rows, unigrams, known, table)):
                        if not words or not model.languages:
                            found.append("und")
                            scores.append(0.0)
                        else:
                            best = int(np.argmax(s))
                            found.append(model.languages[best])
                            scores.append(float(1 / np.exp(s - s[best]).sum()))
                    yield pa.RecordBatch.from_pydict({"doc_id": ids[at : at + 500], "lang_pred": found, "score": scores}, schema=schema)

        return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


_SCORERS: dict[str, tuple] = {}


def _scorer(model: LanguageModel) -> tuple[Unigrams, dict[str, int], np.ndarray]:
    """Lattice and known words of the model a worker process uses, kept from task to task; the last model only."""
    name = hashlib.md5(model.probabilities.tobytes()).hexdigest()
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = (Unigrams(Lattice(model.path), model.probabilities), {}, np.zeros((BATCH_WORDS, len(model.languages))))
    return _SCORERS[name]


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, n)`` over all rows; a task adds up what it has read before anything is shuffled."""
    schema = to_arrow(docs.sparkSession, "lang string, word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "word": list(c), "n": list(c.values())}, schema=schema)
            counts.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, counts.values())) > FLUSH_WORDS:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def language_rows(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Learn from the rows that are not held out, predict every row.

    A row is held out when crc32 of its id as text leaves 1 modulo 3; a null id never is.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = LanguageModel.fit(docs.where(~held_out).select("lang", "text"), vocabulary_path)
    return model.predict(docs).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


