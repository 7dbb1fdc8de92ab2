"""Personal data found by a character-level bidirectional LSTM with a CRF, beside the base rules.

The network is trained here, in numpy, from labelled spans: windows of the documents at hand with the spans that the
base rules find in them (a bounded sample by hash), and the same windows with further written forms of each kind, or
with look-alikes (dates, versions, prices, hashes), put in at random.  Decoding is constrained: a span of any kind holds a
digit or an ``@``.  Every window without one therefore has a single admissible labelling, no span, and only the
surroundings of such characters go through the network.

A text's windows overlap by half.  Each position takes its label from the window in which it stands farthest from
either end, so a span that one window cuts is read whole from its neighbour; spans are then formed once over the
whole text.  A found span is added if it has the form of its kind and touches no base span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, map_batches, texts
from .pii_rules import ANCHOR, KINDS, base_spans, digits_of, luhn, octet

WINDOW, STRIDE, MARGIN = 64, 32, 24
CHARS = 100
EMBED, HIDDEN = 10, 20
LABELS = 1 + 2 * len(KINDS)
FORBIDDEN = -1e4
SAMPLE, EPOCHS, BATCH, RATE, SEED = 1200, 7, 96, 0.02, 5
GAP = re.compile(r"\s")
HOST = re.compile(r"\s?@\s?[\w-]+(?:\.[\w-]+)+")
ADDRESS = re.compile(r"[\w.%+-]")
LATIN = "abcdefghijklmnopqrstuvwxyz"
IP6 = re.compile(r"[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}")


def char_ids(text: str) -> np.ndarray:
    """Printable ASCII by itself; one id each for other white space, other letters and the rest; 0 is padding."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.where((codes >= 32) & (codes < 127), codes - 31, 99)
    if (odd := np.flatnonzero(out == 99)).size:
        for i in odd:
            c = text[i]
            out[i] = 97 if c.isspace() else 98 if c.isalpha() else 99
    return out


def allowed() -> np.ndarray:
    """Transition mask: a span goes on only after it has begun."""
    mask = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        mask[:, inside] = FORBIDDEN
        mask[[inside - 1, inside], inside] = 0
    return mask


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions; ``params`` are plain arrays."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.params = params
        self.mask = allowed()
        self.first = np.zeros(LABELS)
        self.first[2::2] = FORBIDDEN

    @classmethod
    def fresh(cls, seed: int = SEED) -> Tagger:
        r = np.random.RandomState(seed)
        p = {"embed": r.randn(CHARS, EMBED) * 0.3, "trans": r.randn(LABELS, LABELS) * 0.05, "out": r.randn(2 * HIDDEN, LABELS) * 0.2, "out_b": np.zeros(LABELS)}
        for d in "fb":
            p[f"{d}x"] = r.randn(EMBED, 4 * HIDDEN) / EMBED**0.5
            p[f"{d}h"] = r.randn(HIDDEN, 4 * HIDDEN) / HIDDEN**0.5 * 0.5
            p[f"{d}b"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _lstm(self, chars: np.ndarray, d: str) -> dict:
        """Time-major pass over ``chars`` (steps x windows); padding leaves the state alone."""
        p, (steps, n) = self.params, chars.shape
        table = p["embed"] @ p[f"{d}x"] + p[f"{d}b"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        keep = {"h": [], "c": [], "gates": [], "tanh": [], "before": []}
        for t in range(steps):
            z = table[chars[t]] + h @ p[f"{d}h"]
            gates = np.empty_like(z)
            gates[:, : 3 * HIDDEN] = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            gates[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o, g = (gates[:, j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
            real = (chars[t] > 0)[:, None]
            keep["before"].append((h, c))
            new = f * c + i * g
            th = np.tanh(new)
            c, h = np.where(real, new, c), np.where(real, o * th, h)
            keep["gates"].append(gates)
            keep["tanh"].append(th)
            keep["h"].append(h)
        return keep

    def emissions(self, chars: np.ndarray) -> tuple[np.ndarray, dict, dict, np.ndarray]:
        """Windows x steps to scores (steps x windows x labels) and what the backward pass needs."""
        steps = chars.T
        fwd, bwd = self._lstm(steps, "f"), self._lstm(steps[::-1], "b")
        hidden = np.concatenate((np.stack(fwd["h"]), np.stack(bwd["h"][::-1])), axis=2)
        return hidden @ self.params["out"] + self.params["out_b"], fwd, bwd, hidden

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """Best labelling of every window (Viterbi); padding gets 0."""
        scores = self.emissions(chars)[0]
        steps, n, _ = scores.shape
        trans = self.params["trans"] + self.mask
        best, back = scores[0] + self.first, np.zeros((steps, n, LABELS), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + trans
            back[t] = ways.argmax(1)
            new = ways.max(1) + scores[t]
            real = (chars[:, t] > 0)[:, None]
            best = np.where(real, new, best)
            back[t] = np.where(real, back[t], np.arange(LABELS))
        out = np.zeros((n, steps), np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return np.where(chars > 0, out, 0)

    def _crf(self, scores: np.ndarray, gold: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss per window and its gradients by scores and transitions."""
        steps, n, _ = scores.shape
        trans = self.params["trans"] + self.mask
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        alpha = np.zeros(scores.shape)
        alpha[0] = scores[0] + self.first
        for t in range(1, steps):
            alpha[t] = np.where(real[t][:, None], lse(alpha[t - 1][:, :, None] + trans, 1) + scores[t], alpha[t - 1])
        total = lse(alpha[-1], 1)
        beta = np.zeros(scores.shape)
        grad_s, grad_t, loss = np.zeros(scores.shape), np.zeros(trans.shape), total.sum()
        rows = np.arange(n)
        for t in range(steps - 1, -1, -1):
            on = real[t][:, None]
            grad_s[t] = np.where(on, np.exp(alpha[t] + beta[t] - total[:, None]), 0)
            loss -= (scores[t][rows, gold[t]] * real[t]).sum()
            grad_s[t][rows, gold[t]] -= real[t]
            if t:
                pair = np.exp(np.minimum(alpha[t - 1][:, :, None] + trans + (scores[t] + beta[t])[:, None, :] - total[:, None, None], 0))
                grad_t += (pair * real[t][:, None, None]).sum(0)
                np.add.at(grad_t, (gold[t - 1], gold[t]), -real[t].astype(float))
                loss -= (trans[gold[t - 1], gold[t]] * real[t]).sum()
                beta[t - 1] = np.where(on, lse(trans + (scores[t] + beta[t])[:, None, :], 2), beta[t])
        return loss / n, (grad_s / n).astype(np.float32), np.where(self.mask < 0, 0, grad_t / n).astype(np.float32)

    def _back(self, d: str, chars: np.ndarray, keep: dict, above: np.ndarray, grads: dict) -> None:
        p, (steps, n) = self.params, chars.shape
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        into = np.zeros((CHARS, 4 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            dh = dh + above[t]
            real = (chars[t] > 0)[:, None]
            h0, c0 = keep["before"][t]
            gates, th = keep["gates"][t], keep["tanh"][t]
            i, f, o, g = (gates[:, j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
            inner = dc + dh * o * (1 - th * th)
            dz = np.concatenate((inner * g * i * (1 - i), inner * c0 * f * (1 - f), dh * th * o * (1 - o), inner * i * (1 - g * g)), axis=1)
            dz = np.where(real, dz, 0)
            grads[f"{d}h"] += h0.T @ dz
            np.add.at(into, chars[t], dz)
            dh, dc = np.where(real, dz @ p[f"{d}h"].T, dh), np.where(real, inner * f, dc)
        grads[f"{d}x"] += p["embed"].T @ into
        grads[f"{d}b"] += into.sum(0)
        grads["embed"] += into @ p[f"{d}x"].T

    def step(self, chars: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss of a batch and its gradients."""
        scores, fwd, bwd, hidden = self.emissions(chars)
        loss, ds, dt = self._crf(scores, gold.T, chars.T > 0)
        grads = {k: np.zeros_like(v) for k, v in self.params.items()}
        grads["trans"] += dt
        grads["out"] += np.einsum("tnh,tnl->hl", hidden, ds)
        grads["out_b"] += ds.sum((0, 1))
        above = ds @ self.params["out"].T
        self._back("f", chars.T, fwd, above[:, :, :HIDDEN], grads)
        self._back("b", chars.T[::-1], bwd, above[::-1, :, HIDDEN:], grads)
        return loss, grads

    def train(self, chars: np.ndarray, gold: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam over shuffled batches with a falling rate; the mean loss of each epoch."""
        r = np.random.RandomState(seed)
        m, v, t, losses = ({k: np.zeros_like(x) for k, x in self.params.items()} for _ in range(2)), None, 0, []
        m, v = m
        for epoch in range(epochs):
            order, sums = r.permutation(len(chars)), []
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                loss, grads = self.step(chars[rows], gold[rows])
                sums.append(loss)
                t += 1
                norm = sum(float((g * g).sum()) for g in grads.values()) ** 0.5
                clip, now = min(1.0, 5 / max(norm, 1e-9)), rate * (1 - 0.9 * epoch / max(1, epochs - 1))
                for k, g in grads.items():
                    g = g * np.float32(clip)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.params[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(sums)))
        return losses


def gold_labels(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Labels of a window from its spans; a later span does not overwrite an earlier one."""
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        a, b = max(a, 0), min(b, length)
        if a < b and not out[a:b].any():
            out[a:b] = 2 + 2 * KINDS.index(kind)
            out[a] -= 1
    return out


class Forms:
    """Written forms of personal data and of look-alikes, drawn at random."""

    def __init__(self, seed: int = SEED):
        self.r = np.random.RandomState(seed)

    def digits(self, n: int) -> str:
        return "".join(map(str, self.r.randint(0, 10, n)))

    def letters(self, n: int, pool: str = LATIN) -> str:
        return "".join(pool[i] for i in self.r.randint(0, len(pool), n))

    def pick(self, options: list):
        return options[self.r.randint(len(options))]

    def email(self) -> str:
        pool = self.pick([LATIN, LATIN, LATIN + "äöüßéèñç"])
        name = self.letters(self.r.randint(2, 9), pool) + self.pick(["", ".", "_", "-", "+"]) + self.pick([self.letters(4, pool), self.digits(2), ""])
        host = self.letters(self.r.randint(3, 8), pool) + self.pick(["", "", self.digits(1), "." + self.letters(self.r.randint(4, 11)), self.letters(9, pool) + "-" + self.letters(6)])
        return name.rstrip("._-+") + self.pick(["@", "@", " @ "]) + host + self.pick([".com", ".org", ".co.uk", ".example.com", ".de", ".net"])

    def ip(self) -> str:
        if self.r.rand() < 0.25:
            return ":".join(self.letters(self.r.randint(1, 5), "0123456789abcdef") for _ in range(8))
        return ".".join(str(x) for x in self.r.randint(0, 256, 4))

    def card(self) -> str:
        body = self.pick(["4", "5", "37", "6011"]) + self.digits(15)
        body = body[: self.pick([15, 15, 15, 14])]
        number = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        sign = self.pick(["", "", " ", "-", "."])
        return sign.join(number[i : i + 4] for i in range(0, len(number), 4))

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return self.pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{self.digits(2)} {a} {b} {c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"00{self.digits(2)} {a} {b}{c}"])

    def look_alike(self) -> str:
        d = self.digits
        year = f"{self.r.randint(1900, 2030)}"
        return self.pick(
            [
                f"{year}-0{self.r.randint(1, 10)}-1{d(1)}", f"{self.r.randint(1, 29)}/{self.r.randint(1, 13)}/{year}", f"version {d(1)}", f"{d(1)}.{d(1)}",
                f"${d(1)},{d(3)}.00", f"3.{d(5)}", f'token = "{self.letters(40, "0123456789abcdef")}"', f"{d(2)}:{d(2)}", f"{d(3)}%", year, d(2), d(4), d(5), d(7),
                f"ISBN 978-3-{d(2)}-{d(6)}-{d(1)}", f"#{d(4)}", f"{d(1)},{d(3)},{d(3)}", f"@{self.letters(7)}", f"v{d(1)}.{d(1)}.{d(1)}", f"CC BY-NC {d(1)}.0", self.letters(32, "0123456789abcdef"),
            ]
        )


def training_set(windows: list[str], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Each window as it is, and again with a form of a kind or a look-alike put in, labelled."""
    forms, rows = Forms(seed), []
    contexts = [w for w in windows if w] or ["the text around it goes on here and there"]
    for window in contexts:
        rows.append((window, base_spans(window)))
    for i in range(max(len(contexts), SAMPLE)):
        window = contexts[i % len(contexts)]
        if ANCHOR.search(window):
            window = re.sub(r"\S*[0-9@]\S*", "", window)
        kind = (*KINDS, None)[i % (len(KINDS) + 1)]
        piece = getattr(forms, kind)() if kind else forms.look_alike()
        cut = forms.r.randint(0, max(1, len(window) - len(piece)))
        left, right = window[:cut].rstrip(), window[cut:].lstrip()
        left = left + forms.pick([" ", " ", " ", "\n", ": ", " ("]) if left else ""
        text = left + piece + forms.pick([" ", " ", " ", ". ", ", ", "\n", ") "]) + right
        rows.append((text[: max(WINDOW, len(left) + len(piece))], [(kind, len(left), len(left) + len(piece))] if kind else []))
    chars, gold = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), np.int64)
    for i, (text, spans) in enumerate(rows):
        n = min(len(text), WINDOW)
        chars[i, :n] = char_ids(text[:n])
        gold[i, :n] = gold_labels(n, spans)
    return chars, gold


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and ``@`` that end between words; everything outside them has no admissible span."""
    start = end = None
    for m in ANCHOR.finditer(text):
        if end is not None and m.end() + MARGIN <= end:
            continue
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        while a > (end or 0) and not text[a - 1].isspace():
            a -= 1
        b = gap.start() if (gap := GAP.search(text, b)) else len(text)
        if end is not None and a <= end:
            end = b
            continue
        if end is not None:
            yield start, end
        start, end = a, b
    if end is not None:
        yield start, end


def cuts(start: int, end: int) -> Iterator[tuple[int, int]]:
    """Windows over a stretch, half overlapping, the last one flush with its end."""
    at = start
    while at + WINDOW < end:
        yield at, at + WINDOW
        at += STRIDE
    yield max(start, end - WINDOW) if at > start else at, end


def has_form(kind: str, text: str) -> bool:
    """Whether a found span can be of its kind at all."""
    digits = digits_of(text)
    if kind == "email":
        name, at, host = text.partition("@")
        return bool(at) and "@" not in host and bool(re.search(r"\w\s?$", name)) and bool(re.fullmatch(r"\s?[\w-]+(\.[\w-]+)+", host))
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and octet(p) for p in parts) or bool(IP6.fullmatch(text))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .\-]", text)
    return 9 <= len(digits) <= 15 and not re.search(r"[^0-9 ().+\-]", text)


def added_spans(tagger: Tagger, bodies: list[str | None], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """What the network adds to the base spans of each text."""
    where = [(i, a, b) for i, t in enumerate(bodies) if t for z in zones(t) for a, b in cuts(*z)]
    labels: dict[int, dict[int, tuple[int, int]]] = {}
    for at in range(0, len(where), 1024):
        part = where[at : at + 1024]
        chars = np.zeros((len(part), WINDOW), np.int64)
        for j, (i, a, b) in enumerate(part):
            chars[j, : b - a] = char_ids(bodies[i][a:b])
        for (i, a, b), row in zip(part, tagger.decode(chars)):
            known = labels.setdefault(i, {})
            whole = len(bodies[i])
            for k in range(b - a):
                inner = min(k if a else WINDOW, b - a - 1 - k if b < whole else WINDOW)
                if (old := known.get(a + k)) is None or inner > old[0]:
                    known[a + k] = (inner, int(row[k]))
    out: list[list[tuple[str, int, int]]] = [[] for _ in bodies]
    for i, known in labels.items():
        taken = [(a, b) for _, a, b in base[i]]
        for kind, a, b in _spans(known):
            text = bodies[i]
            while a < b and text[a].isspace():
                a += 1
            if kind == "email":
                a, b = _whole_address(text, a, b)
            while b > a and text[b - 1] in " \t\n.,;:":
                b -= 1
            if a < b and has_form(kind, text[a:b]) and all(b <= x or a >= y for x, y in taken):
                out[i].append((kind, a, b))
    return out


def _whole_address(text: str, a: int, b: int) -> tuple[int, int]:
    """An address does not begin or end inside a word, nor beside its own ``@``."""
    if "@" not in text[a:b]:
        if m := HOST.match(text, b):
            b = m.end()
        elif (at := text.rfind("@", max(0, a - 2), a)) >= 0 and text[at + 1 : a].strip() == "":
            a = at - 1 if text[at - 1 : at].isspace() else at
    while a > 0 and ADDRESS.match(text[a - 1]):
        a -= 1
    while b < len(text) and ADDRESS.match(text[b]):
        b += 1
    return a, b


def _spans(known: dict[int, tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    kind = start = last = None
    for place in sorted(known):
        label = known[place][1]
        own = None if not label else KINDS[(label - 1) // 2]
        if kind and (own != kind or label % 2 or place != last + 1):
            yield kind, start, last + 1
            kind = None
        if own and kind is None:
            kind, start = own, place
        last = place
    if kind:
        yield kind, start, last + 1


def fit_tagger(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Train on at most ``sample`` distinct windows around digits and ``@`` of the documents, those with the smallest hash."""

    def work(columns: dict[str, list]) -> Iterator[dict[str, list]]:
        found = {t[a:b] for t in columns["text"] if t for z in zones(t) for a, b in cuts(*z)}
        yield {"window": sorted(found)}

    rows = map_batches(docs.select(F.col("text").cast("string").alias("text")), work, "window string").distinct()
    windows = [r.window for r in rows.orderBy(F.xxhash64("window"), "window").limit(sample).collect()]
    tagger = Tagger.fresh()
    tagger.train(*training_set(windows))
    return tagger


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Per row the number of base spans of each kind, their digest, and all spans; a null or empty text has none."""
    tagger = tagger or fit_tagger(docs)

    def work(columns: dict[str, list]) -> Iterator[dict[str, list]]:
        base = [base_spans(t) for t in columns["text"]]
        more = added_spans(tagger, columns["text"], base)
        counts = {f"n_{k}": [sum(s[0] == k for s in spans) for spans in base] for k in KINDS}
        yield {
            "doc_id": columns["doc_id"],
            **counts,
            "base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base],
            "spans": [_joined(b + m) for b, m in zip(base, more)],
        }

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_batches(texts(docs), work, schema)


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span, or run of overlapping spans, replaced by the name of its kind."""
    if not spans:
        return text
    out, place, taken = [], 0, sorted(spans, key=lambda s: (s[1], -s[2]))
    while taken:
        kind, a, b = taken.pop(0)
        while taken and taken[0][1] < b:
            b = max(b, taken.pop(0)[2])
        out += [text[place:a], f"[{kind.upper()}]"]
        place = b
    return "".join(out) + text[place:]


def mask_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """All documents with personal data masked and ``n_chars`` brought in line where a text has changed."""
    tagger = tagger or fit_tagger(docs)
    rows = docs.select(*DOCUMENT_COLUMNS)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {'long' if kinds[c] == 'bigint' else kinds[c]}" for c in DOCUMENT_COLUMNS)

    def work(columns: dict[str, list]) -> Iterator[dict[str, list]]:
        base = [base_spans(t) for t in columns["text"]]
        more = added_spans(tagger, columns["text"], base)
        clean = [masked(t, b + m) for t, b, m in zip(columns["text"], base, more)]
        sizes = [len(new) if new != old else n for new, old, n in zip(clean, columns["text"], columns["n_chars"])]
        yield {**columns, "text": clean, "n_chars": sizes}

    return map_batches(rows, work, schema)
