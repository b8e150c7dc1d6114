"""Personal data in whole texts: base patterns, and a character BiLSTM with CRF transitions that adds spans they miss.

The tagger reads classes of characters with one LSTM in each direction and scores BIO tags of four kinds; a linear-chain
CRF with learned transitions gives the best tag sequence. It is trained in numpy, by back-propagation through the CRF's
forward-backward sums and both LSTMs, from labelled spans (``labelled_spans`` writes them: sentences of made-up words with
personal data in base and in disguised forms, and with numbers that are none).

A text is read in overlapping windows and decoded once: every character takes its tag scores from the window whose centre
is nearest, and one Viterbi path runs over the scores of the whole stretch of windows, so the transitions across a seam are
scored like any other and no span is cut at a window's edge. A span holds a digit, an @ or a written-out "(at)" by
definition of the labels; windows without one of these can yield no span and are not run, so a path ends where they begin.
Spans that touch a base span are left out: base spans stay as they are.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, STRIDE = 96, 48

IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_ANCHOR = re.compile(r"[0-9@]+|[(\[]\x20?at\x20?[)\]]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``EMAIL``. Each lies in one run of its characters; an @ whose right side fits ends the search for its left."""
    found, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return found


def ips(text: str) -> list[tuple[int, int]]:
    """Matches of ``IP`` whose parts are 255 at most: in a run of numbers joined by single dots, every four in turn.

    A run of digits is read once, however long; a number that no three numbers follow begins no match.
    """
    found = []
    for m in _DOTTED.finditer(text):
        at = m.start()
        parts = m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans; matches of a kind are leftmost and non-overlapping, failing ones are dropped without a retry."""
    found = [("email", s, e) for s, e in emails(text)]
    if re.search("[0-9]", text):
        found += [("ip", s, e) for s, e in ips(text)]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


# --- characters -------------------------------------------------------------------------------------------------------

_PUNCTUATION = "\n !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_CLASSES = 26 + 2 + len(_PUNCTUATION) + 3  # a-z, A-Z as one, 0-9 as one, punctuation, other letters, the rest, padding
PAD = N_CLASSES - 1


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point below 0x250; beyond, letters can't be told apart and count as the rest."""
    table = np.full(0x250, N_CLASSES - 2, np.int64)
    for c in range(0x250):
        ch = chr(c)
        if "a" <= ch <= "z":
            table[c] = c - 97
        elif "A" <= ch <= "Z":
            table[c] = 26
        elif "0" <= ch <= "9":
            table[c] = 27
        elif ch in _PUNCTUATION:
            table[c] = 28 + _PUNCTUATION.index(ch)
        elif ch.isalpha():
            table[c] = N_CLASSES - 3
    return table


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return class_table()[np.minimum(points, 0x24F)] if len(points) else np.zeros(0, np.int64)


# --- the tagger -------------------------------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """BiLSTM emissions and CRF transitions; ``hidden`` units in each direction."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, k = hidden, len(TAGS)
        self.h, self.k = h, k
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.2, (2 * h, k)), "bias": np.zeros(k), "trans": rng.normal(0, 0.1, (k, k)), "start": np.zeros(k)}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (N_CLASSES, 4 * h))
            self.p["x" + d][:, h : 2 * h] += 1  # the gates of memory start open
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))

    def lstm(self, ids: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (n, t, h) over (n, t) classes, in reading order for "f" and against it for "b"."""
        n, t = ids.shape
        h = self.h
        wx, u = self.p["x" + d].astype(np.float32), self.p["u" + d].astype(np.float32)
        out = np.zeros((n, t, h), np.float32)
        hs, cs = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = wx[ids[:, s]] + hs @ u
            gates = sigmoid(z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, prior = cs, hs
            cs = f * before + i * g
            tc = np.tanh(cs)
            hs = o * tc
            out[:, s] = hs
            if keep is not None:
                keep.append((s, i, f, o, g, before, tc, prior))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.lstm(ids, "f"), self.lstm(ids, "b")], axis=2) @ self.p["out"] + self.p["bias"]

    def viterbi(self, ids: np.ndarray) -> np.ndarray:
        """Best tags (n, t)."""
        e = self.emissions(ids)
        n, t, k = e.shape
        return self.best_paths(e.reshape(n * t, k), np.full(n, t)).reshape(n, t)

    def best_paths(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags of sequences of any lengths, whose scores follow each other in ``e`` (sum of lengths, k).

        Step s runs for all sequences that are longer than s at once; the memory is that of ``e`` and a byte for each score.
        """
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        first, down = starts[order], -lengths[order]
        best, back = self.p["start"] + e[first], np.zeros(e.shape, np.int8)
        going = [int(np.searchsorted(down, -s)) for s in range(int(lengths.max()))]
        for s in range(1, len(going)):
            m = going[s]
            options = best[:m, :, None] + self.p["trans"]
            back[first[:m] + s] = options.argmax(axis=1)
            best[:m] = options.max(axis=1) + e[first[:m] + s]
        tags, now = np.zeros(len(e), np.int64), best.argmax(axis=1)
        for s in range(len(going) - 1, -1, -1):
            at = first[: going[s]] + s
            tags[at] = now[: going[s]]
            now[: going[s]] = back[at, now[: going[s]]]
        return tags

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradients."""
        n, t = ids.shape
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.lstm(ids, "f", kept["f"]), self.lstm(ids, "b", kept["b"])], axis=2).astype(np.float64)
        e = states @ self.p["out"] + self.p["bias"]
        trans, start = self.p["trans"], self.p["start"]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = start + e[:, 0]
        step = np.exp(trans)
        for s in range(1, t):
            top = alpha[:, s - 1].max(axis=1, keepdims=True)
            alpha[:, s] = np.log(np.exp(alpha[:, s - 1] - top) @ step) + top + e[:, s]
        for s in range(t - 2, -1, -1):
            ahead = e[:, s + 1] + beta[:, s + 1]
            top = ahead.max(axis=1, keepdims=True)
            beta[:, s] = np.log(np.exp(ahead - top) @ step.T) + top
        top = alpha[:, -1].max(axis=1)
        z = np.log(np.exp(alpha[:, -1] - top[:, None]).sum(axis=1)) + top
        rows, steps = np.arange(n)[:, None], np.arange(t)[None, :]
        gold = e[rows, steps, tags].sum(axis=1) + start[tags[:, 0]] + trans[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        grads = {name: np.zeros_like(v) for name, v in self.p.items()}
        de = np.exp(alpha + beta - z[:, None, None])
        grads["start"] = de[:, 0].sum(axis=0) - np.bincount(tags[:, 0], minlength=self.k)
        de[rows, steps, tags] -= 1
        ahead = e[:, 1:] + beta[:, 1:]
        most, top = alpha[:, :-1].max(axis=2, keepdims=True), ahead.max(axis=2, keepdims=True)
        before = np.exp(alpha[:, :-1] - most) * np.exp(most + top - z[:, None, None])
        pair = step * np.einsum("nti,ntj->ij", before, np.exp(ahead - top), optimize=True)
        np.add.at(pair, (tags[:, :-1], tags[:, 1:]), -1)
        grads["trans"] = pair
        grads["out"] = states.reshape(n * t, -1).T @ de.reshape(n * t, -1)
        grads["bias"] = de.sum(axis=(0, 1))
        dstates = de @ self.p["out"].T
        for d, part in (("f", dstates[:, :, : self.h]), ("b", dstates[:, :, self.h :])):
            dh, dc, dzs = np.zeros((n, self.h)), np.zeros((n, self.h)), np.zeros((n, t, 4 * self.h))
            u = self.p["u" + d]
            for s, i, f, o, g, before, tc, prior in reversed(kept[d]):
                dh = dh + part[:, s]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dzs[:, s] = dz
                grads["u" + d] += prior.T @ dz
                dh, dc = dz @ u.T, dc * f
            grads["x" + d] = (ids.ravel() == np.arange(N_CLASSES)[:, None]).astype(float) @ dzs.reshape(n * t, -1)
        return float((z - gold).mean()), {name: g / n for name, g in grads.items()}

    def train(self, texts: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 600, batch: int = 48, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam over windows cut around the labelled texts; deterministic. Returns the losses."""
        rng = np.random.default_rng(seed)
        ids, tags = zip(*[windows_with_tags(t, s) for t, s in texts], strict=True)
        ids, tags = np.concatenate(ids), np.concatenate(tags)
        m, v, losses = {n: np.zeros_like(w) for n, w in self.p.items()}, {n: np.zeros_like(w) for n, w in self.p.items()}, []
        for step in range(1, steps + 1):
            pick = rng.choice(len(ids), min(batch, len(ids)), replace=False)
            loss, grads = self.gradients(ids[pick], tags[pick])
            losses.append(loss)
            norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
            now = rate * (1 - step / (steps + 1)) + 0.001
            for name, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-12))
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                self.p[name] = self.p[name] - now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
        return losses


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, s, e in spans:
        tags[s] = TAGS.index(f"B-{kind}")
        tags[s + 1 : e] = TAGS.index(f"I-{kind}")
    return tags


def windows_with_tags(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    ids, tags = classes_of(text), tags_of(len(text), spans)
    starts = range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)
    out = np.full((len(starts), WINDOW), PAD), np.zeros((len(starts), WINDOW), np.int64)
    for k, s in enumerate(starts):
        part = ids[s : s + WINDOW]
        out[0][k, : len(part)], out[1][k, : len(part)] = part, tags[s : s + WINDOW]
    return out


def labelled_spans(n: int = 900, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up sentences with labelled personal data, in base and disguised forms, and with numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[int(rng.integers(len(s)))]
    digits = lambda k: "".join(str(int(x)) for x in rng.integers(0, 10, k))
    word = lambda: "".join(pick(("th", "er", "on", "an", "re", "ver", "ung", "tion", "ment", "eau", "é", "ä", "ción", "os", "ta", "li", "no", "be", "ß", "ñ")) for _ in range(int(rng.integers(1, 4))))
    plain = lambda: "".join(pick(("th", "er", "on", "an", "re", "ma", "lo", "ki", "st")) for _ in range(int(rng.integers(1, 4))))

    def email() -> str:
        name = plain() + pick(("", ".", "_", "+")) + pick((plain(), digits(2)))
        if rng.random() < 0.4:
            return f"{name}@{plain()}{pick(('', digits(1)))}.{pick(('com', 'org', 'example.com', 'co.uk', 'de'))}"
        at, dot = pick(((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" @ ", " . "), ("@", " . "), (" (at) ", ".")))
        return f"{name}{at}{plain()}{dot}{pick(('com', 'org', 'net', 'de'))}"

    def ip() -> str:
        parts = [str(int(x)) for x in rng.integers(0, 256, 4)]
        return pick((".", ".", ". ", "[.]", " . ")).join(parts)

    def card() -> str:
        d = pick("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick((d, " ".join((d[:4], d[4:8], d[8:12], d[12:])), "-".join((d[:4], d[4:8], d[8:12], d[12:])), ".".join((d[:4], d[4:8], d[8:12], d[12:]))))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"001 {a} {b} {c}", f"+49 {a} {b}{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}"))

    def none() -> str:
        hexes = "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(8, 41))))
        return pick((digits(int(rng.integers(1, 7))), f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f'token = "{hexes}"', hexes, f"{digits(1)},{digits(3)}", f"{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(2)}", f"({digits(4)})", f"{digits(2)}%", f"@{plain()}", digits(int(rng.integers(8, 12))), f"#{digits(4)}"))

    made = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        parts, spans, at = [], [], 0
        for _ in range(int(rng.integers(6, 14))):
            roll = rng.random()
            kind = pick(KINDS) if roll < 0.18 else ""
            piece = made[kind]() if kind else none() if roll < 0.30 else word()
            if kind:
                spans.append((kind, at, at + len(piece)))
            junk = pick(("", "", "", "", "%%%", "###", "&&&", ".", ","))
            parts.append(piece + junk + pick((" ", " ", " ", " ", "\n")))
            at += len(parts[-1])
        out.append(("".join(parts), spans))
    return out


_MODELS: dict[tuple, Tagger] = {}


def trained(hidden: int = 16, steps: int = 600) -> Tagger:
    """The tagger trained on the driver from ``labelled_spans``; kept for the session."""
    if (hidden, steps) not in _MODELS:
        tagger = Tagger(hidden)
        tagger.train(labelled_spans(), steps)
        _MODELS[hidden, steps] = tagger
    return _MODELS[hidden, steps]


# --- decoding ---------------------------------------------------------------------------------------------------------


def window_starts(text: str) -> list[int]:
    """Starts of the windows, on a grid of ``STRIDE``, that hold an anchor."""
    found: dict[int, None] = {}
    for m in _ANCHOR.finditer(text):
        for k in range(max(0, (m.start() - WINDOW) // STRIDE + 1), (m.end() - 1) // STRIDE + 1):
            found[k * STRIDE] = None
    return list(found)


def spans_in(tags: np.ndarray, text: str, base: int) -> list[tuple[str, int, int]]:
    """Spans of runs of tags; a run keeps the kind it begins with, and needs an anchor."""
    spans, n, i = [], len(tags), 0
    while i < n:
        if tags[i] == 0:
            i += 1
            continue
        kind, j = (int(tags[i]) - 1) // 2, i + 1
        while j < n and tags[j] == 2 * kind + 2:
            j += 1
        start, end = base + i, base + j
        while end > start and text[end - 1] in " \n.,":
            end -= 1
        while start < end and text[start] in " \n":
            start += 1
        if end - start >= 5 and _ANCHOR.search(text, start, end):
            spans.append((KINDS[kind], start, end))
        i = j
    return spans


def plausible(kind: str, piece: str) -> bool:
    """What the base patterns ask of the kind's digits, whatever stands between them."""
    digits = "".join(re.findall("[0-9]", piece))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "ip":
        parts = re.findall("[0-9]+", piece)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return "@" in piece or "at" in piece


def decode(tagger: Tagger, texts: list[str], rows: int = 512) -> list[list[tuple[str, int, int]]]:
    """Spans of the tagger in each text."""
    places, ids = [], []
    for k, text in enumerate(texts):
        starts = window_starts(text)
        if not starts:
            continue
        own = classes_of(text)
        for s in starts:
            part = own[s : s + WINDOW]
            ids.append(np.pad(part, (0, WINDOW - len(part)), constant_values=PAD))
            places.append((k, s))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not ids:
        return out
    lap = (WINDOW - STRIDE) // 2
    parts, stretches = [], []  # the scores that each window decides, and (text, start, length) of the windows that follow each other
    for a in range(0, len(ids), rows):
        for w, scores in enumerate(tagger.emissions(np.stack(ids[a : a + rows])).astype(np.float32), a):
            k, s = places[w]
            begins = w == 0 or places[w - 1] != (k, s - STRIDE)
            ends = w + 1 == len(places) or places[w + 1] != (k, s + STRIDE)
            part = scores[0 if begins else lap : min(WINDOW if ends else WINDOW - lap, len(texts[k]) - s)]
            parts.append(part)
            if begins:
                stretches.append([k, s, 0])
            stretches[-1][2] += len(part)
    lengths = np.array([n for _, _, n in stretches])
    tags = tagger.best_paths(np.concatenate(parts), lengths)
    for (k, s, n), end in zip(stretches, np.cumsum(lengths), strict=True):
        out[k] += spans_in(tags[end - n : end], texts[k], s)
    return out


def added_spans(tagger: Tagger, texts: list[str], bases: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    out = []
    for text, base, found in zip(texts, bases, decode(tagger, texts), strict=True):
        ends = sorted((e, s) for _, s, e in base)
        most, reach = [], -1  # base spans by their ends; of two that overlap each other either may touch a found one
        for e, s in reversed(ends):
            reach = s if reach < 0 else min(reach, s)
            most.append((e, reach))
        most.reverse()
        own = []
        for kind, s, e in found:
            k = bisect.bisect_right(most, (s, 1 << 62))
            if plausible(kind, text[s:e]) and not (k < len(most) and most[k][1] < e):
                own.append((kind, s, e))
        out.append(own)
    return out


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def _scan(tagger: Tagger, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, group):
                rows = whole.slice(at, group)
                texts = [t.as_py() or "" for t in rows.column(1)]
                bases = [base_spans(t) for t in texts]
                added = added_spans(tagger, texts, bases)
                counts = [pa.array([sum(k == kind for k, _, _ in b) for b in bases], pa.int64()) for kind in KINDS]
                sums = pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b in bases], pa.string())
                spans = pa.array([digest(b + a) for b, a in zip(bases, added, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), *counts, sums, spans, pa.array([len(a) for a in added], pa.int64())], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return run


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text", group: int = 500) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, counts of base spans, ``base_sha256``, ``spans``, ``n_added``.

    Null texts count as empty; null ids and repeated rows stay; an empty table gives no rows; other columns aren't read. Texts
    of any length are read whole, in overlapping windows where the tagger runs. One pass without a shuffle.
    """
    tagger = tagger or trained()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = "id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint"
    return rows.mapInArrow(_scan(tagger, group), schema).withColumnRenamed("id", id_col)
