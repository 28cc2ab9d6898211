"""Operator 8, personal data: base patterns and a bidirectional LSTM with CRF transitions.

The base patterns find e-mail addresses, IPv4 addresses, card and phone numbers
in their standard forms. A character-level BiLSTM-CRF, trained here in numpy from
labelled spans, adds spans in forms that the patterns miss: phone numbers
without a plus sign, cards with other separators, addresses with spaces about
the at sign. Base spans always stay; added ones never overlap them.

Every kind holds a digit or an at sign, so a text is read in the stretches about these
and the rest is skipped without loss. The network reads a stretch in windows of ``WINDOW``
characters that start every ``STRIDE``; of each character the emissions count that the
window makes in whose middle it lies. One Viterbi pass over the whole stretch, however
long, then decodes these emissions with the transitions: the windows are reconciled
by the best tag sequence of all, and a span may be longer than a window. Added spans must
pass the checks of their kind (``added``), which turn away dates, decimals and plain numbers.

The model learns from at most ``TRAIN_DOCS`` different texts, at most ``TRAIN_CHARS``
characters each, by way of ``TRAIN_WINDOWS`` windows. Labelled spans are those of the base patterns, as they stand or written
in another form (``_vary``), and numbers that are no personal data (``_number``) as
what to leave alone. Finding runs over all whole texts in place: no shuffle, and equal
results at any partitioning. Offsets count code points, ends are exclusive.

Defined cases: null and empty texts have no spans; very long texts are read whole;
repeated rows are treated alike; of tags with equal scores the first in the order of
``KINDS`` wins; an empty table gives an empty result; extra columns are ignored by
``find`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm.common import least_hashes, table

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_CHARS, TRAIN_WINDOWS = 500, 20_000, 12_000
WINDOW, STRIDE = 96, 48
Span = tuple[str, int, int]

_ASK = re.compile(r"[0-9@]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def valid(kind: str, s: str) -> bool:
    """Whether a stretch of text passes the checks of its kind."""
    if kind == "email":
        return "@" in s
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in parts)
    d = _digits(s)
    return 16 <= len(d) <= 19 and luhn(d) if kind == "card" else 8 <= len(d) <= 15


# Shapes of numbers that are no phone number: dates, years from and to, grouped and decimal numbers, plain runs.
_NUMBER = re.compile(
    r"[0-9]{4}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ][0-9]{2,4}|[0-9]{4} ?[-/] ?[0-9]{4}"
    r"|[0-9]{1,3}(?:[ .,][0-9]{3})+(?:[.,][0-9]+)?|[0-9]*[.,]?[0-9]+"
)
_LOOSE_PHONE = re.compile(r"\+?[(0-9][0-9 ()./-]+[0-9]")
_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+\s{0,2}@\s{0,2}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def added(kind: str, text: str, a: int, b: int) -> bool:
    """Whether a stretch that only the tagger finds may be one of its kind: no part of a longer word or number, and in a form of its kind."""
    s = text[a:b]
    if text[max(0, a - 1) : a].isalnum() or text[b : b + 1].isalnum() or not valid(kind, s):
        return False
    if kind == "email":
        return bool(_LOOSE_EMAIL.fullmatch(s))
    return kind != "phone" or bool(_LOOSE_PHONE.fullmatch(s)) and not _NUMBER.fullmatch(s) and len(_digits(s)) >= 9


def base_spans(text: str) -> list[Span]:
    """Leftmost matches that do not overlap within a kind, by kind, then start."""
    out: list[Span] = []
    if not _ASK.search(text):
        return out
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        end = domain.end() if domain else at + 1
        if domain:
            out.append(("email", start, end))
        at = text.find("@", end)
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# --- the tagger ---------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
EMBED, HIDDEN = 12, 24
_LETTER, _OTHER = 95, 96  # printable ASCII has its own codes
VOCABULARY = 98
_PAD = 97


def _codes(text: str) -> np.ndarray:
    p = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.where((p >= 32) & (p < 127), p - 32, np.where(p >= 0xC0, _LETTER, _OTHER))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _allowed() -> np.ndarray:
    """Additive mask of transitions: inside only follows begin or inside of its kind."""
    m = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        m[:, inside] = -1e4
        m[[inside - 1, inside], inside] = 0
    return m


class Tagger:
    """BiLSTM over character codes with a linear layer and CRF transitions; all in float32 numpy."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        w = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": w(VOCABULARY, EMBED), "O": w(2 * HIDDEN, TAGS), "o": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"X{d}": w(EMBED, 4 * HIDDEN), f"H{d}": w(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
        self.mask = _allowed()

    def _run(self, codes: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, batch, HIDDEN) of one direction; ``codes`` is (steps, batch) in its order."""
        p, h = self.p, HIDDEN
        table_ = p["E"] @ p[f"X{d}"] + p[f"c{d}"]
        steps, n = codes.shape
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out = np.empty((steps, n, h), np.float32)
        for t in range(steps):
            z = table_[codes[t]] + state @ p[f"H{d}"]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            before, cell = cell, f * cell + i * g
            squashed = np.tanh(cell)
            if keep is not None:
                keep.append((i, f, o, g, before, squashed, state))
            state = o * squashed
            out[t] = state
        return out

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(steps, batch, TAGS) scores for (steps, batch) codes."""
        both = np.concatenate([self._run(codes, "f"), self._run(codes[::-1], "b")[::-1]], axis=2)
        return both @ self.p["O"] + self.p["o"]

    def decode(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best tags of stretches whose emissions ``e`` (characters, TAGS) stand one after another; all advance together."""
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        trans = self.p["T"] + self.mask
        back = np.zeros((len(e), TAGS), np.int8)
        # a stretch begins outside or with the begin of a span
        score = e[starts] + np.where((np.arange(TAGS) % 2 == 0) & (np.arange(TAGS) > 0), -1e4, 0).astype(np.float32)
        tags, steps = np.zeros(len(e), np.int8), int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(steps + 1), "left")  # stretches longer than t
        for t in range(1, steps):
            n = active[t]
            paths = score[:n, :, None] + trans
            back[starts[:n] + t] = paths.argmax(axis=1)
            score[:n] = paths.max(axis=1) + e[starts[:n] + t]
        now = score.argmax(axis=1).astype(np.int8)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            tags[starts[:n] + t] = now[:n]
            now[:n] = back[starts[:n] + t, now[:n]]
        return tags

    def _step(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of one batch: CRF negative log-likelihood per character."""
        p, h = self.p, HIDDEN
        steps, n = codes.shape
        kept: dict[str, list] = {"f": [], "b": []}
        forth, back = self._run(codes, "f", kept["f"]), self._run(codes[::-1], "b", kept["b"])
        both = np.concatenate([forth, back[::-1]], axis=2)
        e = both @ p["O"] + p["o"]
        trans = p["T"] + self.mask

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = lse(alpha[-1], 1)
        one = np.eye(TAGS, dtype=np.float32)[gold]
        pair = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - log_z[None, :, None, None])
        scale = np.float32(1 / (n * steps))
        d_trans = (pair.sum(axis=(0, 1)) - np.einsum("tni,tnj->ij", one[:-1], one[1:])) * scale
        gold_score = np.take_along_axis(e, gold[:, :, None], 2).sum() + trans[gold[:-1], gold[1:]].sum()
        d_e = ((np.exp(alpha + beta - log_z[None, :, None]) - one) * scale).astype(np.float32)
        grads = {"T": d_trans.astype(np.float32), "O": np.einsum("tnh,tnk->hk", both, d_e), "o": d_e.sum(axis=(0, 1)), "E": np.zeros_like(p["E"])}
        d_both = d_e @ p["O"].T
        for d, d_out, seq in (("f", d_both[:, :, :h], codes), ("b", d_both[::-1, :, h:], codes[::-1])):
            d_state, d_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            d_table, d_h = np.zeros((VOCABULARY, 4 * h), np.float32), np.zeros_like(p[f"H{d}"])
            for t in range(steps - 1, -1, -1):
                i, f, o, g, before, squashed, state = kept[d][t]
                d_state = d_state + d_out[t]
                d_cell = d_cell + d_state * o * (1 - squashed * squashed)
                dz = np.concatenate([d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d_state * squashed * o * (1 - o), d_cell * i * (1 - g * g)], axis=1)
                np.add.at(d_table, seq[t], dz)
                d_h += state.T @ dz
                d_state, d_cell = dz @ p[f"H{d}"].T, d_cell * f
            grads |= {f"H{d}": d_h, f"c{d}": d_table.sum(axis=0), f"X{d}": p["E"].T @ d_table}
            grads["E"] += d_table @ p[f"X{d}"].T
        return float((log_z.sum() - gold_score) * scale), grads

    def train(self, codes: np.ndarray, tags: np.ndarray, steps: int = 600, batch: int = 32, rate: float = 0.02, seed: int = 7) -> float:
        """Adam over random batches of the windows (rows). The same rows give the same weights."""
        r = np.random.default_rng(seed)
        m, v, loss = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0.0
        for step in range(1, steps + 1):
            rows = r.integers(0, len(codes), batch)
            now, grads = self._step(codes[rows].T, tags[rows].T.astype(np.int64))
            loss = now if step == 1 else 0.9 * loss + 0.1 * now
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return loss


def _deal(form: str, digits: str) -> str:
    """The form with its marks ``d`` replaced by digits."""
    at = iter(digits)
    return "".join(next(at) if c == "d" else c for c in form)


# Forms of phone numbers without a plus sign, and of numbers that are no personal data.
PHONES = ("(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "ddd ddd dddd", "1-ddd-ddd-dddd", "00dd ddd ddd dddd", "00dd-ddd-ddddddd", "0ddd/ddddddd", "(0dd) dddd dddd")
NUMBERS = ("20dd-dd-dd", "19dd/dd/dd", "dd.dd.20dd", "d/dd/19dd", "20dd-dd-ddTdd:dd:dd", "dd:dd:dd", "d.dddddddd", "dd.dddd", "d,ddd,ddd.dd", "d ddd ddd", "19dd-20dd", "v d.d.dd", "dd.d.d", "No. dddddd", "#dddddddd", "INV-20dd-ddddd", "dddddddddd", "dddd", "dd", "d", "dd%", "$dd.dd", "ddxdd", "978-d-dd-dddddd-d", "10.dddd/dddddd", "user@", "@dddd", "p. ddd-ddd")


def _vary(kind: str, s: str, r: np.random.Generator) -> str:
    """A labelled span, as it stands or in a form that the base patterns miss."""
    some = "".join(map(str, r.integers(0, 10, 20)))
    if kind == "phone" and r.random() < 0.75:
        return s.lstrip("+") if r.random() < 0.15 else _deal(PHONES[int(r.integers(0, len(PHONES)))], some)
    if kind == "card" and r.random() < 0.5:
        d = _digits(s)
        return ("  ", ".", "/", "_", " - ")[int(r.integers(0, 5))].join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == "email" and r.random() < 0.7:
        word = lambda: "".join(map(chr, r.integers(97, 123, int(r.integers(2, 9)))))
        local, domain = s.rsplit("@", 1)
        if r.random() < 0.5:  # other names than those of the sample
            local, domain = (word(), f"{word()}.{word()[0]}", f"{word()}_{word()}")[int(r.integers(0, 3))], f"{word()}.{('com', 'org', 'net', 'de', 'co.uk')[int(r.integers(0, 5))]}"
        return local + ("@", " @ ", " @", "@ ")[int(r.integers(0, 4))] + domain
    return s


def _number(r: np.random.Generator) -> str:
    return _deal(NUMBERS[int(r.integers(0, len(NUMBERS)))], "".join(map(str, r.integers(0, 10, 20))))


def windows(texts: list[str], r: np.random.Generator, many: int = TRAIN_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """``many`` training windows of one or two labelled spans or other numbers between stretches of the texts, and stretches with digits but no span."""
    by_kind: dict[str, list[str]] = {}
    plain, quiet = [], []
    for text in texts:
        spans = base_spans(text)
        taken = np.zeros(len(text) + 1, bool)
        for kind, a, b in spans:
            taken[a:b] = True
            by_kind.setdefault(kind, []).append(text[a:b])
        hits = [m.start() for m in _ASK.finditer(text)]
        free = [a for a in hits if not taken[max(0, a - WINDOW) : a + WINDOW].any()]
        plain += [(text[max(0, a - WINDOW) : a], text[a : a + WINDOW]) for a in free[:: max(1, len(free) // 6)]]
        edges = [-1, *hits, len(text)]
        quiet += [text[a + 1 : b] for a, b in zip(edges, edges[1:], strict=False) if b - a > WINDOW]
    if not by_kind:
        return np.empty((0, WINDOW), np.int64), np.empty((0, WINDOW), np.int64)
    kinds, quiet = sorted(by_kind), quiet or [" "]

    def stretch() -> str:
        some = quiet[int(r.integers(0, len(quiet)))]
        at = int(r.integers(0, max(1, len(some) - WINDOW)))
        return some[at : at + WINDOW]

    codes, tags = np.full((many, WINDOW), _PAD, np.int64), np.zeros((many, WINDOW), np.int64)
    for c, g in zip(codes, tags, strict=True):
        if plain and r.random() < 0.1:
            left, right = plain[int(r.integers(0, len(plain)))]
            row = (left[len(left) - int(r.integers(0, len(left) + 1)) :] + right)[:WINDOW]
        else:
            row = stretch()[: int(r.integers(0, WINDOW // 2))]
            for _ in range(int(r.integers(1, 3))):
                row += (" ", " ", " (", ": ", "\n", "")[int(r.integers(0, 6))] if not row or row[-1].isalnum() else ""
                row += " " if row and row[-1].isalnum() else ""
                if r.random() < 0.6:
                    kind = kinds[int(r.integers(0, len(kinds)))]
                    span = _vary(kind, by_kind[kind][int(r.integers(0, len(by_kind[kind])))], r)
                    if len(row) + len(span) > WINDOW:
                        break
                    g[len(row)] = 1 + 2 * KINDS.index(kind)
                    g[len(row) + 1 : len(row) + len(span)] = 2 + 2 * KINDS.index(kind)
                    row += span
                else:
                    row += _number(r)
                row += (" ", " ", ", ", ". ", ") ", "\n", ": ", " or ")[int(r.integers(0, 8))] + stretch()[: int(r.integers(0, WINDOW // 3))]
            row = row[:WINDOW]
        c[: len(row)] = _codes(row)
    return codes, tags


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Tagger | None:
    """A tagger from a bounded sample of the texts that hold a digit or at sign; None if there are no spans to learn."""
    rows = docs.filter(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("h"), F.substring("text", 1, TRAIN_CHARS).alias("text"))
    texts = [r.text for r in least_hashes(rows, train_docs, docs.count(), 40)]
    codes, tags = windows(texts, np.random.default_rng(7))
    if not tags.any():
        return None
    model = Tagger()
    model.train(codes, tags)
    return model


def _stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text within ``STRIDE`` characters of a digit or at sign."""
    hit = np.array([m.start() for m in _ASK.finditer(text)], np.int64)
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 2 * STRIDE)
    first, last = hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])]
    return list(zip(np.maximum(first - STRIDE, 0).tolist(), np.minimum(last + STRIDE, len(text)).tolist(), strict=True))


def _stretch_emissions(model: Tagger, pieces: list[str], lanes: int) -> np.ndarray:
    """Emissions of all characters of the stretches, one after another, each from the window in whose middle it lies."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    many = np.maximum(1, -(-(sizes - STRIDE) // STRIDE))
    first = np.cumsum(many) - many
    offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.clip((offset - STRIDE // 2) // STRIDE, 0, np.repeat(many, sizes) - 1)
    window, place = np.repeat(first, sizes) + own, offset - own * STRIDE
    out = np.empty((len(offset), TAGS), np.float32)
    flat = np.concatenate([_codes(p) for p in pieces])
    start = np.repeat(np.cumsum(sizes) - sizes, many) + (np.arange(int(many.sum())) - np.repeat(first, many)) * STRIDE
    end = np.repeat(np.cumsum(sizes), many)
    edges = np.searchsorted(window, np.arange(0, len(start) + lanes, lanes))
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        at = start[k * lanes : (k + 1) * lanes, None] + np.arange(WINDOW)
        codes = np.where(at < end[k * lanes : (k + 1) * lanes, None], flat[np.minimum(at, len(flat) - 1)], _PAD)
        e = model.emissions(np.ascontiguousarray(codes.T))
        out[low:high] = e[place[low:high], window[low:high] - k * lanes]
    return out


def _whole(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The span with what belongs to its first and last word or number, without signs about it."""
    inside = _LOCAL if kind == "email" else "0123456789"
    while a < b and not (text[a] in inside or text[a] in "(+"):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    while a > 0 and text[a - 1] in inside:
        a -= 1
    while b < len(text) and text[b] in "0123456789":
        b += 1
    if kind == "email" and (m := _LOOSE_EMAIL.match(text, a)) and m.end() >= b - 1:
        b = m.end()
    return a, b


def tagged_spans(model: Tagger, texts: list[str], lanes: int = 2048) -> list[list[Span]]:
    """Spans that the tagger finds in each text, decoded over its whole stretches."""
    jobs = [(i, a, b) for i, t in enumerate(texts) for a, b in _stretches(t)]
    out: list[list[Span]] = [[] for _ in texts]
    at = 0
    while at < len(jobs):  # about ``lanes`` windows at a time, a long stretch by itself
        stop, size = at, 0
        while stop < len(jobs) and (stop == at or size + jobs[stop][2] - jobs[stop][1] <= lanes * STRIDE):
            size += jobs[stop][2] - jobs[stop][1]
            stop += 1
        some = jobs[at:stop]
        at = stop
        pieces = [texts[i][a:b] for i, a, b in some]
        sizes = np.array([len(p) for p in pieces], np.int64)
        tags = model.decode(_stretch_emissions(model, pieces, lanes), sizes)
        starts = np.cumsum(sizes) - sizes
        for x in np.flatnonzero(tags % 2 == 1).tolist():
            k = int(np.searchsorted(starts, x, "right")) - 1
            inside, y, stop_at = tags[x] + 1, x + 1, int(starts[k] + sizes[k])
            while y < stop_at and tags[y] == inside:
                y += 1
            i, a, _ = some[k]
            text, kind, a, b = texts[i], KINDS[(inside - 1) // 2], a + x - int(starts[k]), a + y - int(starts[k])
            a, b = _whole(kind, text, a, b)
            if added(kind, text, a, b) and (not out[i] or out[i][-1][2] <= a):
                out[i].append((kind, a, b))
    return out


def all_spans(model: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, base and added spans) of each text."""
    base = [base_spans(t) for t in texts]
    more = tagged_spans(model, texts) if model else [[] for _ in texts]
    return [(b, b + [s for s in m if all(s[2] <= x or y <= s[1] for _, x, y in b)]) for b, m in zip(base, more, strict=True)]


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    for i in range(0, batch.num_rows, 1000):
        yield i, [t or "" for t in batch.column(batch.schema.get_field_index(column)).slice(i, 1000).to_pylist()]


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """Per row: doc_id, counts of the base spans, their digest, and all spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in _texts(batch, "text"):
                both = all_spans(sent.value, texts)
                counts = [[sum(s[0] == k for s in b) for b, _ in both] for k in KINDS]
                digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in both]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1000), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array([joined(a) for _, a in both])],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _cut(text: str, spans: list[Span]) -> str:
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """``docs`` with every span replaced by ``<KIND>``; other columns unchanged but ``n_chars``, the new length."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for i, texts in _texts(batch, "text"):
                part = batch.slice(i, 1000)
                clean = [_cut(t, a) for t, (_, a) in zip(texts, all_spans(sent.value, texts), strict=True)]
                null = part.column(at).is_null().to_pylist()
                arrays = [pa.array([None if n else c for c, n in zip(clean, null, strict=True)], pa.string()) if k == at else part.column(k) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays(arrays, columns)

    out = docs.mapInArrow(work, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))


QUERIES = {"op8_pii": query}
SQL: dict[str, str] = {}
