"""Personal data in texts: patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns (emails, IP addresses, card and phone numbers) are certain and always
stay. The network adds what they miss: the same kinds of data in other spellings. It
reads every text whole, in overlapping windows of character classes; the best path of
tags through each window comes from the CRF; and the windows' spans are reconciled in
the text's own offsets: spans of one kind that meet are one span, and of two kinds
the longer stays. An exact check (digits, Luhn, shape) then drops what cannot be.

The network is trained here, in numpy, from labelled spans: those that the patterns
find in a bounded sample of texts, and rewritten ones put into lines of that sample.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import shared

KINDS = ("email", "ip", "card", "phone")
#: Tag 0 is none of them.
TAGS = 1 + len(KINDS)

# ------------------------------------------------------------------ patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What may follow an at sign, and the other kinds; possessive, so that long runs cost no more than their length.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost matches per kind, kinds in the order of KINDS.

    A match's local part lies before one at sign, so addresses are found from their at
    signs; the other patterns are read from left to right. All of it is linear.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# ------------------------------------------------------------------ what the network reads

_MARKS = " \n.@-+()[]_:/,=\"'%&"
#: Letters a to z (with A to Z), a digit, each mark, other ASCII, anything else.
CLASSES = 26 + 1 + len(_MARKS) + 2
_CLASS = np.full(129, CLASSES - 2, np.int64)
_CLASS[128] = CLASSES - 1
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = _i
_CLASS[48:58] = 26
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 27 + _i
_CLASS[9] = _CLASS[13] = _CLASS[32]


def classes(text: str) -> np.ndarray:
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def softsign(x):
    """The network's squashing: several times cheaper than tanh; a gate is (1 + softsign) / 2."""
    return x / (1 + np.abs(x))


def _slope(y):
    """softsign's derivative, from its value."""
    return (1 - np.abs(y)) ** 2


class Tagger:
    """The network: two LSTMs of ``hidden`` units over classes, emissions from both, CRF transitions.

    ``p`` holds ``wx`` (direction, class, gate), ``wh`` (direction, unit, gate), ``b`` (direction, gate),
    ``we`` (2 * unit, tag), ``be`` and ``tr`` (from tag, to tag). Gates stand as input, forget, output, cell.
    """

    def __init__(self, hidden: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.p = {
            "wx": rng.normal(0, 0.3, (2, CLASSES, 4 * h)),
            "wh": rng.normal(0, 0.3, (2, h, 4 * h)),
            "b": np.zeros((2, 4 * h)),
            "we": rng.normal(0, 0.3, (2 * h, TAGS)),
            "be": np.zeros(TAGS),
            "tr": np.zeros((TAGS, TAGS)),
        }
        self.p["b"][:, h : 2 * h] = 1.0
        self.p["be"][0] = 1.0

    # --- training, on windows of one length

    def _run(self, x: np.ndarray):
        """Hidden states (direction, step, window, unit) of classes (window, step), and what gradients need."""
        h, (n, steps) = self.hidden, x.shape
        both = np.stack([x, x[:, ::-1]])
        z_in = self.p["wx"][np.arange(2)[:, None, None], both] + self.p["b"][:, None, None]
        hs, cs = np.zeros((2, steps + 1, n, h)), np.zeros((2, steps + 1, n, h))
        gates = np.empty((2, steps, n, 4 * h))
        for t in range(steps):
            z = z_in[:, :, t] + hs[:, t] @ self.p["wh"]
            g = gates[:, t]
            g[...] = softsign(z)
            g[..., : 3 * h] = (1 + g[..., : 3 * h]) / 2
            cs[:, t + 1] = g[..., h : 2 * h] * cs[:, t] + g[..., :h] * g[..., 3 * h :]
            hs[:, t + 1] = g[..., 2 * h : 3 * h] * softsign(cs[:, t + 1])
        return both, hs, cs, gates

    def _emit(self, hs: np.ndarray) -> np.ndarray:
        forth, back = hs[0, 1:], hs[1, :0:-1]
        return np.concatenate([forth, back], 2) @ self.p["we"] + self.p["be"]

    def loss_and_gradients(self, x: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood of tag paths, and its gradients."""
        h, (n, steps) = self.hidden, x.shape
        both, hs, cs, gates = self._run(x)
        e, tr, rows = self._emit(hs), self.p["tr"], np.arange(n)
        alpha, beta = np.empty((steps, n, TAGS)), np.zeros((steps, n, TAGS))

        def lse(a, axis):
            m = a.max(axis, keepdims=True)
            return np.log(np.exp(a - m).sum(axis)) + m.squeeze(axis)

        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + tr, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(tr + (e[t + 1] + beta[t + 1])[:, None], 2)
        log_z = lse(alpha[-1], 1)
        path = e[np.arange(steps)[:, None], rows, tags.T].sum(0) + tr[tags[:, :-1], tags[:, 1:]].sum(1)
        d_e = np.exp(alpha + beta - log_z[:, None])
        d_e[np.arange(steps)[:, None], rows, tags.T] -= 1
        pair = np.exp(alpha[:-1, :, :, None] + tr + (e[1:] + beta[1:])[:, :, None] - log_z[:, None, None]).sum((0, 1))
        np.subtract.at(pair, (tags[:, :-1], tags[:, 1:]), 1)
        d = {"tr": pair, "be": d_e.sum((0, 1)), "we": np.einsum("tnh,tnk->hk", np.concatenate([hs[0, 1:], hs[1, :0:-1]], 2), d_e)}
        d_h = d_e @ self.p["we"].T
        d_h = np.stack([d_h[..., :h], d_h[::-1, :, h:]])
        d |= {k: np.zeros_like(self.p[k]) for k in ("wx", "wh", "b")}
        next_h, next_c = np.zeros((2, n, h)), np.zeros((2, n, h))
        for t in range(steps - 1, -1, -1):
            i, f, o, g = (gates[:, t, :, k * h : (k + 1) * h] for k in range(4))
            out = softsign(cs[:, t + 1])
            dh = d_h[:, t] + next_h
            dc = next_c + dh * o * _slope(out)
            dz = np.concatenate([dc * g * _slope(2 * i - 1) / 2, dc * cs[:, t] * _slope(2 * f - 1) / 2, dh * out * _slope(2 * o - 1) / 2, dc * i * _slope(g)], 2)
            d["wh"] += hs[:, t].swapaxes(1, 2) @ dz
            d["b"] += dz.sum(1)
            for way in range(2):
                np.add.at(d["wx"][way], both[way, :, t], dz[way])
            next_h, next_c = dz @ self.p["wh"].swapaxes(1, 2), dc * f
        return float((log_z - path).mean()), {k: v / n for k, v in d.items()}

    def fit(self, x: np.ndarray, tags: np.ndarray, *, steps: int = 1000, batch: int = 48, rate: float = 0.02, seed: int = 5) -> float:
        """Adam with a falling rate; the last loss."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        loss = 0.0
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(x), min(batch, len(x)))
            loss, d = self.loss_and_gradients(x[rows], tags[rows])
            scale = min(1.0, 5.0 / max(1e-9, math.sqrt(sum(float((g * g).sum()) for g in d.values()))))
            for k, g in d.items():
                m[k] = 0.9 * m[k] + 0.1 * scale * g
                v[k] = 0.99 * v[k] + 0.01 * (scale * g) ** 2
                now = rate * (1 + math.cos(math.pi * step / steps)) / 2
                self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return loss

    # --- reading

    def weights(self) -> dict[str, np.ndarray]:
        """32-bit weights for reading: gates apart, biases added to the classes'."""
        h = self.hidden
        p = {k: v.astype(np.float32) for k, v in self.p.items()}
        by_gate = (self.p["wx"] + self.p["b"][:, None]).reshape(2, CLASSES, 4, h).transpose(0, 2, 1, 3)
        return p | {"wx": by_gate.astype(np.float32, order="C"), "wh": p["wh"].reshape(2, h, 4, h).transpose(2, 0, 1, 3).copy()}


def emissions(p: dict[str, np.ndarray], both: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Emissions (step, window, tag) of windows, longest first: ``both`` has the classes (direction, window, step),
    the second direction's reversed within each window."""
    h = p["wh"].shape[-1]
    _, n, steps = both.shape
    live = np.searchsorted(-size, -np.arange(steps), "left")  # windows longer than t
    we = p["we"].reshape(2, h, TAGS)
    each = np.zeros((2, steps, n, TAGS), np.float32)
    state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
    for t in range(steps):
        k = live[t]
        s, c = state[:, :k], cell[:, :k]
        z = s @ p["wh"]  # (gate, direction, window, unit)
        for way in range(2):
            z[:, way] += p["wx"][way].take(both[way, :k, t], 1)
        extent = np.abs(z)
        extent += 1
        z /= extent
        gates = z[:3]
        gates *= 0.5
        gates += 0.5
        c *= z[1]
        c += z[0] * z[3]
        np.multiply(softsign(c), z[2], out=s)
        np.matmul(s, we, out=each[:, t, :k])
    out = each[0] + p["be"]
    whole = int(np.searchsorted(-size, -steps, "right"))
    out[:, :whole] += each[1, ::-1, :whole]
    turned = np.maximum(size[None, whole:] - 1 - np.arange(steps)[:, None], 0)
    out[:, whole:] += np.take_along_axis(each[1, :, whole:], turned[:, :, None], 0)
    return out


def best_paths(p: dict[str, np.ndarray], e: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best tags (step, window); 0 beyond a window's end.

    Windows in which no step's emissions can pay for leaving tag 0 hold only tag 0: the others alone are searched.
    """
    steps, n, _ = e.shape
    tr = p["tr"]
    gain = max(0.0, float((tr[:, 1:] - tr[0, 0]).max())) + max(0.0, float((tr[1:, 0] - tr[0, 0]).max()))
    inside = np.arange(steps)[:, None] < size
    most = e[..., 1].copy()
    for k in range(2, TAGS):
        np.maximum(most, e[..., k], out=most)
    open_ = np.flatnonzero(((most + gain > e[..., 0]) & inside).any(0))
    tags = np.zeros((steps, n), np.int8)
    if not len(open_):
        return tags
    # tags before windows: every step then works on whole rows of windows
    e, inside = np.ascontiguousarray(e[:, open_].transpose(0, 2, 1)), inside[:, open_]
    scores = np.empty_like(e)
    scores[0] = e[0]
    for t in range(1, steps):
        np.max(scores[t - 1][:, None] + tr[:, :, None], axis=0, out=scores[t])
        scores[t] += e[t]
        np.copyto(scores[t], scores[t - 1], where=~inside[t])
    now = np.zeros(len(open_), np.int8)
    best = scores[-1][0].copy()
    for k in range(1, TAGS):
        now[scores[-1][k] > best] = k
        np.maximum(best, scores[-1][k], out=best)
    for t in range(steps - 1, -1, -1):
        tags[t, open_] = now * inside[t]
        if t:  # the first of the best tags before the one that stands
            into = scores[t - 1] + tr[:, now]
            before, best = np.zeros(len(open_), np.int8), into[0]
            for k in range(1, TAGS):
                np.copyto(before, np.int8(k), where=into[k] > best)
                np.maximum(best, into[k], out=best)
            now = np.where(inside[t], before, now)
    return tags


WINDOW, OVERLAP = 512, 64
#: Windows read at once.
TOGETHER = 1024


def window_starts(n: int) -> list[int]:
    """Windows of a text of n characters; neighbours share OVERLAP, the last may be shorter."""
    return list(range(0, max(1, n - OVERLAP), WINDOW - OVERLAP)) if n else []


def reconciled(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(tag, start, end) of all windows -> spans that share nothing: of one tag joined, of two the longer (then the first)."""
    joined: list[list[int]] = []
    for tag, start, end in sorted(set(spans)):
        if joined and joined[-1][0] == tag and start <= joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], end)
        else:
            joined.append([tag, start, end])
    joined.sort(key=lambda s: (s[1], -(s[2] - s[1]), s[0]))
    kept: list[list[int]] = []
    for span in joined:
        while kept and kept[-1][2] > span[1] and span[2] - span[1] > kept[-1][2] - kept[-1][1]:
            kept.pop()
        if not kept or kept[-1][2] <= span[1]:
            kept.append(span)
    return [tuple(s) for s in kept]


_WRITTEN_EMAIL = re.compile(
    r"[\w.%+-]+ ?(?:@|[\[(] ?at ?[\])]|\bat\b) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(] ?dot ?[\])]|\bdot\b) ?[A-Za-z0-9-]+)+", re.I
)
_DATE = re.compile(r"\d{4}[-/.]\d\d?[-/.]\d\d?|\d\d?[-/.]\d\d?[-/.]\d{4}")


def possible(kind: str, text: str) -> bool:
    """Whether a text can be what the network takes it for."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == "email":
        return _WRITTEN_EMAIL.fullmatch(text) is not None
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"\d(?:[ ._/-]{0,2}\d)+", text) is not None
    if kind == "ip":
        return re.fullmatch(r"\d{1,3}(?: ?(?:[.,]|[\[(] ?(?:\.|dot) ?[\])]|dot) ?\d{1,3}){3}", text) is not None and all(_byte(x) for x in _NOT_DIGIT.split(text))
    shape = re.fullmatch(r"(?:\+|00 ?)?\(?\d+\)?(?:[ ./-]{1,3}\(?\d+\)?)+", text)
    return shape is not None and 8 <= len(digits) <= 15 and _DATE.fullmatch(text) is None


def snapped(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without outer spaces and punctuation, and with its cut words and numbers whole."""

    def same(a: int, b: int) -> bool:
        return text[a].isalnum() and text[b].isalnum()

    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not (text[end - 1].isalnum()):
        end -= 1
    if start < end:
        low, high = max(0, start - OVERLAP), min(len(text), end + OVERLAP)
        while start > low and same(start - 1, start):
            start -= 1
        while end < high and same(end, end - 1):
            end += 1
        if text[start - 1 : start] in ("+", "(") and start and text[start].isdigit():
            start -= 1
    return start, end


def read_texts(p: dict[str, np.ndarray], texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The network's reconciled (tag, start, end) of each text."""
    rows, codes = [], []
    for i, text in enumerate(texts):
        codes.append(classes(text).astype(np.uint8))
        rows += [(i, s, min(WINDOW, len(codes[-1]) - s)) for s in window_starts(len(codes[-1]))]
    rows.sort(key=lambda r: -r[2])
    spans: list[list] = [[] for _ in texts]
    for first in range(0, len(rows), TOGETHER):
        some = rows[first : first + TOGETHER]
        size = np.array([r[2] for r in some])
        both = np.zeros((2, len(some), int(size[0])), np.uint8)
        for j, (i, s, k) in enumerate(some):
            both[0, j, :k] = codes[i][s : s + k]
            both[1, j, :k] = codes[i][s : s + k][::-1]
        tags = best_paths(p, emissions(p, both, size), size).T
        for j in np.flatnonzero(tags.any(1)):
            i, s, _ = some[j]
            edges = np.flatnonzero(np.diff(tags[j], prepend=0, append=0))
            line = np.append(tags[j], 0)
            spans[i] += [(int(line[a]), s + int(a), s + int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if line[a]]
    return [reconciled(s) for s in spans]


def added_spans(p: dict[str, np.ndarray], texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """What the network finds beside the patterns' spans."""
    out = []
    for text, known, found in zip(texts, base, read_texts(p, texts), strict=True):
        taken = sorted((s, e) for _, s, e in known)
        new = []
        for tag, start, end in found:
            start, end = snapped(text, start, end)
            kind = KINDS[tag - 1]
            if start < end and possible(kind, text[start:end]) and not any(s < end and start < e for s, e in taken):
                new.append((kind, start, end))
                taken.append((start, end))
        out.append(new)
    return out


# ------------------------------------------------------------------ labelled windows

TRAIN = 96


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _card_number(rng: random.Random) -> str:
    body = rng.choice("3456") + _digits(rng, rng.choice([14, 14, 14, 15]))
    return next(body + d for d in "0123456789" if luhn(body + d))


def _word(rng: random.Random, words: list[str]) -> str:
    return rng.choice(words) if rng.random() < 0.7 else "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))


def _written(rng: random.Random, kind: str, words: list[str]) -> str:
    """A made-up span in the patterns' spelling or, mostly, in another."""
    if kind == "email":
        at = rng.choice(["@", " at ", "(at)", "[at]", " (at) ", " [at] ", " @ ", " AT "])
        dot = "." if at in ("@", " @ ") or rng.random() < 0.3 else rng.choice([" dot ", "(dot)", "[dot]", " [dot] ", " DOT "])
        name = _word(rng, words) + (rng.choice("._-") + (_word(rng, words) if rng.random() < 0.5 else _digits(rng, 2)) if rng.random() < 0.6 else "")
        host = [_word(rng, words) + rng.choice(["", _digits(rng, 1)]) for _ in range(rng.randint(1, 2))]
        return name + at + dot.join([*host, rng.choice(["com", "org", "net", "de", "io", "fr", "es", "edu"])])
    if kind == "ip":
        return rng.choice([".", "[.]", "(.)", " . ", "[dot]", ", "]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        number, mark = _card_number(rng), rng.choice(["", " ", "-", ".", "/", "_", " - "])
        return mark.join(number[i : i + 4] for i in range(0, len(number), 4))
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+1 ({a}) {b}-{c}", f"001 {a} {b} {c}", f"{a}/{b}-{c}", f"+{_digits(rng, 2)} {a} {b}{c}", f"0{a} {b} {c}"])


def _decoy(rng: random.Random, words: list[str]) -> str:
    """Numbers and marks that are nobody's data."""
    w, d = _word(rng, words), lambda n: _digits(rng, n)
    return rng.choice([
        f"{d(4)}", f"{d(1)}.{d(1)}", f"v{d(1)}.{d(2)}.{d(1)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}/0{d(1)}/20{d(2)}", f"{d(2)}:{d(2)}:{d(2)}",
        "".join(rng.choices("0123456789abcdef", k=rng.choice([8, 32, 40]))), f"${d(3)},{d(3)}.{d(2)}", f"#{d(6)}", d(rng.randint(6, 12)), f"@{w}", f"{w} + {w}",
        f"http://{w}.com/{w}", f"{w}.{w}", f"({d(4)})", f"{w} at {w}.", f"{d(2)}%", f"{d(1)} - {d(2)}", f"{w}={d(5)}", f'"{d(3)}{w}{d(2)}"', f"{w} at the {w}",
    ])


def training_windows(lines: list[str], count: int = 3000, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags) of windows of TRAIN characters: lines as they are, and with spans and decoys written into them."""
    rng = random.Random(seed)
    words = [w for line in lines for w in re.findall(r"[A-Za-z]{2,12}", line)][:20_000] or ["the", "and", "on"]
    lines = lines or [""]
    x, tags = np.zeros((count, TRAIN), np.int64), np.zeros((count, TRAIN), np.int64)
    for i in range(count):
        text = rng.choice(lines)
        while len(text) < TRAIN:
            text += (" " if text else "") + _word(rng, words)
        own = [0] * len(text)
        for _ in range(rng.choice([0, 1, 1, 2]) if i % 5 else 0):
            kind = rng.choice([*KINDS, None, None])
            what = _decoy(rng, words) if kind is None else _written(rng, kind, words)
            free = [m.start() + 1 for m in re.finditer(" ", text[: TRAIN - 20]) if not own[m.start()]]
            at = rng.choice(free) if free else 0
            after = rng.choice([" ", " ", ". ", ", ", "\n"])
            text = text[:at] + what + after + text[at:]
            own[at:at] = [0 if kind is None else 1 + KINDS.index(kind)] * len(what) + [0] * len(after)
        tags[i] = own[:TRAIN]
        text = text[:TRAIN]
        for kind, a, b in base_spans(text):
            tags[i, a:b] = 1 + KINDS.index(kind)
        x[i] = classes(text)[:TRAIN]
    return x, tags


def _lines(per_text: int):
    """Texts of the sample -> a few stretches of each: around its patterns' spans, and at places given by the text's hash."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                rng = random.Random(hashlib.md5(text.encode()).hexdigest())
                near = [max(0, s - rng.randint(5, 60)) for _, s, _ in base_spans(text)]
                rng.shuffle(near)
                for at in [*near[:per_text], *(rng.randrange(max(1, len(text) - TRAIN)) for _ in range(per_text))]:
                    out.append(text[at : at + TRAIN])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["line"])

    return run


def train(docs: DataFrame, *, text_col: str = "text", sample: int = 3000, per_text: int = 2, hidden: int = 8, steps: int = 1000) -> dict[str, np.ndarray]:
    """Weights fitted on stretches of about ``sample`` texts, chosen by their hash (documented bound).

    Equal texts count once. Without texts, spans are written into made-up words alone.
    """
    texts = docs.where(F.length(text_col) > 0).select(F.col(text_col).alias("text"))
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    part = min(1.0, sample / max(1, docs.count()))
    chosen = texts.where(place < part * 1_000_000)
    lines = chosen.mapInArrow(_lines(per_text), "line string").distinct().toArrow()["line"].to_pylist()
    net = Tagger(hidden)
    net.fit(*training_windows(sorted(lines)), steps=steps)
    return net.weights()


# ------------------------------------------------------------------ on tables


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("base", BooleanType())]))


def _find(model):
    def run(batches):
        import pickle

        p = pickle.loads(model.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            spans = [
                [{"kind": k, "start": s, "end": e, "base": own} for own, some in ((True, known), (False, new)) for k, s, e in some]
                for known, new in zip(base, added_spans(p, texts, base), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["row", "spans"])

    return run


def find(docs: DataFrame, model: dict[str, np.ndarray], *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, spans): every row of ``docs`` (or its columns ``keep``) as a struct, and its text's spans
    (kind, start, end, base), in code points, end exclusive; base marks the patterns' spans, which the
    network's never overlap.

    A null text has no spans. Repeated rows get equal spans. A text is held whole by its task, with a byte
    a character; of windows 1024 are held at a time. No rows: no rows.
    """
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_find(shared(docs.sparkSession, model)), StructType([rows.schema["row"], StructField("spans", SPANS)]))


def _of(kind: str, base_only: bool) -> F.Column:
    return F.filter("spans", lambda s: (s["kind"] == kind) & (s["base"] if base_only else F.lit(True)))


def _listed(base_only: bool) -> F.Column:
    """Spans as kind:start:end, by kind, then start."""

    def of(kind: str) -> F.Column:
        places = F.array_sort(F.transform(_of(kind, base_only), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.transform(places, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(of, KINDS)), ",")


def digests(docs: DataFrame, model: dict[str, np.ndarray] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the patterns' spans, and all spans.

    One row for each row of ``docs``; other columns are not read. Without ``model`` one is trained on ``docs``.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find(own, model or train(own), keep=["doc_id"])
    counts = [F.size(_of(kind, True)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(_listed(True), 256).alias("base_sha256"), _listed(False).alias("spans"))


def _masked(text_col: str):
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("row").field(text_col).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                done, parts = 0, []
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= done:
                        parts += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
                    done = max(done, s["end"])
                out.append(None if text is None else "".join([*parts, text[done:]]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "masked"])

    return run


def masked(docs: DataFrame, model: dict[str, np.ndarray], *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; overlapping spans as one, named by the first."""
    found = find(docs, model, text_col=text_col)
    fresh = found.mapInArrow(_masked(text_col), StructType([found.schema["row"], StructField("masked", StringType())]))
    return fresh.select(*(F.col("masked").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
