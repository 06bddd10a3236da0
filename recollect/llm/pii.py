"""Personal data in texts: fixed patterns, and spans that a character-level tagger adds.

The tagger is a bidirectional LSTM with CRF transitions, trained here in numpy from labelled spans in generated
sentences, whose forms go beyond the patterns (bracketed or spaced numbers, obfuscated addresses, six groups of
colons). Windows that overlap are laid over the whole text, and every one is decoded by itself. Where a span runs into a
window's edge and no other window has it whole, a wider window is decoded, up to the whole text. The spans of all
windows and the patterns' spans are reconciled over the whole text; an exact check of its kind follows for each span.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from numpy.lib.introspect import opt_func_info
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import Span, best_set, in_order, joined, sha256
from .staging import ship, trimmed

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the contract.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans: leftmost, without overlaps within a kind; a match that fails its test is dropped."""
    out: list[Span] = []
    last = 0
    if "@" in text:
        for m in AT.finditer(text):
            a = m.start()
            while a > last and text[a - 1] in _LOCAL_CHARS:
                a -= 1
            if a < m.start():
                out.append(("email", a, m.end()))
                last = m.end()
    if _DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


# --- labelled sentences ---------------------------------------------------------------------------------------

SENTENCES, SEED = 8000, 20240502
#: Characters that the tagger tells apart; others are one of lower-case, upper-case or rest.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n.,;:!?@()[]{}<>+-_/\\'\"#$%&*=|~^`"
CODE = {c: i + 3 for i, c in enumerate(SYMBOLS)}
#: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Length of the labelled sentences; then of the windows over texts, and how far each begins behind the one before.
WINDOW = 96
SPAN_WINDOW, STRIDE = 448, 384


@lru_cache(maxsize=1)
def _code_table() -> np.ndarray:
    """The code of every character of the first plane; what lies beyond is rest."""
    return np.array([CODE.get(c, 0 if c.islower() else 1 if c.isupper() else 2) for c in map(chr, range(0x10000))] + [2], np.uint8)


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _code_table()[np.minimum(points, 0x10000)]


def labelled_sentences(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Texts of about a window, each with its labelled spans."""
    draw = random.Random(seed)
    syllables = "the and ing ion ent for ver con pro dis ment able ung keit lich ein aux eau que mente ado ar ie da to in er on wh st re é è ê ç ñ ü ö ä ß ción là été für über É Ü Ñ".split()
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 3)))
    d = lambda k: "".join(str(draw.randint(0, 9)) for _ in range(k))
    hexa = lambda k: "".join(draw.choice("0123456789abcdef") for _ in range(k))

    def card() -> str:
        body = draw.choice("3456") + d(draw.choice((14, 14, 14, 13)))
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        sep = draw.choice(("", "", " ", "-"))
        return sep.join(digits[k : k + 4] for k in range(0, len(digits), 4)) if draw.random() < 0.9 else "/".join(digits[k : k + 4] for k in range(0, len(digits), 4))

    def email() -> str:
        name = draw.choice((word(), word() + "." + word(), word() + d(2), word() + "." + d(2), word() + word() + "." + word()))
        host, top = draw.choice((word(), "mail" + d(1), word() + "." + word(), word() + word() + "-" + word() + word())), draw.choice(("com", "org", "net", "de", "fr", "es"))
        return draw.choice((f"{name}@{host}.{top}", f"{name}@{host}.example.{top}", f"{name} @ {host}.{top}", f"{name}@{host}(dot){top}", f"{name}[@]{host}.{top}", f"{name} (at) {host} (dot) {top}", f"{name}[at]{host}[dot]{top}"))

    def ip() -> str:
        o = lambda: str(draw.randint(0, 255))
        return draw.choice((".".join((o(), o(), o(), o())), ".".join((o(), o(), o(), o())), ":".join(hexa(4) for _ in range(8)), "2001:db8::" + hexa(4) + ":" + hexa(3)))

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return draw.choice((f"+1 ({a}) {b}-{c}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"001 {a} {b} {c}"))

    def other() -> str:
        k = draw.randrange(14)
        return (
            f"20{d(2)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}", f"{draw.randint(1, 28)}.{draw.randint(1, 12)}.20{d(2)}", f"${d(2)}.{d(2)}", f"{draw.randint(0, 23)}:{draw.randint(0, 59):02}:{draw.randint(0, 59):02}", d(draw.randint(1, 8)), f"v{draw.randint(0, 9)}.{draw.randint(0, 30)}.{draw.randint(0, 9)}",
            f"password={hexa(18)}", f'token = "{hexa(40)}"', "AKIA" + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"{d(1)},{d(3)},{d(3)}", f"@{word()}", f"{d(2)}% #{d(3)} {d(2)}-{d(2)}",
            draw.choice("-=_*#") * draw.randint(3, 30), draw.choice((f"“{word()}”", f"« {word()} »", f"– {word()}", f"漢字 {word()}", f"{d(2)} €")),
        )[k]

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out: list[tuple[str, list[Span]]] = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW - 10:
            x = draw.random()
            if x < 0.12:
                kind = draw.choice(KINDS)
                own = makers[kind]()
                spans.append((kind, len(text), len(text) + len(own)))
                text += own
            elif x < 0.22:
                text += other()
            else:
                own = word()
                text += own.capitalize() if draw.random() < 0.15 else own.upper() if draw.random() < 0.05 else own
            text += draw.choice((" ", " ", " ", " ", ", ", ". ", ".\n", "; ", ")"))
        shift = draw.randint(0, 20) if draw.random() < 0.5 else 0  # some windows begin within a word, none within a span
        if shift and not any(s[1] < shift for s in spans):
            text, spans = text[shift:], [(k, a - shift, b - shift) for k, a, b in spans]
        spans = [s for s in spans if s[2] <= WINDOW]
        # a text of more than a window ends where it cuts no label
        cut = min(WINDOW, max(max((x[2] for x in spans), default=0), text.rfind(" ", 0, WINDOW))) if len(text) > WINDOW else WINDOW
        out.append((text[:cut], [s for s in spans if s[2] <= cut]))
    return out


def tag_row(text: str, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        tags[a:b] = k + 1
        tags[a] = k
    return tags


# --- the tagger -----------------------------------------------------------------------------------------------

EMBED, HIDDEN = 12, 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@lru_cache(maxsize=1)
def wide_tanh() -> bool:
    """Whether numpy takes hyperbolic tangents in 512-bit vectors here; elsewhere they cost twice an exponential and more."""
    return any("AVX512" in own["current"] for found in opt_func_info("^tanh$", "float32").values() for own in found.values())


class Tagger:
    """Bidirectional LSTM over characters with a linear-chain CRF. Batches are (time, rows) with a mask."""

    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        g = lambda *s: (draw.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": g(len(SYMBOLS) + 3, EMBED) * 3, "O": g(2 * HIDDEN, TAGS), "o": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        for side in "fb":
            self.p |= {f"X{side}": g(EMBED, 4 * HIDDEN), f"H{side}": g(HIDDEN, 4 * HIDDEN), f"c{side}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1.0
        allowed = np.zeros((TAGS, TAGS), bool)
        for i in range(TAGS):
            for j in range(TAGS):  # an inside follows only its kind
                allowed[i, j] = j == 0 or j % 2 == 1 or i in (j, j - 1)
        self.barred = np.where(allowed, 0.0, -1e4).astype(np.float32)

    def _lstm(self, x: np.ndarray, mask: np.ndarray, side: str):
        p, n = self.p, x.shape[1]
        steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        inputs = x @ p[f"X{side}"] + p[f"c{side}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        hs = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        kept = []
        for t in steps:
            a = inputs[t] + h @ p[f"H{side}"]
            i, f, o, u = _sigmoid(a[:, :HIDDEN]), _sigmoid(a[:, HIDDEN : 2 * HIDDEN]), _sigmoid(a[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = (f * c + i * u) * m
            tc = np.tanh(new)
            kept.append((t, h, c, i, f, o, u, tc))
            h, c = o * tc * m, new
            hs[t] = h
        return hs, kept

    def emissions(self, x: np.ndarray, mask: np.ndarray):
        e = self.p["E"][x]
        (hf, kf), (hb, kb) = self._lstm(e, mask, "f"), self._lstm(e, mask, "b")
        both = np.concatenate((hf, hb), 2)
        return both @ self.p["O"] + self.p["o"], (e, both, kf, kb)

    def _back(self, side: str, dh_all: np.ndarray, e: np.ndarray, mask: np.ndarray, kept: list, grads: dict) -> np.ndarray:
        p = self.p
        n = e.shape[1]
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        da_all = np.zeros((*e.shape[:2], 4 * HIDDEN), np.float32)
        gh = np.zeros_like(p[f"H{side}"])
        for t, h, c, i, f, o, u, tc in reversed(kept):
            m = mask[t][:, None]
            dh = (dh + dh_all[t]) * m
            dnew = (dc + dh * o * (1 - tc * tc)) * m
            da = np.concatenate((dnew * u * i * (1 - i), dnew * c * f * (1 - f), dh * tc * o * (1 - o), dnew * i * (1 - u * u)), 1)
            da_all[t] = da
            gh += h.T @ da
            dh, dc = da @ p[f"H{side}"].T, dnew * f
        flat = da_all.reshape(-1, 4 * HIDDEN)
        grads[f"H{side}"], grads[f"c{side}"], grads[f"X{side}"] = gh, flat.sum(0), e.reshape(-1, EMBED).T @ flat
        return da_all @ p[f"X{side}"].T

    def gradients(self, x: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients, by forward and backward sums over the chain."""
        scores, (e, both, kf, kb) = self.emissions(x, mask)
        trans = self.p["T"] + self.barred
        steps, n = x.shape
        start = np.array([0.0 if j == 0 or j % 2 else -1e4 for j in range(TAGS)], np.float32)
        alpha = np.zeros((steps, n, TAGS), np.float64)
        beta = np.zeros((steps, n, TAGS), np.float64)
        alpha[0] = scores[0] + start
        for t in range(1, steps):
            new = scores[t] + _logsum(alpha[t - 1][:, :, None] + trans, 1)
            alpha[t] = np.where(mask[t][:, None] > 0, new, alpha[t - 1])
        total = _logsum(alpha[-1], 1)
        gt = np.zeros((TAGS, TAGS))
        for t in range(steps - 2, -1, -1):
            ahead = scores[t + 1] + beta[t + 1]
            live = mask[t + 1][:, None] > 0
            beta[t] = np.where(live, _logsum(trans[None] + ahead[:, None, :], 2), beta[t + 1])
            pair = np.exp(np.minimum(alpha[t][:, :, None] + trans + ahead[:, None, :] - total[:, None, None], 0))
            gt += (pair * live[:, :, None]).sum(0)
        d = np.exp(np.minimum(alpha + beta - total[None, :, None], 0)) * mask[:, :, None]
        rows = np.arange(n)
        gold = np.zeros(n)
        for t in range(steps):
            live = mask[t] > 0
            d[t, rows[live], tags[t][live]] -= 1
            gold += np.where(live, scores[t, rows, tags[t]], 0)
            if t:
                gold += np.where(live, trans[tags[t - 1], tags[t]], 0)
                np.add.at(gt, (tags[t - 1][live], tags[t][live]), -1)
        d = (d / n).astype(np.float32)
        grads: dict[str, np.ndarray] = {"T": (gt / n).astype(np.float32), "O": both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, TAGS), "o": d.sum((0, 1))}
        dboth = d @ self.p["O"].T
        de = self._back("f", dboth[:, :, :HIDDEN], e, mask, kf, grads) + self._back("b", dboth[:, :, HIDDEN:], e, mask, kb, grads)
        grads["E"] = np.zeros_like(self.p["E"])
        np.add.at(grads["E"], x.reshape(-1), de.reshape(-1, EMBED))
        return float((total - gold).mean()), grads

    def fit(self, samples: list[tuple[str, list[Span]]], epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Tagger:
        draw = np.random.default_rng(seed)
        x, mask = batch_of([codes(t) for t, _ in samples])
        tags, _ = batch_of([tag_row(t, s) for t, s in samples])
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps, step = epochs * (len(samples) // batch), 0
        for _ in range(epochs):
            order = draw.permutation(len(samples))
            for k in range(0, len(order) - batch + 1, batch):
                step += 1
                rows = order[k : k + batch]
                _, grads = self.gradients(x[:, rows], mask[:, rows], tags[:, rows])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                pace = rate * min(1.0, 1.5 * (1 - step / steps) + 0.03)
                for name, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-6))
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    self.p[name] = (self.p[name] - pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def _lean(self, wide: bool) -> dict[str, np.ndarray]:
        """Weights for decoding, where columns are windows and tags are scored against staying outside. Wide: sigmoids
        are halves of hyperbolic tangents, and states are twice as large, so that one array of gates needs one pass.
        Otherwise gates are scaled for one array of exponentials."""
        held = self.__dict__.setdefault("_held", {})
        if wide not in held:
            p, own = self.p, {"E": np.ascontiguousarray(self.p["E"].T)}
            scale = np.repeat(np.array([0.5, 0.5, 0.5, 1] if wide else [-1, -1, -1, -2], np.float32), HIDDEN)
            state = np.float32(0.5 if wide else 1)
            against, offset = p["O"][:, 1:] - p["O"][:, :1], p["o"][1:] - p["o"][0]
            for k, side in enumerate("fb"):
                w = np.concatenate((state * p[f"H{side}"], p[f"c{side}"][None], p[f"X{side}"])) * scale
                o = np.concatenate((state * against[k * HIDDEN : (k + 1) * HIDDEN], offset[None] * (side == "f")))
                own |= {f"W{side}": np.ascontiguousarray(w.T), f"O{side}": np.ascontiguousarray(o.T)}
            held[wide] = own
        return held[wide]

    def _pass(self, x: np.ndarray, live: list[int], side: str, out: np.ndarray, wide: bool) -> None:
        """Give or add what one direction gives for the tags to out (time, tag, window), over codes (time, window) of
        which the first so many of each time are there."""
        held, n = self._lean(wide), x.shape[1]
        w, table, o = held[f"W{side}"], held["E"], held[f"O{side}"]
        states = np.zeros((HIDDEN + 1 + EMBED, n), np.float32)
        states[HIDDEN] = 1
        gates, cells, others, scored = np.empty((4 * HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32), np.empty((HIDDEN, n), np.float32), np.empty((TAGS - 1, n), np.float32)
        m = -1
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            if live[t] != m:
                m = live[t]
                state, a, c, v, s = states[:, :m], gates[:, :m], cells[:, :m], others[:, :m], scored[:, :m]
                h, seen, e = state[:HIDDEN], state[: HIDDEN + 1], state[HIDDEN + 1 :]
                inside, forget, output, fresh = (a[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
                sigmoids = a[: 3 * HIDDEN]
            np.take(table, x[t, :m], axis=1, out=e, mode="clip")
            np.matmul(w, state, out=a)
            if wide:
                np.tanh(a, out=a)
                sigmoids += 1
                c *= forget
                inside *= fresh
                c += inside
                c *= 0.5
                np.tanh(c, out=v)
                np.multiply(output, v, out=h)
            else:  # c is -2 times the cell; an exponential that overflows ends in the right limit
                np.exp(a, out=a)
                a += 1
                np.divide(4, fresh, out=v)
                np.subtract(2, v, out=v)
                v /= inside
                c /= forget
                c += v
                np.exp(c, out=v)
                v += 1
                np.divide(2, v, out=v)
                v -= 1
                np.divide(v, output, out=h)
            if side == "f":
                np.matmul(o, seen, out=out[t, :, :m])
            else:
                np.matmul(o, seen, out=s)
                out[t, :, :m] += s

    def scores(self, rows: list[np.ndarray], wide: bool | None = None) -> np.ndarray:
        """(time, tag, window): scores of the tags but the first against it, for windows of codes, longest first, in one
        batch. Each direction steps only through what a window has; behind its end all tags are out of reach."""
        sizes = np.array([len(r) for r in rows], np.int64)
        steps = int(sizes.max(initial=0))
        x = np.zeros((len(rows), steps), np.intp)
        for r, own in enumerate(rows):
            x[r, : len(own)] = own
        x = np.ascontiguousarray(x.T)
        live = np.searchsorted(-sizes, -np.arange(steps), "left").tolist()
        out = np.empty((steps, TAGS - 1, len(rows)), np.float32)
        for t in range(int(sizes.min(initial=steps)), steps):
            out[t, :, live[t] :] = -1e4
        wide = wide_tanh() if wide is None else wide
        with np.errstate(over="ignore"):
            for side in "fb":
                self._pass(x, live, side, out, wide)
        return out

    def decode(self, rows: list[np.ndarray]) -> list[list[tuple[int, int, float, str]]]:
        """Best tag sequence of each window, as spans (start, end, margin over staying outside, kind)."""
        order = sorted(range(len(rows)), key=lambda r: -len(rows[r]))
        scores = self.scores([rows[r] for r in order])
        trans = self.p["T"] + self.barred
        out: list[list[tuple[int, int, float, str]]] = [[] for _ in rows]
        open_ = np.flatnonzero(self._can_gain(scores, trans)) if len(scores) else np.empty(0, int)
        for k in range(0, len(open_), 256):
            some = open_[k : k + 256]
            own = [order[r] for r in some.tolist()]
            for r, spans in zip(own, self._search(scores[:, :, some], [len(rows[r]) for r in own], trans), strict=True):
                out[r] = spans
        return out

    def _can_gain(self, against: np.ndarray, trans: np.ndarray) -> np.ndarray:
        """Whether a window may hold any span: the most that a span of each kind can gain over staying outside.

        A span pays its entry from outside and its exit; an exit into another span counts with what exceeds that one's
        entry from outside, so a sequence gains no more than its spans by themselves. Where none can gain, the best
        sequence is all outside, and the chain need not be searched.
        """
        own = trans - trans[0, 0]
        begin, inside = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        enter = own[0, begin]
        leave = [np.maximum(own[at, 0], (own[at][:, begin] - enter).max(1))[:, None] for at in (begin, inside)]
        further, again = own[begin, inside][:, None], own[inside, inside][:, None]
        first = against[:, 0::2] + enter[:, None]
        first[0] = against[0, 0::2]  # a sequence may begin within a span, and end so
        run = np.full(first.shape[1:], -1e4, np.float32)
        most, met = run.copy(), np.empty_like(run)
        for t in range(1, len(first)):
            np.add(first[t - 1], further, out=met)
            run += again
            np.maximum(run, met, out=run)
            run += against[t, 1::2]
            np.maximum(most, run, out=most)
        return ((first.max(0) + leave[0] > 0) | (most + leave[1] > 0) | (first[-1] > 0) | (run > 0)).any(0)

    def _search(self, against: np.ndarray, sizes: list[int], trans: np.ndarray) -> list[list[tuple[int, int, float, str]]]:
        steps, _, n = against.shape
        scores = np.concatenate((np.zeros((steps, 1, n), np.float32), against), 1)
        start = np.array([0.0 if j == 0 or j % 2 else -1e4 for j in range(TAGS)], np.float32)
        best = np.empty((steps, TAGS, n), np.float32)
        best[0] = scores[0] + start[:, None]
        options, across = np.empty((TAGS, TAGS, n), np.float32), np.ascontiguousarray(trans)[:, :, None]
        for t in range(1, steps):
            np.add(best[t - 1][:, None], across, out=options)
            np.maximum.reduce(options, 0, out=best[t])
            best[t] += scores[t]  # behind a window's end all but the first tag are out of reach
        tag = best[-1].argmax(0)
        path = np.empty((steps, n), np.int64)
        path[-1] = tag
        for t in range(steps - 1, 0, -1):  # where a tag came from is found again, for those on the path only
            tag = (best[t - 1] + trans[:, tag]).argmax(0)
            path[t - 1] = tag
        out: list[list[tuple[int, int, float, str]]] = []
        for r, size in enumerate(sizes):
            tags, spans, k = path[:size, r], [], 0
            for k in np.flatnonzero(tags % 2).tolist():
                end = k + 1
                while end < size and tags[end] == tags[k] + 1:
                    end += 1
                spans.append((k, end, float(scores[range(k, end), tags[k:end], r].mean()), KINDS[tags[k] // 2]))
            out.append(spans)
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def batch_of(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, rows) of codes, and the mask of those that are there."""
    steps = max(map(len, rows), default=0)
    x, mask = np.zeros((steps, len(rows)), np.int64), np.zeros((steps, len(rows)), np.float32)
    for r, own in enumerate(rows):
        x[: len(own), r] = own
        mask[: len(own), r] = 1
    return x, mask


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """Fitted once per process from the same sentences."""
    return Tagger().fit(labelled_sentences(), epochs=8, rate=0.02)


# --- whole texts ----------------------------------------------------------------------------------------------

_SPELLED_AT = re.compile(r"\s*[(\[{<]\s*at\s*[)\]}>]\s*", re.IGNORECASE)
_SPELLED_DOT = re.compile(r"\s*[(\[{<]\s*dot\s*[)\]}>]\s*", re.IGNORECASE)
_HOST_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-")


def windows(length: int) -> list[tuple[int, int]]:
    """(start, end) of the windows over a text of so many characters; they cover it and overlap."""
    last = max(0, -(-(length - SPAN_WINDOW) // STRIDE))
    return [(k * STRIDE, min(length, k * STRIDE + SPAN_WINDOW)) for k in range(last + 1)] if length else []


def whole_address(text: str, a: int, b: int) -> tuple[int, int]:
    """The span of an address, grown to the ends of its first and last name, and over an at sign at its end."""
    while a > 0 and text[a] in _LOCAL_CHARS and text[a - 1] in _LOCAL_CHARS:
        a -= 1
    if text[b - 1] == "@" and text[b : b + 1] == " " and text[b + 1 : b + 2] in _HOST_CHARS:
        b += 2
    while b < len(text) and text[b - 1] in _HOST_CHARS and text[b] in _HOST_CHARS:
        b += 1
    return a, b


def plausible(kind: str, own: str) -> bool:
    """Whether a tagged span can be of its kind at all."""
    digits = sum(map(str.isdigit, own))
    if kind == "email":
        own = _SPELLED_DOT.sub(".", _SPELLED_AT.sub("@", own))
        return "@" in own and any(c.isalpha() for c in own.partition("@")[0]) and any(c.isalpha() for c in own.partition("@")[2]) and ("." in own.partition("@")[2] or "dot" in own)
    if kind == "ip":
        groups = own.split(".")
        return (len(groups) == 4 and all(g.isascii() and g.isdigit() and len(g) <= 3 and int(g) <= 255 for g in groups)) or (own.count(":") >= 3 and re.fullmatch(r"[0-9a-fA-F:]+", own) is not None)
    if kind == "card":
        plain = "".join(c for c in own if c.isascii() and c.isdigit())
        return 12 <= len(plain) <= 19 and luhn(plain)
    return 9 <= digits <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().-]+[0-9]", own) is not None and re.search(r"[ ().-]", own) is not None


def _portions(laid: list[tuple[int, int, int]], rows: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows, shortest first, in batches of at most so many rows, fewer where they are long."""
    k = 0
    while k < len(laid):
        n = rows
        while n > 1 and n * (laid[min(k + n, len(laid)) - 1][2] - laid[min(k + n, len(laid)) - 1][1]) > rows * SPAN_WINDOW:
            n //= 2
        yield laid[k : k + n]
        k += n


def _wider(cut: list[tuple[int, int, int, int]], whole: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Windows of three times the length for spans that an edge cuts, unless a whole span holds what is seen of them;
    those that meet become one."""
    whole = sorted(whole)
    starts, reach = [a for a, _ in whole], list(accumulate((b for _, b in whole), max))
    out: list[list[int]] = []
    for a, b in sorted({(max(0, a - (b - a)), min(length, b + b - a)) for s, e, a, b in cut if not ((k := bisect_right(starts, s)) and reach[k - 1] >= e)}):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_personal(texts: list[str], tagger: Tagger, rows_at_once: int = 512) -> list[tuple[list[Span], list[Span]]]:
    """The base spans and all spans of each text."""
    bases = [in_order(base_spans(t), KINDS) for t in texts]
    coded = [codes(t) for t in texts]
    laid = [(i, *w) for i, t in enumerate(texts) for w in windows(len(t))]
    found: dict[int, list[tuple[int, int, float, str]]] = {}
    while laid:
        cut: dict[int, list[tuple[int, int, int, int]]] = {}
        laid.sort(key=lambda w: w[2] - w[1])
        for part in _portions(laid, rows_at_once):
            for (i, a, b), spans in zip(part, tagger.decode([coded[i][a:b] for i, a, b in part]), strict=True):
                for s, e, margin, kind in spans:
                    if (s or not a) and (e < b - a or b == len(texts[i])):
                        found.setdefault(i, []).append((a + s, a + e, margin, kind))
                    else:
                        cut.setdefault(i, []).append((a + s, a + e, a, b))
        laid = [(i, *w) for i, own in cut.items() for w in _wider(own, [f[:2] for f in found.get(i, ())], len(texts[i]))]
    out = []
    for i, t in enumerate(texts):
        base, more = bases[i], []
        if i in found:
            starts, reach = [x[1] for x in base], list(accumulate((x[2] for x in base), max))
            votes: dict[tuple[int, int, str], float] = {}
            for a, b, margin, kind in found[i]:
                if kind == "email":
                    a, b = whole_address(t, a, b)
                a, b = a + len(t[a:b]) - len(t[a:b].lstrip(" \n,;")), b - len(t[a:b]) + len(t[a:b].rstrip(" \n,;."))
                if margin > 0 and a < b and plausible(kind, t[a:b]) and not ((k := bisect_left(starts, b)) and reach[k - 1] > a):
                    votes[a, b, kind] = votes.get((a, b, kind), 0.0) + margin
            more = [(kind, a, b) for a, b, _, kind in best_set([(a, b, v, kind) for (a, b, kind), v in votes.items()])]
        out.append((base, in_order(base + more, KINDS) if more else base))
    return out


def _portions_of(batch: pa.RecordBatch, rows: int = 1024, chars: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, so many of both at once; a longer text comes alone."""
    ids, texts, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = text.as_py() or ""
        if texts and (len(texts) == rows or size + len(text) > chars):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(doc)
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans, n_added.

    Positions are code points, ends exclusive; spans go by start, then kind. Null texts count as empty and have no
    spans. Rows are independent: repeated rows repeat their result, null ids stay, an empty table gives an empty one, and
    other columns are not read, whatever their names. The tagger is trained on the driver and its weights, of a fixed size, are broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for ids, texts in _portions_of(batch):
                for doc, (base, every) in zip(ids, find_personal(texts, held.value), strict=True):
                    rows.append((doc, *(sum(s[0] == kind for s in base) for kind in KINDS), sha256(joined(base)), joined(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, c in zip(_COLUMNS, columns, strict=True)], names=_COLUMNS)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(trimmed(run), ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in _COLUMNS))


_COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
