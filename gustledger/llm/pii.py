"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns' spans always stay. The network is trained in numpy on labelled spans: what the
patterns find in a bounded sample of documents, and generated spans in looser spellings set into
lines of the sample. It then adds spans that the patterns miss. Its gates are piecewise linear (hard
sigmoids) and its cells are squashed by x / (1 + |x|), which cost a fraction of exponentials.

Whole texts are tagged. They are cut into overlapping windows; each window is tagged on its own, the
windows' tag probabilities are averaged with the most weight on a window's middle, and a Viterbi pass
over the text decides, in stretches between runs of characters that are outside for certain.
Texts and spans may be of any length. Decimal digits of other scripts count as digits.

Null and empty texts have no spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = ("email", "ip", "card", "phone")
#: Documents with a digit or an @ that the network is trained on, those with the smallest hash of their id.
SAMPLE = 2_000
#: Few windows are gone through more often.
LEAST_UPDATES = 400
#: Characters of a training window.
WINDOW = 96
#: Characters of a window that is tagged, and how many of them the next window has too.
SPAN, OVERLAP = 768, 64
#: Windows tagged at once, and characters whose probabilities are held at once (a longer text is held alone).
BATCH, HELD = 512, 1 << 21
#: Steps of a batch whose scores are worked on at once, so that they stay in a processor's cache.
STEPS = 16
#: Characters are sure to be outside in the middle of a run of 2 * CALM whose best other tag is less probable by exp(-LOSS) each:
#: leaving such a run outside in one half costs CALM * LOSS, more than any one tag can (log of 1e-12).
CALM, LOSS = 6, 6.0
#: Mean tag probability from which a span is added.
SURE = 0.8

# Starts are tied to the first digit of a run, where a leftmost match must start, so that no run is scanned twice.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of what the patterns find, in order."""
    out = []
    done = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, 0, m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
_ALLOWED = np.zeros((TAGS + 1, TAGS), bool)  # the last row is the start
_ALLOWED[:, 0] = True
for _k in range(len(KINDS)):
    _ALLOWED[:, 1 + 2 * _k] = True
    _ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True
_INSIDE = np.arange(2, TAGS, 2)
_FORBIDDEN = -1e4
_LETTERS = 100


_ZEROS = np.array([c for c in range(128, 0x20000) if unicodedata.decimal(chr(c), None) == 0])


def _letters(points: np.ndarray) -> np.ndarray:
    out = np.full(len(points), 97, np.uint8)
    plain = (points >= 32) & (points < 127)
    out[plain] = points[plain] - 32 + 1
    out[(points >= 9) & (points <= 13)] = 96
    out[points >= 0x2000] = 98
    other = np.flatnonzero(points >= 128)
    digit = points[other].astype(np.int64) - _ZEROS[np.maximum(np.searchsorted(_ZEROS, points[other], "right") - 1, 0)]
    is_digit = (digit >= 0) & (digit < 10)
    out[other[is_digit]] = digit[is_digit] + 48 - 32 + 1
    return out


_LETTER = _letters(np.arange(0x110000))


def letters(points: np.ndarray) -> np.ndarray:
    """Code points as the network's letters: ASCII itself (upper case apart), digits of other scripts as ASCII digits, others by kind."""
    return _LETTER[points]


@dataclass
class Tagger:
    """Weights of both directions, the output layer and the transitions (last row: from the start)."""

    p: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Tag scores of windows ``x`` (time, batch); letter 0 is padding at the end."""
        hs, caches = [], []
        for d in "fb":
            seq = x if d == "f" else x[::-1]
            h, cache = _lstm(self.p["e" + d], self.p["u" + d], seq)
            hs.append(h if d == "f" else h[::-1])
            caches.append(cache)
        both = np.concatenate(hs, 2)
        return both @ self.p["o"] + self.p["ob"], (both, caches)

    def transitions(self) -> np.ndarray:
        return np.where(_ALLOWED, self.p["t"], self.p["t"].dtype.type(_FORBIDDEN))


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.2 * x + 0.5, 0, 1)


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _lstm(table: np.ndarray, u: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
    n = u.shape[0]
    h = c = np.zeros((x.shape[1], n), u.dtype)
    out, cache = np.empty((*x.shape, n), u.dtype), []
    for t in range(len(x)):
        z = table[x[t]] + h @ u
        gates, g = _gate(z[:, : 3 * n]), _squash(z[:, 3 * n :])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        alive = (x[t] > 0)[:, None]
        c_new = (f * c + i * g) * alive
        tc = _squash(c_new)
        h_new = o * tc
        cache.append((h, c, gates, g, tc, alive))
        h, c = h_new, c_new
        out[t] = h
    return out, cache


def _lstm_back(table: np.ndarray, u: np.ndarray, x: np.ndarray, cache: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dtable, du = np.zeros_like(table), np.zeros_like(u)
    n = u.shape[0]
    dh = dc = np.zeros_like(dout[0])
    codes = np.arange(len(table))[:, None]
    for t in range(len(x) - 1, -1, -1):
        h, c, gates, g, tc, alive = cache[t]
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        dh = (dout[t] + dh) * alive
        # The slope of x / (1 + |x|) is (1 - |value|) squared.
        dc = dc * alive + dh * o * (1 - np.abs(tc)) ** 2
        dgates = np.concatenate([dc * g, dc * c, dh * tc], 1) * ((gates > 0) & (gates < 1)) * u.dtype.type(0.2)
        dz = np.concatenate([dgates, dc * i * (1 - np.abs(g)) ** 2], 1)
        dtable += (x[t][None, :] == codes).astype(u.dtype) @ dz
        du += h.T @ dz
        dh, dc = dz @ u.T, dc * f
    return dtable, du


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def _forward_backward(e: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward scores of a batch (time, batch, tag) and its log partition."""
    steps, batch, _ = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = trans[-1] + e[0]
    for t in range(1, steps):
        new = _logsumexp(a[t - 1][:, :, None] + trans[None, :-1], 1) + e[t]
        a[t] = np.where(mask[t][:, None], new, a[t - 1])
    for t in range(steps - 2, -1, -1):
        new = _logsumexp(trans[None, :-1] + (e[t + 1] + b[t + 1])[:, None, :], 2)
        b[t] = np.where(mask[t + 1][:, None], new, 0.0)
    return a, b, _logsumexp(a[-1], 1)


def marginals(tagger: Tagger, x: np.ndarray) -> np.ndarray:
    """Tag probabilities of windows (time, batch)."""
    e, _ = tagger.emissions(x)
    a, b, z = _forward_backward(e, x > 0, tagger.transitions())
    return np.exp(np.minimum(a + b - z[None, :, None], 0))


def _add_scores(p: dict[str, np.ndarray], x: np.ndarray, e: np.ndarray) -> None:
    """Adds both directions' tag scores to ``e`` (time, tag, batch); those of padding mean nothing. Padding follows or precedes all letters."""
    n = len(p["uf"])
    scale = np.repeat(np.float32([0.2, 1]), [3 * n, n])
    # Gates lie apart and directions go together, so that every step works on whole blocks.
    tables, parts = np.empty((4, 2, _LETTERS, n), np.float32), np.empty((4, 2, n, n), np.float32)
    for k, d in enumerate("fb"):
        table = p["e" + d] * scale
        table[:, : 3 * n] += np.float32(0.5)
        table[0] = 0  # all gates shut: the state stays zero until letters come
        tables[:, k] = table.reshape(-1, 4, n).transpose(1, 0, 2)
        parts[:, k] = (p["u" + d] * scale).reshape(n, 4, n).transpose(1, 0, 2)
    tables = tables.reshape(4, 2 * _LETTERS, n)
    o = np.ascontiguousarray(p["o"].reshape(2, n, TAGS).transpose(0, 2, 1))
    steps, batch = x.shape
    both = np.stack([x, x[::-1] + _LETTERS], 1).astype(np.intp, copy=False)
    # numpy takes the larger or smaller of two arrays several times as fast as of an array and a number.
    shut, open_ = np.zeros((2, batch, n), np.float32), np.ones((2, batch, n), np.float32)
    h, c, size = np.zeros((3, 2, batch, n), np.float32)
    z, more = np.empty((2, 4, 2, batch, n), np.float32)
    (i, f, out, g), gates, score = z, z[:3], np.empty((2, TAGS, batch), np.float32)
    across = h.transpose(0, 2, 1)
    for t in range(steps):
        for q in range(4):
            tables[q].take(both[t], 0, z[q], "clip")
        np.matmul(h, parts, out=more)
        z += more
        np.maximum(gates, shut, out=gates)
        np.minimum(gates, open_, out=gates)
        np.abs(g, out=size)
        size += 1
        g /= size
        g *= i
        c *= f
        c += g
        np.abs(c, out=size)
        size += 1
        np.divide(c, size, out=h)
        h *= out
        np.matmul(o, across, out=score)
        e[t] += score[0]
        e[steps - 1 - t] += score[1]


def probabilities(tagger: Tagger, x: np.ndarray) -> np.ndarray:
    """marginals() in single precision, as sums of products that are scaled at each step."""
    p = {k: w.astype(np.float32) for k, w in tagger.p.items()}
    # Tags stand before windows, so that each step works on few long rows.
    e = np.empty((len(x), TAGS, x.shape[1]), np.float32)
    e[:] = p["ob"][:, None]
    _add_scores(p, x, e)
    step = np.exp(tagger.transitions()).astype(np.float32)
    forth, back = np.ascontiguousarray(step[:-1].T), np.ascontiguousarray(step[:-1])
    mask = x > 0
    whole = mask.all(1)
    # Scores stay within e**-80, as the sums must not vanish.
    least, one = np.full(e.shape[1:], -80, np.float32), np.ones(TAGS, np.float32)
    parts = [slice(low, low + STEPS) for low in range(0, len(x), STEPS)]
    for part in parts:
        own = e[part]
        own -= own.max(1, keepdims=True)
        np.maximum(own, least, out=own)
        np.exp(own, out=own)
    a = np.empty_like(e)
    for t in range(len(x)):
        if t:
            np.matmul(forth, a[t - 1], out=a[t])
            a[t] *= e[t]
        else:
            np.multiply(step[-1][:, None], e[0], out=a[0])
        a[t] /= one @ a[t]
    b = np.ones(e.shape[1:], np.float32)
    for t in range(len(x) - 2, -1, -1):
        e[t + 1] *= b
        np.matmul(back, e[t + 1], out=b)
        b /= one @ b
        if not whole[t + 1]:
            b[:, ~mask[t + 1]] = 1
        a[t] *= b
    for part in parts:
        a[part] /= a[part].sum(1, keepdims=True)
    return a.transpose(0, 2, 1)


def fit(windows: np.ndarray, tags: np.ndarray, rounds: int = 6, batch: int = 64, hidden: int = 16, seed: int = 11) -> Tagger:
    """Maximum likelihood by back-propagation through whole windows, with Adam. Windows: (count, time)."""
    rng = np.random.default_rng(seed)
    p = {"o": rng.normal(0, 0.1, (2 * hidden, TAGS)), "ob": np.zeros(TAGS), "t": np.zeros((TAGS + 1, TAGS))}
    for d in "fb":
        p["e" + d] = rng.normal(0, 0.3, (_LETTERS, 4 * hidden))
        p["e" + d][:, hidden : 2 * hidden] += 1.0
        p["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
    p = {k: w.astype(np.float32) for k, w in p.items()}
    tagger = Tagger(p)
    m = {k: np.zeros_like(w) for k, w in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    per_round = -(-len(windows) // batch)
    rounds = max(rounds, -(-LEAST_UPDATES // per_round))
    step, total = 0, rounds * per_round
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, y = windows[pick].T, tags[pick].T
            steps, size = x.shape
            mask = x > 0
            trans = tagger.transitions()
            e, (both, caches) = tagger.emissions(x)
            a, b, z = _forward_backward(e, mask, trans)
            grad_e = np.where(mask[:, :, None], np.exp(np.minimum(a + b - z[None, :, None], 0)), 0.0)
            tt, bb = np.nonzero(mask)
            np.add.at(grad_e, (tt, bb, y[tt, bb]), -1.0)
            grad_t = np.zeros_like(trans)
            grad_t[-1] = grad_e[0].sum(0)
            for t in range(1, steps):
                on = mask[t]
                if on.any():
                    pair = np.exp(np.minimum(a[t - 1][on][:, :, None] + trans[None, :-1] + (e[t] + b[t])[on][:, None, :] - z[on][:, None, None], 0))
                    grad_t[:-1] += pair.sum(0)
                    np.add.at(grad_t, (y[t - 1][on], y[t][on]), -1.0)
            g = {"o": both.reshape(-1, 2 * hidden).T @ grad_e.reshape(-1, TAGS), "ob": grad_e.sum((0, 1)), "t": grad_t * _ALLOWED}
            dboth = grad_e @ p["o"].T
            for k, d in enumerate("fb"):
                part = dboth[:, :, k * hidden : (k + 1) * hidden]
                seq, part = (x, part) if d == "f" else (x[::-1], part[::-1])
                g["e" + d], g["u" + d] = _lstm_back(p["e" + d], p["u" + d], seq, caches[k], part)
            step += 1
            rate = 0.03 * (1 - 0.9 * step / total)
            for k in p:
                gk = np.clip(g[k] / size, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk**2
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return tagger


def generated(rng: np.random.Generator, kind: int) -> str:
    """A made-up span of a kind, also in spellings that the patterns miss."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    name = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))
    if kind == 0:
        at = rng.choice(["@", "@", " @ ", "(@)", "[@]", " (at) ", " [at] "])
        dot = rng.choice([".", ".", " . "]) if at != "@" else "."
        if "at" in at:
            dot = rng.choice([" (dot) ", " [dot] ", "."])
        local = name() + rng.choice(["", "." + name(), "." + n(2), "_" + n(3), "+" + name()])
        return f"{local}{at}{name()}{rng.choice(['', n(1)])}{dot}{rng.choice(['com', 'org', 'example.com', 'co.uk', 'de', 'example.org'])}"
    if kind == 1:
        sep = rng.choice([".", ".", ".", "[.]", " . "])
        return sep.join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        body = rng.choice(["4", "51", "37", "6011"])
        body += n(15 - len(body))
        digits = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        sep = rng.choice(["", " ", "-", ".", "  ", "/"])
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))
    a, b, c = n(3), n(3), n(4)
    return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+1 {a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+49 {a} {b}{c}", f"001 {a} {b} {c}", f"+{n(2)} {a}/{b}{c}", f"1-{a}-{b}-{c}"])


def decoy(rng: np.random.Generator) -> str:
    """Text with digits that is no personal data."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    h = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))
    return str(rng.choice([n(1), n(2), n(4), f"{n(1)}.{n(1)}", f"{n(1)}.{n(1)}.{n(1)}", f"v{n(1)}.{n(2)}", f"20{n(2)}-0{n(1)}-1{n(1)}", f"{n(2)}:{n(2)}", f"{n(2)},{n(3)}", f"${n(3)}.{n(2)}", n(7), n(25), f"token = \"{h(40)}\"", f"password={h(18)}", h(32), f"@{h(4)}", f"{n(2)}%", f"AKIA{h(16).upper()}", f"{n(3)} {n(2)}", f"#{n(4)}", f"{n(1)}/{n(1)}", f"{n(4)}-{n(4)}"]))


def labelled(text: str, spans: list[tuple[int, int, int]], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros(WINDOW, np.int64)
    y = np.zeros(WINDOW, np.int64)
    part = text[low:high]
    x[: len(part)] = letters(np.frombuffer(part.encode("utf-32-le"), "<u4"))
    taken = low
    for start, kind, end in spans:
        if start >= taken and start < high and end > low:
            y[max(start, low) - low : min(end, high) - low] = 2 + 2 * kind
            y[start - low] = 1 + 2 * kind
            taken = end
    return x, y


def examples(texts: list[str], seed: int = 5, made: int = 6_000, most: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
    """Training windows: at most ``most`` anywhere in the texts and ``most`` around their digits and @, and ``made`` with generated spans."""
    rng = np.random.default_rng(seed)
    rows, lines, plain = [], [], 0
    for text in texts:
        spans = pattern_spans(text)
        low = int(rng.integers(max(1, len(text) - WINDOW)))
        if plain < most and text and not any(s < low < e or s < low + WINDOW < e for s, _, e in spans):
            rows.append(labelled(text, spans, low, low + WINDOW))
            plain += 1
        last = -1
        for m in _TRIGGER.finditer(text):
            if m.start() > last and len(rows) - plain < most:
                low = max(0, m.start() - int(rng.integers(8, 56)))
                if not any(s < low < e or s < low + WINDOW < e for s, _, e in spans):
                    rows.append(labelled(text, spans, low, low + WINDOW))
                last = low + WINDOW
        lines += [line for line in text.split("\n") if len(line) > 20 and not _TRIGGER.search(line)][:3]
    lines = lines or ["The quick brown fox jumps over the lazy dog and runs away."]
    for _ in range(made):
        text, spans = "", []
        while len(text) < WINDOW:
            line = lines[rng.integers(len(lines))]
            at = int(rng.integers(len(line)))
            text += line[at : at + int(rng.integers(6, 40))].strip() + str(rng.choice([" ", " ", " ", ": ", ", ", "\n", " ("]))
            pick = int(rng.integers(7))
            if pick < len(KINDS):
                item = generated(rng, pick)
                spans.append((len(text), pick, len(text) + len(item)))
            else:
                item = decoy(rng)
            text += item + str(rng.choice([" ", " ", ". ", ", ", ") ", "\n"]))
        low = int(rng.integers(0, 12))
        spans = [s for s in spans if s[0] >= low and s[2] <= low + WINDOW]
        end = min([low + WINDOW] + [s[0] for s in spans if s[2] > low + WINDOW])
        rows.append(labelled(text, spans, low, end))
    return np.stack([x for x, _ in rows]), np.stack([y for _, y in rows])


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Train on at most ``sample`` documents that hold a digit or an @."""
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").rlike("[0-9@]")).orderBy(F.xxhash64("_id"), "_id", "_text").limit(sample)
    return fit(*examples([r["_text"] for r in some.select("_text").toLocalIterator()]))


def _stretches(tagger: Tagger, texts: list[str]) -> list[tuple[int, int, np.ndarray]]:
    """Text, start and tag probabilities of the stretches that need a Viterbi pass; the best path is outside everywhere else.

    Probabilities are averaged over the windows that hold a character: that of being outside
    everywhere, those of the other tags where it is not all but certain.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.append(letters(points), 0).astype(np.int64)
    # Windows in order of their texts; those of about one length share a batch.
    step = SPAN - OVERLAP
    count = np.where(sizes > 0, np.maximum(1, -(-(sizes - OVERLAP) // step)), 0)
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(texts)), count)
    begin = (np.arange(len(text)) - first[text]) * step
    length, begin = np.minimum(SPAN, sizes[text] - begin), base[text] + begin
    order = np.argsort(length, kind="stable")
    batch_of, column = np.empty((2, len(order)), np.int64)
    kept = []
    outside, weights = np.zeros((2, base[-1]), np.float32)
    ramp = np.minimum(1.0 + np.arange(SPAN), OVERLAP).astype(np.float32)
    for low in range(0, len(order), BATCH):
        some = order[low : low + BATCH]
        batch_of[some], column[some] = len(kept), np.arange(len(some))
        at = np.arange(length[some[-1]])[:, None]
        p = probabilities(tagger, np.where(at < length[some], codes[np.minimum(begin[some] + at, base[-1])], 0))
        kept.append(p)
        for own, n, at in zip(np.ascontiguousarray(p[:, :, 0].T), length[some].tolist(), begin[some].tolist(), strict=True):
            weight = np.minimum(ramp[:n], ramp[:n][::-1])
            outside[at : at + n] += own[:n] * weight
            weights[at : at + n] += weight
    weights = np.maximum(weights, 1)
    outside /= weights

    def averaged(places: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Probabilities of all tags at places of the texts ``of``."""
        sums = np.zeros((len(places), TAGS), np.float32)
        last = (places - base[of]) // step
        for number in (last - 1, last):  # no more than two windows hold a character
            there = np.flatnonzero((number >= 0) & (number < count[of]))
            window = first[of[there]] + number[there]
            at = places[there] - begin[window]
            there, window, at = (part[at < length[window]] for part in (there, window, at))
            weight = np.minimum(np.minimum(1 + at, length[window] - at), OVERLAP).astype(np.float32)[:, None]
            for k in np.unique(batch_of[window]):
                mine = np.flatnonzero(batch_of[window] == k)
                sums[there[mine]] += kept[k][at[mine], column[window[mine]]] * weight[mine]
        return sums / weights[places, None]

    hot = np.flatnonzero(outside < 1 / (1 + np.exp(-LOSS)))  # all others are calm, as probabilities add up to one
    of = np.searchsorted(base, hot, "right") - 1
    p = averaged(hot, of)
    sure = np.log(p[:, 0] + 1e-12) - np.log(p[:, 1:].max(1) + 1e-12) < LOSS
    hot, of = hot[sure], of[sure]
    if not len(hot):
        return []
    cuts = np.flatnonzero((np.diff(hot) > 2 * CALM) | (np.diff(of) > 0)) + 1
    of = of[np.append(0, cuts)]
    low = np.maximum(base[of], hot[np.append(0, cuts)] - CALM)
    high = np.minimum(base[of + 1], hot[np.append(cuts, len(hot)) - 1] + CALM + 1)
    ends = np.cumsum(high - low)
    p = averaged(np.arange(ends[-1]) + np.repeat(high - ends, high - low), np.repeat(of, high - low))
    return list(zip(of.tolist(), (low - base[of]).tolist(), np.split(p, ends[:-1]), strict=True))


def tag(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans the network finds in each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= HELD):
            size += len(texts[last])
            last += 1
        parts = [(first + k, low, p) for k, low, p in _stretches(tagger, texts[first:last])]
        parts.sort(key=lambda part: len(part[2]))
        for at in range(0, len(parts), 256):
            group = parts[at : at + 256]
            for (k, low, p), tags in zip(group, _viterbi([p for _, _, p in group]), strict=True):
                out[k] += [(low + start, kind, low + end) for start, kind, end in _spans(tags, p)]
        first = last
    return [sorted(spans) for spans in out]


def _viterbi(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Best valid tag sequence of each stretch under the averaged probabilities."""
    sizes, rows = np.array([len(p) for p in parts]), np.arange(len(parts))
    longest = int(sizes.max())
    scores = np.zeros((len(parts), longest, TAGS))
    for i, p in enumerate(parts):
        scores[i, : len(p)] = np.log(p + 1e-12)
    best = scores[:, 0] + np.where(_ALLOWED[-1], 0.0, _FORBIDDEN)
    back = np.zeros((longest, len(parts), TAGS), np.int8)
    for t in range(1, longest):
        # Inside comes from the begin or the inside of its kind, all others from the best tag.
        top, begin, inside = best.argmax(1), best[:, 1::2], best[:, 2::2]
        alive = (t < sizes)[:, None]
        options, origin = np.empty_like(best), np.empty(best.shape, np.int8)
        options[:], origin[:] = best[rows, top][:, None], top[:, None]
        np.maximum(begin, inside, out=options[:, 2::2])
        origin[:, 2::2] = np.where(inside > begin, _INSIDE, _INSIDE - 1)
        back[t] = np.where(alive, origin, np.arange(TAGS)[None])
        best = np.where(alive, options + scores[:, t], best)
    at = best.argmax(1)
    tags = np.zeros((len(parts), longest), np.int64)
    for t in range(longest - 1, -1, -1):
        tags[:, t] = at
        at = back[t][rows, at]
    return [tags[i, : sizes[i]] for i in range(len(parts))]


def _spans(tags: np.ndarray, probability: np.ndarray) -> list[tuple[int, int, int]]:
    out, start = [], None
    for t, tag_t in enumerate([*tags.tolist(), 0]):
        if start is not None and (tag_t == 0 or tag_t % 2 == 1):
            if np.mean(probability[np.arange(start, t), tags[start:t]]) >= SURE:
                out.append((start, (int(tags[start]) - 1) // 2, t))
            start = None
        if tag_t % 2 == 1:
            start = t
    return out


def find(docs: DataFrame, tagger: Tagger, text_col: str = "text", base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """All columns of ``docs`` plus ``base`` (the patterns' spans) and ``spans`` (those and the network's), in order."""
    spans_type = "array<struct<start:int,kind:int,end:int>>"
    new = StructType.fromDDL(f"`{base_col}` {spans_type}, `{spans_col}` {spans_type}")
    kept = [c for c in docs.columns if c not in new.names]
    frame, at = docs.select(*kept), kept.index(text_col)
    shared = frame.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def found(batches):
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                texts = [t or "" for t in part.column(at).to_pylist()]
                base = [pattern_spans(t) if _TRIGGER.search(t) else [] for t in texts]
                spans = []
                for own, more in zip(base, tag(shared.value, texts), strict=True):
                    spans.append(sorted(own + [m for m in more if not any(m[0] < e and s < m[2] for s, _, e in own)]))
                as_rows = lambda rows: pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in r] for r in rows], kind)
                yield pa.record_batch([*part.columns, as_rows(base), as_rows(spans)], names=[*kept, *new.names])

    return frame.mapInArrow(found, StructType(frame.schema.fields + new.fields))


def mask(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind, as in ``<EMAIL>``; overlapping spans go together under the name of the first."""
    held = find(docs, tagger, text_col, "_base_found", "_spans_found")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        put = F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        wider = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), put.alias("out"))).otherwise(wider)

    done = F.aggregate("_spans_found", begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    return held.select(*[F.when(F.size("_spans_found") > 0, done).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in docs.columns])
