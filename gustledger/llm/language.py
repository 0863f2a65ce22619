"""Log-probability of whole documents under a gated recurrent language model.

Word counts come from all training documents. The HEAD most frequent words have outputs of
their own; all others fall into forms (length, ending, first letter beyond ASCII). The network
predicts a class, which is a group of GROUP head words, a form, or the end of the text, and inside
a group the word: a class-factored softmax. Inside a form a known word has its share of the
form's training tokens, and unknown words together have the share of words seen once (Good-Turing),
so that the probabilities of all words known in training and of one unknown word per form add up to one.

Words become token numbers once, in a stored table of two bytes a token that training and scoring read.

The network is a GRU trained in numpy by truncated back-propagation. The driver starts it on a
small sample; then every training token is learned from once, in Spark tasks: in each of ROUNDS
rounds a task takes the weights of the round before through its share of the round's documents, and
the tasks' weights are averaged by their tokens. Scoring packs texts into lanes, takes them window by
window, and carries the state across windows, so that a text of any length is scored whole.

Null and empty texts consist of the end token. Rows repeated exactly score alike. Without training
documents nothing is known and all classes are equally likely.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gustledger.llm import words as W
from gustledger.llm.scratch import Scratch

#: Words with outputs of their own, words of a class, words whose counts every task holds; the bounds of the sample that training starts on.
HEAD, GROUP, HELD = 4096, 64, 500_000
SAMPLE_DOCS, SAMPLE_TOKENS = 800, 400_000
#: A small sample is gone through more often.
LEAST_UPDATES = 300
HIDDEN, LANES, STEPS = 24, 256, 32
#: Rounds that the training documents are dealt to, the least tokens a task should see in one, and its step size.
ROUNDS, TASK_TOKENS, RATE = 2, 1_000_000, 0.002
#: Tokens a task lays out at once; longer texts are learned in pieces, each from an empty state and the token before it.
HELD_TOKENS, PIECE = 1_000_000, 512
#: Rows whose class scores are worked on at once, and weights that are stepped at once, so that they stay in a processor's cache.
ROWS, CELLS = 512, 1 << 14
#: Times that a token may come in a window for its gradients to be added one by one.
RARE = 12
#: First bits of a hash that held words are looked up by.
BITS = 20
#: Bytes of weights in a row when the tasks' weights are averaged.
CHUNK = 1 << 16
#: Length bucket (4) x ending (2) x first letter beyond ASCII (8).
FORMS = 64
END = np.uint64(0x5851F42D4C957F2D)
LOG10 = float(np.log(10))


def forms(block: W.Block, found: W.Words) -> np.ndarray:
    """Form of every word, from its bytes; upper and lower case have the same."""
    data = block.data
    size = found.ends - found.starts
    length = np.searchsorted([5, 9, 13], size, "right")
    last = data[found.ends - 1] if len(size) else data[:0]
    plain_end = W.NOT_ALNUM[last]
    lead = np.flatnonzero(data >= 0xC0)
    at = np.searchsorted(lead, found.starts)
    has = at < len(lead)
    place = lead[np.minimum(at, max(len(lead) - 1, 0))] if len(lead) else np.zeros(len(size), np.int64)
    has &= place < found.ends
    follow = data[np.minimum(place + 1, max(len(data) - 1, 0))] if len(data) else data[:0]
    letter = np.where(has, 1 + (follow.astype(np.int64) * 5 + (follow >> 3)) % 7, 0) if len(size) else np.zeros(0, np.int64)
    return length * 16 + plain_end * 8 + letter


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes, an order of all by hash, and where each hash starts in it; equal words have one form, so any may stand for them."""
    order = np.argsort(h)
    h = h[order]
    cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    return h[cuts], order, cuts


def count_words(texts: DataFrame) -> DataFrame:
    """``h, form, c``: every word of the ``text`` column and the end token, with its count. Counts are summed in each partition first."""

    def counted(batches):
        held, ends = [], 0

        def flush():
            h, f, c = (np.concatenate(x) for x in zip(*held, strict=True))
            h, order, cuts = _runs(h)
            return pa.record_batch([pa.array(W.signed(h)), pa.array(f[order[cuts]].astype(np.int32)), pa.array(np.add.reduceat(c[order], cuts).astype(np.int64))], names=["h", "form", "c"])

        for batch in batches:
            ends += len(batch)
            for block in W.blocks(batch.column("text")):
                found = W.words(block, W.BLANKS, W.LOWER)
                h, order, cuts = _runs(found.hashes)
                held.append((h, forms(block, found)[order[cuts]], np.diff(np.append(cuts, len(order)))))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    yield flush()
                    held = []
        if ends:
            held.append((np.array([END]), np.array([-1]), np.array([ends])))
            yield flush()

    rows = texts.select("text").mapInArrow(counted, "h long, form int, c long")
    return rows.groupBy("h", "form").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Counts, form shares and network weights."""

    held: np.ndarray  # hashes of the held words, sorted
    held_count: np.ndarray
    held_id: np.ndarray  # head word number or -1
    form_known: np.ndarray  # log of (1 - unknown share) / tokens of the form
    form_unknown: np.ndarray
    head: int
    groups: int
    p: dict[str, np.ndarray]
    fitted: int = 0  # tokens the network learned from in Spark tasks

    @property
    def start(self) -> int:
        return self.head + FORMS

    @cached_property
    def lists(self) -> np.ndarray:
        """Where the held words with the same first BITS bits start."""
        return np.searchsorted(self.held, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS)).astype(np.int32)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """np.searchsorted() in the held words, but no further than the last one: hashes are spread evenly, so their lists are short."""
        last = len(self.held) - 1
        at = np.minimum(self.lists[(hashes >> np.uint64(64 - BITS)).view(np.int64)], last)
        behind = np.flatnonzero(self.held[at] < hashes)
        for _ in range(8):
            at[behind] += 1
            behind = behind[at[behind] <= last]
            behind = behind[self.held[at[behind]] < hashes[behind]]
            if not len(behind):
                break
        at[behind] = np.searchsorted(self.held, hashes[behind])
        return np.minimum(at, last)

    def tokens(self, block: W.Block) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
        """Words, their inputs, their counts (0: not held) and forms."""
        found = W.words(block, W.BLANKS, W.LOWER)
        form = forms(block, found)
        if len(self.held):
            at = self.places(found.hashes)
            known = self.held[at] == found.hashes
            number, count = np.where(known, self.held_id[at], -1), np.where(known, self.held_count[at], 0)
        else:
            number, count = np.full(len(form), -1), np.zeros(len(form), np.int64)
        return found, np.where(number >= 0, number, self.head + form), count, form


def _classes(model: Model, ids: np.ndarray) -> np.ndarray:
    """Output class: group of a head word, or form, or end."""
    return np.where(ids < model.head, ids // GROUP, model.groups + ids - model.head)


def _by_gate(weights: np.ndarray) -> np.ndarray:
    """Rows of all gates as (gate, row, unit), so that every step works on whole blocks."""
    return np.ascontiguousarray(weights.reshape(len(weights), 3, HIDDEN).transpose(1, 0, 2))


def _embedded(p: dict[str, np.ndarray], x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Inputs ``x`` as (gate, *x, unit)."""
    return p["x"].reshape(-1, HIDDEN).take(3 * x + np.arange(3).reshape(3, *[1] * x.ndim), 0, out, "clip")


def _step(p: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """State after rows of inputs ``x`` from state ``h``, and what the way back needs of it."""
    return _advanced(_by_gate(p["u"]), _by_gate(x), h, tuple(np.empty((*k, *h.shape), h.dtype) for k in ((), (), (3,), (2,))))


def _advanced(weights: np.ndarray, x: np.ndarray, h: np.ndarray, into: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """_step() with all gates apart; written to the arrays ``into``."""
    after, new, u, gates = into
    np.matmul(h, weights, out=u)
    np.add(x[:2], u[:2], out=gates)
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[1], u[2], out=new)
    new += x[2]
    np.tanh(new, out=new)
    np.subtract(h, new, out=after)
    after *= gates[0]
    after += new
    return after, new, u, gates


def _by_class(model: Model, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the targets by class, their classes in that order, and where each group starts (one entry more)."""
    cls = _classes(model, target).astype(np.int16)  # sorted by their digits
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    return order, cls, np.searchsorted(cls, np.arange(model.groups + 1))


def _with_bias(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes and of the words in the groups, each with the bias as a last row."""
    return np.concatenate([p["c"], p["cb"][None]]), np.concatenate([p["w"], p["wb"][:, None]], 1)


def _safe(weights: np.ndarray) -> bool:
    """Whether no scores under these weights can be too large to be raised: states lie between -1 and 1."""
    return bool(np.abs(weights).sum(-2).max(initial=0) < 80)


def _raised(x: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of rows of scores, in place, and their sums."""
    if not safe:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _words_in_groups(h: np.ndarray, weights: np.ndarray, cuts: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Scores of the words inside the groups; ``h`` stands in order of class."""
    out = np.empty((cuts[-1], GROUP), np.float32) if out is None else out
    for g in np.flatnonzero(np.diff(cuts)):
        np.matmul(h[cuts[g] : cuts[g + 1]], weights[g], out=out[cuts[g] : cuts[g + 1]])
    return out


def _blocks_of(n: int) -> list[slice]:
    return [slice(low, min(low + ROWS, n)) for low in range(0, n, ROWS)]


def _outputs(p: dict[str, np.ndarray]) -> list[tuple[np.ndarray, bool]]:
    """Weights of the classes and of the words in the groups, with bias, and whether they are safe."""
    return [(w, _safe(w)) for w in _with_bias(p)]


def _log_probabilities(model: Model, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target given its state: class, then word in the group."""
    return _log_shares(model, _outputs(model.p), np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1), target)


def _log_shares(model: Model, outputs: list[tuple[np.ndarray, bool]], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """_log_probabilities() from prepared weights and states that end in a one for the bias."""
    (classes, safe), (words, safe_words) = outputs
    order, cls, cuts = _by_class(model, target)
    h, place = h.take(order, 0), target[order] % GROUP
    found = np.empty(len(order), np.float32)

    def share(x, at, safe):
        own = x[np.arange(len(x)), at] if safe else x[np.arange(len(x)), at] - x.max(1)
        return own - np.log(_raised(x, safe)[1])

    for part in _blocks_of(len(order)):
        found[part] = share(h[part] @ classes, cls[part], safe)
    inside = _words_in_groups(h, words, cuts)
    for part in _blocks_of(len(inside)):
        found[part] += share(inside[part], place[part], safe_words)
    out = np.empty_like(found)
    out[order] = found
    return out


def _lanes(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts dealt to lanes, longest first, each to the emptiest lane; fullest lane first."""
    loads = [(0, k) for k in range(min(lanes, max(1, len(sizes))))]
    dealt: list[list[int]] = [[] for _ in loads]
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, k = heapq.heappop(loads)
        dealt[k].append(i)
        heapq.heappush(loads, (load + int(sizes[i]), k))
    return sorted(dealt, key=lambda lane: -sum(int(sizes[i]) for i in lane))


def _packed(model: Model, ids: np.ndarray, first: np.ndarray, lanes: int, before: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Inputs, targets, text numbers and text starts as (time, lane) arrays; unused places have text -1. ``before``: the token ahead of each text."""
    sizes = np.diff(first)
    dealt = _lanes(sizes, lanes)
    longest = max(int(sizes[lane].sum()) for lane in dealt)
    target = np.full((longest, len(dealt)), model.start, np.int32)
    text = np.full((longest, len(dealt)), -1, np.int32)
    starts = np.zeros((longest, len(dealt)), bool)
    for k, lane in enumerate(dealt):
        at = 0
        for i in lane:
            n = int(sizes[i])
            target[at : at + n, k] = ids[first[i] : first[i + 1]]
            text[at : at + n, k] = i
            starts[at, k] = True
            at += n
    inputs = np.full_like(target, model.start)
    inputs[1:] = target[:-1]
    inputs[starts] = model.start if before is None else before[text[starts]]
    return inputs, target, text, starts


def score_texts(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log-probability of each text's tokens (heads, forms, end), state carried through the text."""
    texts = len(first) - 1
    out = np.zeros(texts)
    if not texts:
        return out
    inputs, target, text, starts = _packed(model, ids, first, LANES)
    used, fresh = (text >= 0).sum(1).tolist(), starts.any(1).tolist()
    outputs, weights, lanes = _outputs(model.p), _by_gate(model.p["u"]), inputs.shape[1]
    h, after, new, u, gates = (np.zeros((*k, lanes, HIDDEN), np.float32) for k in ((), (), (), (3,), (2,)))
    states = np.ones((STEPS, lanes, HIDDEN + 1), np.float32)  # the last column is for the bias
    for low in range(0, len(inputs), STEPS):
        high = min(low + STEPS, len(inputs))
        width = used[low]
        embedded = _embedded(model.p, inputs[low:high, :width])
        for t in range(low, high):
            n = used[t]
            if fresh[t]:
                h[:n][starts[t, :n]] = 0
            _advanced(weights, embedded[:, t - low, :n], h[:n], (after[:n], new[:n], u[:, :n], gates[:, :n]))
            h, after = after, h
            states[t - low, :n, :HIDDEN] = h[:n]
        there = np.flatnonzero(text[low:high, :width] >= 0)
        at, lane = np.divmod(there, width)
        place = at * lanes + lane
        log_p = _log_shares(model, outputs, states.reshape(-1, HIDDEN + 1).take(place, 0), target[low:high].reshape(-1)[place])
        out += np.bincount(text[low:high].reshape(-1)[place], log_p, texts)
    return out


def _sums(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different tokens of ``x`` and the sums of their rows: one after the other where a token is rare, else its rows at once."""
    order = np.argsort(x.astype(np.int16), axis=None, kind="stable")
    tokens = x.reshape(-1)[order]
    cuts = np.flatnonzero(np.diff(tokens, prepend=-1))
    count = np.diff(np.append(cuts, len(order)))
    sums = rows.take(order[cuts], 0)
    some = np.flatnonzero((count > 1) & (count <= RARE))
    for k in range(1, RARE):
        some = some[count[some] > k]
        sums[some] += rows.take(order[cuts[some] + k], 0)
    for k in np.flatnonzero(count > RARE).tolist():
        own = rows.take(order[cuts[k] : cuts[k] + count[k]], 0)
        np.add.reduce(own, 0, out=sums[k])
    return tokens[cuts], sums


class _Trainer:
    """Adam steps on windows of tokens; gradients are cut at the window."""

    def __init__(self, model: Model):
        self.model, self.p, self.step = model, model.p, 0
        self.m = {k: np.zeros_like(w) for k, w in model.p.items()}
        self.v = {k: np.zeros_like(w) for k, w in model.p.items()}
        self.held: dict[str, np.ndarray] = {}

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """An array of any content that the next window gets again: memory given back and asked for anew costs a fifth of a step."""
        size = int(np.prod(shape))
        if size > len(self.held.get(name, ())):
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)

    def _adam(self, name: str, gradient: tuple, rate: float) -> None:
        """Step the weights ``name``; the gradient is given for some rows, and nothing for the others."""
        m, v, p = self.m[name], self.v[name], self.p[name]
        at, g = gradient
        m *= 0.9
        v *= 0.99
        m[at] += 0.1 * g
        v[at] += 0.01 * g**2
        m, v, p = m.reshape(-1), v.reshape(-1), p.reshape(-1)
        for low in range(0, len(p), CELLS):
            part = np.s_[low : low + CELLS]
            change = m[part] * (rate / (1 - 0.9**self.step))
            root = v[part] / (1 - 0.99**self.step)
            np.sqrt(root, out=root)
            root += 1e-6
            change /= root
            p[part] -= change

    def window(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, begin: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
        """One step on inputs ``x`` and targets ``y`` from state ``h``; returns the state after it."""
        model, p, n = self.model, self.p, HIDDEN
        space, shape = self._space, x.shape
        states = space("states", *shape, n + 1)
        states[:, :, n] = 1  # for the bias
        before, new, u, gates = (space(name, *k, *shape, n) for name, k in (("before", ()), ("new", ()), ("u", (3,)), ("gates", (2,))))
        embedded, weights = _embedded(p, x, space("embedded", 3, *shape, n)), _by_gate(p["u"])
        fresh, after = begin.any(1).tolist(), np.empty_like(h)
        for t in range(len(x)):
            before[t] = h
            if fresh[t]:
                before[t][begin[t]] = 0
            h, *_ = _advanced(weights, embedded[:, t], before[t], (after, new[t], u[:, t], gates[:, t]))
            states[t, :, :n] = h
        at = np.flatnonzero(live)
        y = y.reshape(-1)[at]
        order, cls, cuts = _by_class(model, y)
        at = at[order]
        size = len(order)
        hs, place = states.reshape(-1, n + 1).take(at, 0, space("hs", size, n + 1), "clip"), y[order] % GROUP
        classes, words = _with_bias(p)
        dclasses, dwords, dh_out = np.zeros_like(classes), np.zeros_like(words), space("dh_out", size, n)

        def less(scores, at, safe):
            """Probabilities less one at the row's place, over the number of targets."""
            d, sums = _raised(scores, safe)
            d *= (1 / (size * sums))[:, None]
            d[np.arange(len(d)), at] -= np.float32(1 / size)
            return d

        safe = _safe(classes)
        for part in _blocks_of(size):
            d, sums = _raised(hs[part] @ classes, safe)
            d[np.arange(len(d)), cls[part]] -= sums
            share = (1 / (size * sums))[:, None]  # of the few columns of the states, not of every class
            dclasses += (hs[part] * share).T @ d
            np.matmul(d, p["c"].T, out=dh_out[part])
            dh_out[part] *= share
        e, safe = _words_in_groups(hs, words, cuts, space("e", int(cuts[-1]), GROUP)), _safe(words)
        for part in _blocks_of(len(e)):
            less(e[part], place[part], safe)
        for k in np.flatnonzero(np.diff(cuts)):
            part = np.s_[cuts[k] : cuts[k + 1]]
            np.matmul(hs[part].T, e[part], out=dwords[k])
            dh_out[part] += e[part] @ p["w"][k].T
        dstates = space("dstates", x.size, n)
        dstates[~live.reshape(-1)] = 0
        dstates[at] = dh_out
        dstates = dstates.reshape(*shape, n)
        z, r = gates
        to_new, to_r, to_z, rest = (space(name, *shape, n) for name in ("to_new", "to_r", "to_z", "rest"))
        np.subtract(1, z, out=rest)
        np.subtract(before, new, out=to_z)
        to_z *= z
        to_z *= rest
        np.multiply(new, new, out=to_new)
        np.subtract(1, to_new, out=to_new)
        to_new *= rest
        np.subtract(1, r, out=rest)
        np.multiply(u[2], r, out=to_r)
        to_r *= rest
        dx, dnew, du, through = space("dx", *shape, 3, n), space("dnew", *shape, n), space("du", 3, *shape, n), space("through", 3, *h.shape)
        dh, back = np.zeros_like(h), np.ascontiguousarray(weights.transpose(0, 2, 1))
        for t in range(len(x) - 1, -1, -1):
            dh += dstates[t]
            np.multiply(dh, to_new[t], out=dnew[t])
            np.multiply(dnew[t], to_r[t], out=du[1, t])
            np.multiply(dh, to_z[t], out=du[0, t])
            np.multiply(dnew[t], r[t], out=du[2, t])
            dh *= z[t]
            np.matmul(du[:, t], back, out=through)
            for k in range(3):
                dh += through[k]
            if fresh[t]:
                dh[begin[t]] = 0
        for k, part in enumerate((du[0], du[1], dnew)):
            dx[:, :, k] = part
        du = [before.reshape(-1, n).T @ part.reshape(-1, n) for part in du]
        g = {"u": np.concatenate(du, 1), "c": dclasses[:-1], "cb": dclasses[-1], "w": dwords[:, :-1], "wb": dwords[:, -1]}
        self.step += 1
        for k in p:
            self._adam(k, _sums(x, dx.reshape(-1, 3 * n)) if k == "x" else (slice(None), g[k]), rate)
        return h


def _grow(model: Model, ids: np.ndarray, first: np.ndarray, rounds: int = 3, lanes: int = 32) -> None:
    """Train the network on the sample: windows of STEPS tokens, state carried, gradients cut at windows."""
    inputs, target, text, starts = _packed(model, ids, first, lanes)
    trainer = _Trainer(model)
    per_round = -(-len(inputs) // STEPS)
    rounds = max(rounds, -(-LEAST_UPDATES // per_round))
    total = rounds * per_round
    for _ in range(rounds):
        h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        for low in range(0, len(inputs), STEPS):
            x, y, live, begin = (a[low : low + STEPS] for a in (inputs, target, text >= 0, starts))
            h = trainer.window(x, y, live, begin, h, 0.01 * (1 - 0.9 * (trainer.step + 1) / total))


def _learn(trainer: _Trainer, ids: np.ndarray, first: np.ndarray) -> None:
    """One pass over texts of any length."""
    sizes = np.diff(first)
    pieces = -(-sizes // PIECE)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(first[:-1], pieces) + number * PIECE
    before = np.where(number > 0, ids[at - 1], trainer.model.start)
    inputs, target, text, starts = _packed(trainer.model, ids, np.append(at, first[-1]), LANES, before)
    used = (text >= 0).sum(1)
    h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
    for low in range(0, len(inputs), STEPS):
        here = np.s_[low : low + STEPS, : int(used[low])]
        h = trainer.window(inputs[here], target[here], text[here] >= 0, starts[here], h[: int(used[low])], RATE)


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts of an ``ids`` column, flat, and where each text's begin."""
    bounds, data = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 2, column.buffers()[2]
    return np.frombuffer(data, "<i2")[bounds[0] : bounds[-1]] if data else np.zeros(0, "<i2"), (bounds - bounds[0]).astype(np.int64)


def _averaged(texts: DataFrame, model: Model, tasks: int) -> tuple[dict[str, np.ndarray], int]:
    """Weights after one pass in at most ``tasks`` tasks from the model's, averaged by tokens; and how many tokens that were.

    ``texts`` has coded ``ids``, or a ``text`` to be coded.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def learned(batches):
        m = shared.value
        trainer = _Trainer(replace(m, p={k: w.copy() for k, w in m.p.items()}))
        held, n, done = [], 0, 0

        def take():
            ids = np.concatenate([i for i, _ in held]).astype(np.int32)
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in held]))])
            _learn(trainer, ids, first)

        for batch in batches:
            ids, first = _numbers(batch.column(0))
            low = 0
            while low < len(batch):
                high = max(low + 1, int(np.searchsorted(first, first[low] + HELD_TOKENS - n, "right")) - 1)
                held.append((ids[first[low] : first[high]], first[low : high + 1]))
                n += len(held[-1][0])
                if n >= HELD_TOKENS or high < len(batch):
                    take()
                    held, n, done = [], 0, done + n
                low = high
        if n:
            take()
            done += n
        if done:
            data = _flat(trainer.p).astype("<f4").tobytes()
            cuts = range(0, len(data), CHUNK)
            yield pa.record_batch([pa.array(range(len(cuts)), pa.int32()), pa.array([done] * len(cuts), pa.int64()), pa.array([data[c : c + CHUNK] for c in cuts], pa.binary())], names=["chunk", "tokens", "weights"])

    def mean(part):
        total, out = 0, 0.0
        for tokens, data in zip(part["tokens"].to_pylist(), part["weights"].to_pylist(), strict=True):
            total, out = total + tokens, out + tokens * np.frombuffer(data, "<f4").astype(np.float64)
        return pa.table({"chunk": part["chunk"].combine_chunks()[:1].cast(pa.int32()), "tokens": pa.array([total], pa.int64()), "weights": pa.array([(out / total).astype("<f4").tobytes()], pa.binary())})

    schema = "chunk int, tokens long, weights binary"
    coded = texts if "ids" in texts.columns else _coded_texts(texts.select(F.lit(0).alias("row"), F.lit(0).alias("id"), "text", F.lit(0).alias("round")), model)
    rows = coded.select("ids").coalesce(tasks).mapInArrow(learned, schema).groupBy("chunk").applyInArrow(mean, schema).collect()
    shared.unpersist()
    if not rows:
        return model.p, 0
    flat = np.frombuffer(b"".join(r["weights"] for r in sorted(rows, key=lambda r: r["chunk"])), "<f4")
    out, at = {}, 0
    for k in sorted(model.p):
        w = model.p[k]
        out[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
        at += w.size
    return out, rows[0]["tokens"]


def train(texts: DataFrame, counts: DataFrame, rounds: int = 3) -> Model:
    """Model from training texts (``id, text``) and their stored word counts. The driver gets HELD counts, the first sample and averaged weights."""
    model = _started(texts, counts, rounds)
    return _taught(model, _coded_texts(texts.select(F.lit(0).alias("row"), "id", "text", _round().alias("round")), model))


def _round() -> Column:
    """The round in which a training text is learned from."""
    return F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS)).cast("int")


def _taught(model: Model, coded: DataFrame) -> Model:
    """The model after ROUNDS rounds over the coded training texts; rows without round are left out."""
    tasks = max(1, int(model.held_count.sum()) // (ROUNDS * TASK_TOKENS))
    for k in range(ROUNDS if len(model.held) else 0):
        model.p, fitted = _averaged(coded.where(F.col("round") == k), model, tasks)
        model.fitted += fitted
    return model


def _started(texts: DataFrame, counts: DataFrame, rounds: int = 3) -> Model:
    """Model with its counts, its network trained on the first sample."""
    plain = counts.where(F.col("form") >= 0)
    top = plain.groupBy("h").agg(F.sum("c").alias("c"), F.min("form").alias("form")).orderBy(F.desc("c"), "h").limit(HELD).toArrow()
    h, c = np.asarray(top["h"].combine_chunks()).view(np.uint64), np.asarray(top["c"].combine_chunks())
    head = min(HEAD, len(h))
    groups = -(-head // GROUP)
    own = counts.sparkSession.createDataFrame([(int(x),) for x in h[:head].view(np.int64)], "h long")
    by_form = plain.join(F.broadcast(own), "h", "left_anti").groupBy("form").agg(F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()
    tokens, once = np.zeros(FORMS), np.zeros(FORMS)
    for row in by_form:
        tokens[row["form"]], once[row["form"]] = row["n"], row["once"]
    unknown = np.where(tokens > 0, (once + 1) / (tokens + 2), 1.0)
    ends = counts.where("form < 0").agg(F.sum("c")).first()[0] or 0
    order = np.argsort(h, kind="stable")
    number = np.where(np.arange(len(h)) < head, np.arange(len(h)), -1)
    rng = np.random.default_rng(1)
    classes = groups + FORMS + 1
    weight = np.concatenate([[c[g * GROUP : min((g + 1) * GROUP, head)].sum() for g in range(groups)], tokens, [ends]]) + 1.0
    inside = np.full((groups, GROUP), -30.0)
    inside.ravel()[:head] = np.log(c[:head])
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    p = {
        "x": small(groups * GROUP + FORMS + 1, 3 * HIDDEN), "u": small(HIDDEN, 3 * HIDDEN),
        "c": small(HIDDEN, classes), "cb": np.log(weight / weight.sum()).astype(np.float32) if len(h) else np.zeros(classes, np.float32),
        "w": small(groups, HIDDEN, GROUP) * 0.1, "wb": inside.astype(np.float32),
    }
    known = np.where(tokens > 0, np.log(np.maximum(1 - unknown, 1e-12)) - np.log(np.maximum(tokens, 1)), 0.0)
    model = Model(h[order], c[order], number[order], known, np.log(unknown), groups * GROUP, groups, p)
    rows = texts.orderBy(F.xxhash64("id"), "id", "text").limit(SAMPLE_DOCS).select("text").toArrow()["text"].combine_chunks()
    ids, first = _coded(model, rows)
    cut = int(np.searchsorted(first, SAMPLE_TOKENS, "right"))
    if len(h) and len(first) > 1:
        first = first[: max(cut, 2)]
        _grow(model, ids[: first[-1]], first, rounds)
    return model


def _coded(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts, sizes = [], []
    for block in W.blocks(column):
        found, ids, _, _ = model.tokens(block)
        parts.append(np.insert(ids, found.first[1:], model.start))
        sizes.append(found.counts() + 1)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _coded_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (row, id, text, round): tokens, known tokens, sums over held words, the words not held, and the token numbers in two bytes each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = "n_tokens long, n_known long, base double, tail double, rare array<struct<h:long,form:int,n:int>>, ids binary"
    schema = StructType(docs.select("row", "id", "round").schema.fields + StructType.fromDDL(added).fields)
    kind = pa.list_(pa.struct([("h", pa.int64()), ("form", pa.int32()), ("n", pa.int32())]))

    def passed(batches):
        m = shared.value
        for batch in batches:
            coded, first, n_known, base, tail, rare, rare_first = [], [np.zeros(1, np.int64)], [], [], [], [], [np.zeros(1, np.int64)]
            for block in W.blocks(batch.column(2)):
                found, ids, count, form = m.tokens(block)
                texts = len(block)
                coded.append(np.insert(ids.astype("<i2"), found.first[1:], m.start))
                first.append(first[-1][-1] + np.cumsum(found.counts() + 1))
                here = count > 0
                n_known.append(np.bincount(found.text[here], minlength=texts))
                base.append(np.bincount(found.text[here], np.log10(count[here] + 0.1), texts))
                form_word = here & (ids >= m.head)
                tail.append(np.bincount(found.text[form_word], (np.log(count[form_word]) + m.form_known[form[form_word]]) / LOG10, texts))
                text, h, f = found.text[~here], found.hashes[~here], form[~here]
                order = np.lexsort((h, text))
                text, h, f = text[order], h[order], f[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(new)
                rare.append((W.signed(h[at]), f[at].astype(np.int32), np.diff(np.append(at, len(h))).astype(np.int32)))
                rare_first.append(rare_first[-1][-1] + np.cumsum(np.bincount(text[at], minlength=texts)))
            if not coded:
                continue
            first = np.concatenate(first)
            fields = [np.concatenate(x) for x in zip(*rare, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(rare_first).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in fields], fields=list(kind.value_type)))
            ids = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(np.concatenate(coded))])
            sums = [pa.array(x) for x in (np.diff(first), *map(np.concatenate, (n_known, base, tail)))]
            sums[2:] = [x.cast(pa.float64()) for x in sums[2:]]  # without words bincount() counts in whole numbers
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), *sums, lists, ids], names=schema.names)

    return docs.mapInArrow(passed, schema)


def _network(coded: DataFrame, model: Model) -> DataFrame:
    """``row, id, n_tokens, n_known, base, model``: the network's sum in place of the token numbers."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    frame = coded.select("row", "id", "n_tokens", "n_known", "base", F.col("tail").alias("model"), "ids")

    def scored(batches):
        m = shared.value
        for batch in batches:
            ids, first = _numbers(batch.column(6))
            total = score_texts(m, ids, first) / LOG10 + np.asarray(batch.column(5))
            yield pa.record_batch([*batch.columns[:5], pa.array(total)], names=batch.schema.names[:6])

    return frame.mapInArrow(scored, frame.drop("ids").schema)


def score(docs: DataFrame, training: Column, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` of every document; ``training`` says which ones to learn from.

    Words beyond the HELD most frequent meet their counts in a join on the word, once per document
    and word, and are summed per document.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    texts = own.where("training").select("id", "text")
    counts = scratch.store(count_words(texts))
    total = counts.agg(F.sum("c").alias("n"), F.count_distinct("h").alias("v"), F.sum(F.when(F.col("form") < 0, F.col("c"))).alias("ends")).first()
    n, v, ends = total["n"] or 0, total["v"] or 0, total["ends"] or 0
    model = _started(texts, counts)
    # Rows are numbered once and stored with their number.
    coded = scratch.store(_coded_texts(own.select(F.monotonically_increasing_id().alias("row"), "id", "text", F.when(F.col("training"), _round()).alias("round")), model))
    passed = scratch.store(_network(coded, _taught(model, coded)))
    rare = coded.select("row", F.explode("rare").alias("w")).select("row", "w.*")
    met = rare.join(counts.select("h", "c").groupBy("h").agg(F.sum("c").alias("c")), "h", "left")
    listed = lambda x: F.array(*[F.lit(float(i / LOG10)) for i in x])
    form = F.col("form") + 1
    inside = F.when(F.col("c").isNull(), F.element_at(listed(model.form_unknown), form)).otherwise(F.log10("c") + F.element_at(listed(model.form_known), form))
    sums = met.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more_base"), F.sum(F.col("n") * inside).alias("more_model"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("more_known"),
    )
    scale = float(np.log10(n + 0.1 * (v + 1)))
    full = passed.join(sums, "row", "left")
    end_base, end_known = float(np.log10(ends + 0.1)), int(ends > 0)
    none = F.lit(0)
    return full.select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", none) + end_known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", none) + end_base - F.col("n_tokens") * scale).alias("base_score"), (F.col("model") + F.coalesce("more_model", none)).alias("score"),
    )
