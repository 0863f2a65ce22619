"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a few shares and sizes. Each feature is cut into bins at its quantiles, and the
log-odds of a text are a constant, one number per feature from that feature's lookup table, and one
number per chosen pair of features from a table over both their bins. The tables are learned by
cyclic boosting: round after round, every feature in turn gets a tree of three leaves over its bins,
fitted to what is left, and a small step of it is added to the table. Pairs follow on the same terms
with trees of four leaves (one cut on each side); those whose best tree explains most of the rest
are used. Rows set aside say when to stop. A score is a sum of lookups.

A null or empty text has no words and gets the score of its all-zero features. Rows repeated exactly
score alike; a document with several rows or labels counts once in training (smallest features,
largest label). Without labels every score is 0.5; with one label only, its smoothed share. Texts of
any length are read in parts of at most ``PART`` bytes, cut at a line end, else at a blank, else
inside the word; a word or line at a cut may count as two, and nothing else depends on the cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gustledger.llm import words as W

#: Labelled documents the model is fitted on, those with the smallest hash of their id.
SAMPLE = 20_000
#: Bytes of a part of a text; bins of a feature, and of each side of a pair; pairs used.
PART = 1 << 20
BINS = 48
PAIR_BINS = 12
PAIRS = 8
#: Step, ridge on a leaf, least weight of a leaf, most rounds, and rounds without gain before the end.
STEP = 0.1
RIDGE = 1.0
LEAST_WEIGHT = 2.0
ROUNDS = 300
PATIENCE = 20

FEATURES = (
    "log_words word_bytes log_line_words sentence_words upper digits symbols stops excited other_marks not_ascii blanks "
    "capital_words long_words short_words bare_words again distinct_words distinct_triples repeated_lines"
).split()

_CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "digits": "0123456789",
    "symbols": "#*$%&|<>",
    "stops": ".,;:",
    "excited": "!?",
    "other_marks": "\"'()-/@[]\\^_`{}~+=",
    "blanks": " \t\n\v\f\r",
}
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)  # control characters
for _number, _characters in enumerate(_CLASSES.values()):
    _CLASS_OF[[ord(c) for c in _characters]] = _number
_CLASS_OF[128:] = len(_CLASSES) + 1
_LETTER = np.array([chr(i).isascii() and chr(i).isalpha() or i > 127 for i in range(256)])
_LINE_END = np.zeros(256, bool)
_LINE_END[0x0A] = True
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[0x0A, 0x21, 0x2E, 0x3F]] = True


def parts(block: W.Block, most: int = PART) -> Iterator[W.Block]:
    """A block as it is, or the parts of its one long text."""
    if len(block) > 1 or len(block.data) <= most:
        yield block
        return
    start, data = 0, block.data
    while start < len(data):
        end = min(start + most, len(data))
        if end < len(data):
            for separators in (_LINE_END, W.BLANKS):
                if len(at := np.flatnonzero(separators[data[start:end]])):
                    end = start + int(at[-1]) + 1
                    break
            else:
                while end > start + 1 and data[end] & 0xC0 == 0x80:  # not inside a character
                    end -= 1
        yield W.Block(block.first, data[start:end], np.array([0, end - start]))
        start = end


def _counted(block: W.Block) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Sums of each text of a block, and the hashes of its words, word triples and lines with their text."""
    texts, data = len(block), block.data
    found = W.words(block)
    place = np.searchsorted(block.bounds, np.arange(len(data)), "right") - 1 if texts > 1 else np.zeros(len(data), np.int64)
    kinds = len(_CLASSES) + 2
    classes = np.bincount(place * kinds + _CLASS_OF[data], minlength=texts * kinds).reshape(texts, kinds)
    size = found.ends - found.starts
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    has_letter = letters[found.ends] > letters[found.starts]
    first = data[found.starts] if len(size) else np.zeros(0, np.uint8)
    again = np.zeros(len(size), bool)
    again[1:] = (found.hashes[1:] == found.hashes[:-1]) & (found.text[1:] == found.text[:-1])
    starts, ends = W.ranges(data, block.bounds, _LINE_END)
    filled = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    starts, ends = starts[filled], ends[filled]
    line_text = np.searchsorted(block.bounds, starts, "right") - 1
    lines = W.range_hash(W.range_sums(W._CODES[data]), starts, ends)
    sentence_starts, _ = W.ranges(data, block.bounds, _SENTENCE_END)
    sentences = np.bincount(np.searchsorted(block.bounds, sentence_starts, "right") - 1, minlength=texts)
    triples, at = W.grams(found, 3)
    by_word = [size, (first >= 65) & (first <= 90), size > 20, size <= 3, ~has_letter, again]
    columns = [found.counts(), *(np.bincount(found.text, v, texts) for v in by_word), np.bincount(line_text, minlength=texts), sentences, np.bincount(found.text[at], minlength=texts)]
    return np.column_stack([classes, *columns]).astype(float), [(found.hashes, found.text), (triples, found.text[at]), (lines, line_text)]


def features(column: pa.Array, most: int = PART) -> np.ndarray:
    """One row of FEATURES for each text of a column."""
    rows = [np.zeros((0, len(FEATURES)))]
    for block in W.blocks(column):
        sums, distinct, union = 0.0, None, [[], [], []]
        for part in parts(block, most):
            counts, hashed = _counted(part)
            sums = sums + counts
            if part is block:
                distinct = np.column_stack([np.diff(W.per_text(text, values, len(block))[1]) for values, text in hashed])
            else:
                for seen, (values, _) in zip(union, hashed, strict=True):
                    seen.append(np.unique(values))
        if distinct is None:
            distinct = np.array([[len(np.unique(np.concatenate(seen))) for seen in union]])
        rows.append(_shares(sums, distinct.astype(float)))
    return np.concatenate(rows)


def _shares(sums: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    kinds = len(_CLASSES) + 2
    by_class = dict(zip([*_CLASSES, "control", "not_ascii"], sums[:, :kinds].T, strict=True))
    words, size, capital, long, short, bare, again, lines, sentences, triples = sums[:, kinds:].T
    total = np.maximum(sums[:, :kinds].sum(1), 1)
    per_word, ascii_letters = np.maximum(words, 1), np.maximum(by_class["upper"] + by_class["lower"], 1)
    values = {
        "log_words": np.log1p(words),
        "word_bytes": size / per_word,
        "log_line_words": np.log1p(words / np.maximum(lines, 1)),
        "sentence_words": np.log1p(words / np.maximum(sentences, 1)),
        "upper": by_class["upper"] / ascii_letters,
        **{k: by_class[k] / total for k in ("digits", "symbols", "stops", "excited", "other_marks", "not_ascii", "blanks")},
        "capital_words": capital / per_word,
        "long_words": long / per_word,
        "short_words": short / per_word,
        "bare_words": bare / per_word,
        "again": again / per_word,
        "distinct_words": distinct[:, 0] / per_word,
        "distinct_triples": distinct[:, 1] / np.maximum(triples, 1),
        "repeated_lines": 1 - distinct[:, 2] / np.maximum(lines, 1),
    }
    values["repeated_lines"] = np.where(lines > 0, values["repeated_lines"], 0)
    return np.column_stack([values[name] for name in FEATURES])


@dataclass
class Model:
    """Constant, bin edges and table of each feature, and coarse edges and table of each pair."""

    constant: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.constant)
        for values, edges, table in zip(x.T, self.edges, self.tables, strict=False):
            odds += table[binned(values, edges)]
        sides = {i: binned(x[:, i], self.coarse[i]) for i in {i for pair in self.pairs for i in pair}}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            odds += table[sides[a], sides[b]]
        return odds


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, values, "right")


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, as even as ties allow."""
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h >= LEAST_WEIGHT, g * g / (h + RIDGE), -np.inf)


def _best_cut(g: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Gain and place of the best cut of the bins from ``low`` to ``high``; g and h are running sums with a zero first."""
    if high - low < 2:
        return -np.inf, low
    inner = np.arange(low + 1, high)
    left = _gain(g[inner] - g[low], h[inner] - h[low])
    right = _gain(g[high] - g[inner], h[high] - h[inner])
    gains = left + right - max(_gain(g[high] - g[low], h[high] - h[low]), 0)
    best = int(gains.argmax())
    return float(gains[best]), int(inner[best])


def feature_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of up to three leaves, from the bins' gradients and weights."""
    g, h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    leaves = [0, len(g) - 1]
    for _ in range(2):
        cuts = [_best_cut(g, h, a, b) for a, b in zip(leaves[:-1], leaves[1:], strict=True)]
        gain, at = max(cuts)
        if gain <= 0:
            break
        leaves = sorted([*leaves, at])
    values = [(g[b] - g[a]) / (h[b] - h[a] + RIDGE) for a, b in zip(leaves[:-1], leaves[1:], strict=True)]
    return np.repeat(values, np.diff(leaves))


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values per cell of the best tree that cuts each side of a table once."""
    sums = [np.pad(np.cumsum(np.cumsum(v, 0), 1), ((1, 0), (1, 0))) for v in (g, h)]
    corners = []
    for s in sums:
        top_left, top, left, whole = s[1:-1, 1:-1], s[1:-1, -1:], s[-1:, 1:-1], s[-1, -1]
        corners.append((top_left, top - top_left, left - top_left, whole - top - left + top_left))
    if not corners[0][0].size:
        return 0.0, np.zeros_like(g)
    gain = sum(np.where(hh > 0, gg * gg / (hh + RIDGE), 0) for gg, hh in zip(*corners, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    leaf = [gg[i, j] / (hh[i, j] + RIDGE) if hh[i, j] >= LEAST_WEIGHT else 0.0 for gg, hh in zip(*corners, strict=True)]
    values = np.empty_like(g)
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), values


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = ROUNDS) -> Model:
    """Learn the tables. Every fifth row of the given order is set aside to say when to stop."""
    y = np.asarray(y, float)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    model.edges = [quantile_edges(v, BINS) for v in x.T]
    model.coarse = [quantile_edges(v, PAIR_BINS) for v in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [binned(v, e) for v, e in zip(x.T, model.edges, strict=True)]
    coarse = [binned(v, e) for v, e in zip(x.T, model.coarse, strict=True)]
    learn = np.arange(len(y)) % 5 != 4
    check = ~learn if learn.sum() < len(y) else learn
    odds = np.full(len(y), model.constant)

    def pull() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return np.where(learn, y - p, 0), np.where(learn, p * (1 - p), 0)

    def boost(tables: list[np.ndarray], cells: list[np.ndarray], tree) -> None:
        nonlocal odds
        best, kept, since = np.inf, None, 0
        for _ in range(rounds):
            for table, cell in zip(tables, cells, strict=True):
                g, h = pull()
                step = STEP * tree(np.bincount(cell, g, table.size).reshape(table.shape), np.bincount(cell, h, table.size).reshape(table.shape))
                table += step
                odds += step.ravel()[cell]
            loss = np.logaddexp(0, np.where(y > 0, -odds, odds))[check].mean()
            since += 1
            if loss < best - 1e-6:
                best, kept, since = loss, ([t.copy() for t in tables], odds.copy()), 0
            if since >= PATIENCE:
                break
        for table, value in zip(tables, kept[0], strict=True):
            table[...] = value
        odds = kept[1]

    boost(model.tables, bins, feature_tree)
    g, h = pull()
    shapes = [len(e) + 1 for e in model.coarse]
    cell_of = lambda a, b: coarse[a] * shapes[b] + coarse[b]
    gains = []
    for a, b in combinations(range(x.shape[1]), 2):
        grid = [np.bincount(cell_of(a, b), v, shapes[a] * shapes[b]).reshape(shapes[a], shapes[b]) for v in (g, h)]
        gains.append((pair_tree(*grid)[0], a, b))
    model.pairs = [(a, b) for gain, a, b in sorted(gains, key=lambda r: (-r[0], r[1], r[2]))[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((shapes[a], shapes[b])) for a, b in model.pairs]
    if model.pairs:
        boost(model.pair_tables, [cell_of(a, b) for a, b in model.pairs], lambda g, h: pair_tree(g, h)[1])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``sample`` labelled documents; ``labels`` has only rows that may be learned from.

    The sample is picked by a hash of the id, and its ids, at most ``sample``, are broadcast. The texts
    become features where they are read; only features, one row per document, reach the driver.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    met = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_text", "_y")
    schema = StructType([met.schema["_id"], met.schema["_y"], *StructType.fromDDL("_x array<double>").fields])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], names=["_id", "_y", "_x"])

    rows = met.mapInArrow(described, schema).groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_x").alias("_x"), F.first(F.xxhash64("_id")).alias("_order"))
    rows = rows.toArrow().sort_by([("_order", "ascending"), ("_id", "ascending")])
    x = np.array(rows["_x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["_y"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``score``, the probability of label 1."""
    kept = [c for c in docs.columns if c != score_col]
    frame, column = docs.select(*kept), kept.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = model.log_odds(features(batch.column(column)))
            yield pa.record_batch([*batch.columns, pa.array(1 / (1 + np.exp(-odds)))], names=[*kept, score_col])

    return frame.mapInArrow(scored, StructType(frame.schema.fields + StructType.fromDDL(f"`{score_col}` double").fields))
