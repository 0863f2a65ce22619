"""Toxicity by multiple-instance learning: documents carry labels, sentences carry the blame.

A sentence's probability is logistic in its words. A document is toxic unless none of its
sentences is and no background cause applies: ``1 - (1 - leak) * prod(1 - p_sentence)``, the
noisy-or. The likelihood of the document labels is climbed directly, so that sentences need no
labels, and the sentences with the highest probability are then the offending ones. The leak takes
up labels that no sentence explains. It keeps documents from being blamed for their length.

Sentences end at ``.``, ``!``, ``?`` or a line end; words are runs of letters and digits. A null
or empty text has no sentences: its score is the leak. Rows repeated exactly score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gustledger.llm import words as W

#: Labelled documents the model is fitted on, those with the smallest hash of their id.
SAMPLE = 10_000
#: Words in fewer documents of the sample are not used.
LEAST_DOCS = 8
#: Words in sentences that the sums of a step are made of at once.
PART = 1 << 16
_END = np.zeros(256, bool)
_END[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True


@dataclass
class Bags:
    """Sentences of a block: words' hashes with their sentence, sentences' byte ranges and document."""

    hashes: np.ndarray
    sentence: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def bags(block: W.Block) -> Bags:
    found = W.words(block, W.NOT_ALNUM, W.LOWER)
    starts, ends = W.ranges(block.data, block.bounds, _END)
    sentence = np.searchsorted(starts, found.starts, "right") - 1
    used, sentence = np.unique(sentence, return_inverse=True)
    starts, ends = starts[used], ends[used]
    return Bags(found.hashes, sentence, starts, ends, np.searchsorted(block.bounds, starts, "right") - 1)


@dataclass
class Model:
    """Sorted word hashes with their weights, the sentence bias and the log of 1 - leak."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    log_not_leak: float

    def sentences(self, b: Bags) -> np.ndarray:
        """Log-odds of each sentence."""
        if not len(self.hashes):
            return np.full(len(b.starts), self.bias)
        at = np.minimum(np.searchsorted(self.hashes, b.hashes), len(self.hashes) - 1)
        known = self.hashes[at] == b.hashes
        # As in training, a word counts once in a sentence.
        pairs = np.unique(b.sentence[known] * len(self.hashes) + at[known])
        return self.bias + np.bincount(pairs // len(self.hashes), self.weights[pairs % len(self.hashes)], len(b.starts))

    def documents(self, b: Bags, odds: np.ndarray, texts: int) -> np.ndarray:
        clean = -np.logaddexp(0, odds)
        return -np.expm1(self.log_not_leak + np.bincount(b.text, clean, texts))


def _entries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Words in LEAST_DOCS texts or more, by hash; each of them once per sentence, in order of word and sentence; each sentence's text; and the number of texts.

    A block's hashes go as soon as its words have numbers: there is one set of them at a time besides the numbers.
    """
    sentences, docs = 0, 0
    hashes, sentence, text, found = [], [], [], []
    for block in W.blocks(texts):
        b = bags(block)
        # Each word once per sentence.
        order = np.lexsort((b.sentence, b.hashes))  # sentences, and so documents, stay in order within a word
        h, at = b.hashes[order], b.sentence[order].astype(np.int32)
        new_word = np.append(True, h[1:] != h[:-1])[: len(h)]
        fresh = new_word.copy()
        fresh[1:] |= at[1:] != at[:-1]
        h, at, new_word = h[fresh], at[fresh], new_word[fresh]
        new_doc = new_word.copy()
        new_doc[1:] |= b.text[at[1:]] != b.text[at[:-1]]
        starts = np.flatnonzero(new_word)
        found.append((h[starts], np.add.reduceat(new_doc, starts, dtype=np.int64) if len(starts) else starts))
        hashes.append(h)
        sentence.append(at + np.int32(sentences))
        text.append((b.text + docs).astype(np.int32))
        sentences += len(b.starts)
        docs += len(block)
    if not sentences:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), docs
    vocabulary, at = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
    vocabulary = vocabulary[np.bincount(at, np.concatenate([n for _, n in found]), len(vocabulary)) >= LEAST_DOCS]
    del found
    word = []
    for k, h in enumerate(hashes):
        at = np.searchsorted(vocabulary, h).astype(np.int32)
        use = vocabulary[np.minimum(at, len(vocabulary) - 1)] == h if len(vocabulary) else np.zeros(len(h), bool)
        word.append(at[use])
        sentence[k], hashes[k] = sentence[k][use], None
    word, sentence = np.concatenate(word), np.concatenate(sentence)
    order = np.argsort(word, kind="stable")
    return vocabulary, word[order], sentence[order], np.concatenate(text), docs


def _parts(first: np.ndarray) -> list[tuple[slice, slice]]:
    """Groups, and their entries, of which PART or those of one group are worked on at once; ``first``: where each group's entries begin (one more)."""
    out, low, groups = [], 0, len(first) - 1
    while low < groups:
        high = min(max(low + 1, int(np.searchsorted(first, first[low] + PART, "right")) - 1), groups)
        out.append((slice(low, high), slice(first[low], first[high])))
        low = high
    return out


class _Sums:
    """Sums over groups of entries, of the values that the entries point to."""

    def __init__(self, group: np.ndarray, points_to: np.ndarray, groups: int):
        """``group``: of each entry, in order."""
        self.size = np.bincount(group, minlength=groups).astype(np.int32)
        self.points_to = points_to
        self.parts = _parts(np.concatenate([[0], np.cumsum(self.size, dtype=np.int64)]))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.size))
        for own, entries in self.parts:
            n = own.stop - own.start
            out[own] = np.bincount(np.repeat(np.arange(n), self.size[own]), values[self.points_to[entries]], n)
        return out


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = 300, rate: float = 0.1, l1: float = 1e-5) -> Model:
    """Maximum likelihood with a lasso on the words, by Adam with a proximal step, over the whole sample each time."""
    return _climbed(*_entries(texts), labels, rounds, rate, l1)


def _climbed(vocabulary: np.ndarray, word: np.ndarray, sentence: np.ndarray, text: np.ndarray, docs: int, labels: np.ndarray, rounds: int = 300, rate: float = 0.1, l1: float = 1e-5) -> Model:
    """fit() from the entries of the texts."""
    sentences = len(text)
    if not docs or not sentences:
        share = min(max(float(np.mean(labels)) if len(labels) else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0, float(np.log1p(-share)))
    of_words = _Sums(word, sentence, len(vocabulary))
    order = np.argsort(sentence, kind="stable")
    of_sentences = _Sums(sentence[order], word[order], sentences)
    del word, sentence, order
    y = labels.astype(float)
    base = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, bias, leak = np.zeros(len(vocabulary)), -5.0, np.log(base / (1 - base))
    m = np.zeros(len(w) + 2)
    v = np.zeros(len(w) + 2)
    for step in range(1, rounds + 1):
        odds = bias + of_sentences(w)
        p = 1 / (1 + np.exp(-odds))
        leak_p = 1 / (1 + np.exp(-leak))
        log_clean = np.bincount(text, -np.logaddexp(0, odds), docs) - np.logaddexp(0, leak)
        dirty = np.maximum(-np.expm1(log_clean), 1e-9)
        # d log-likelihood / d log(1 - p) of a part: 1 when clean, -(1 - P) / P when toxic
        pull = np.where(y > 0, np.exp(log_clean) / dirty, -1.0)
        by_sentence = pull[text] * p / docs
        gradient = np.concatenate([of_words(by_sentence), [by_sentence.sum(), (pull * leak_p).sum() / docs]])
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        pace = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-5)
        move = pace * m / (1 - 0.9**step)
        w += move[:-2]
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(pace[:-2], 1e4) * l1, 0)
        bias, leak = min(bias + move[-2], -3.0), leak + move[-1]
    used = w != 0
    return Model(vocabulary[used], w[used], float(bias), float(-np.logaddexp(0, leak)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``sample`` labelled documents; ``labels`` has only rows that may be learned from.

    The sample is picked by a hash of the id, and its ids, at most ``sample``, are broadcast. Rows
    without id, label or document are not used; of several labels of a document the largest counts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_text", "_y").toArrow()
    rows = rows.sort_by("_id")
    found, labels = _entries(rows["_text"].combine_chunks()), rows["_y"].to_numpy().astype(np.float64)
    del rows  # the texts are not held while the model is fitted
    pa.default_memory_pool().release_unused()
    return _climbed(*found, labels)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5, score_col: str = "score", offending_col: str = "offending") -> DataFrame:
    """All columns of ``docs`` plus ``score`` (0 to 1) and ``offending``: the sentences at or over ``threshold``.

    ``offending`` lists start, end (code points, end exclusive) and probability in order of place.
    """
    new = StructType.fromDDL(f"`{score_col}` double, `{offending_col}` array<struct<start:int,end:int,p:double>>")
    kept = [c for c in docs.columns if c not in new.names]
    frame = docs.select(*kept)
    schema = StructType(frame.schema.fields + new.fields)
    column = kept.index(text_col)
    shared = frame.sparkSession.sparkContext.broadcast(model)
    spot = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    limit = np.log(threshold / (1 - threshold))

    def scored(batches):
        for batch in batches:
            scores, places = [], []
            for block in W.blocks(batch.column(column)):
                b = bags(block)
                odds = shared.value.sentences(b)
                scores.append(shared.value.documents(b, odds, len(block)))
                here = [[] for _ in range(len(block))]
                points = None
                for s in np.flatnonzero(odds >= limit):
                    if points is None:
                        points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                    zero = points[block.bounds[b.text[s]]]
                    here[b.text[s]].append({"start": int(points[b.starts[s]] - zero), "end": int(points[b.ends[s]] - zero), "p": float(1 / (1 + np.exp(-odds[s])))})
                places += here
            values = np.clip(np.concatenate(scores), 0, 1) if scores else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(values), pa.array(places, spot)], names=[*kept, *new.names])

    return frame.mapInArrow(scored, schema)
