"""Small cases and brute-force versions of the llm operators: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import collections
import importlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gustledger.llm import bpe, decontamination, language, licenses, pii, quality, sharding, similarity, substrings, toxicity
from gustledger.llm import words as W
from gustledger.llm.scratch import Scratch

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def random_texts(count=60, seed=1):
    """Texts over few words, with copies, near copies, shared passages, blanks, nulls and one long text."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Ärger", "naïve", "x", "Y.", "a-b", "漢字", "😀", "word", "Word", "go,", "#", "|"]
    word = lambda: rng.choice(vocabulary) + rng.choice(["", "", str(rng.randint(0, 30))])
    texts = [None, "", "  \n\t ", "one", "one two", "ONE two"]
    passage = " ".join(word() for _ in range(60))
    while len(texts) < count:
        t = rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randint(1, 120)))
        texts.append(t)
        if rng.random() < 0.3:
            texts += [t, t + " tail", "head " + t]
        if rng.random() < 0.3:
            texts.append(t + " " + passage)
    texts.append(" ".join(word() for _ in range(30_000)))
    return texts


def test_words_match_regular_expressions():
    texts = random_texts()
    column = pa.array(texts)
    seen = {}
    for size in (64, 1 << 19):
        for block in W.blocks(column, size):
            found = W.words(block, W.BLANKS, W.LOWER)
            for i in range(len(block)):
                got = [block.data[a:b].tobytes().decode() for a, b in zip(found.starts[found.first[i] : found.first[i + 1]], found.ends[found.first[i] : found.first[i + 1]], strict=True)]
                assert got == BLANK.findall(texts[block.first + i] or "")
                for w, h in zip(got, found.hashes[found.first[i] : found.first[i + 1]].tolist(), strict=True):
                    assert seen.setdefault(w.translate(LOWER), h) == h
    assert len(set(seen.values())) == len(seen)


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "a b c d"), (2, "d e"), (3, None), (4, ""), (None, "a b"), (2, "d e"), (5, "zzz q")], "item_id long, text string")
    rows = [(1, "x A-b c d e"), (1, "x A-b c d e"), (2, None), (3, ""), (None, "d, e"), (4, "b c d " * 3000 + "a b c"), (5, "a b c a b c d")]
    got = {}
    for r in decontamination.contamination(docs(rows), items, 3).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], r["items"]))
    assert got[1] == [(6, 5, ["1", "2"])] * 2
    assert got[2] == got[3] == [(0, 0, [])]
    assert got[None] == [(2, 2, ["2"])]
    assert got[4] == [(9003, 9003, ["1"])]
    assert got[5] == [(7, 7, ["1"])]
    kept = decontamination.clean(docs(rows), items, 3)
    assert kept.columns == docs(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert decontamination.contamination(docs([]), items, 3).count() == 0
    assert decontamination.contamination(docs(rows), items.limit(0), 3).agg(F.sum("n_hit")).first()[0] == 0


def test_proximity(spark, docs):
    items = spark.createDataFrame([(1, "alpha common beta")], "item_id long, text string")
    frame = docs([(1, "beta common x alpha common"), (2, "alpha common" + " common" * 30 + " beta")])
    terms = spark.createDataFrame([("alpha",), ("beta",), ("common",)], "term string")
    groups = decontamination.rare_groups(items, decontamination.document_frequency(frame, terms), 2)
    index = decontamination.postings(frame, ["alpha", "beta"], 5, ["doc_id"])
    assert {r["doc_id"] for r in decontamination.proximity_matches(index, groups).collect()} == {1}


def test_toxicity(spark, docs):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("red green blue sun moon tree road".split()) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        parts = [say(8) for _ in range(rng.randint(1, 6))]
        if toxic:
            parts.insert(rng.randint(0, len(parts)), "you Nasty fool " + say(3))
        rows.append((i, ". ".join(parts)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (7, None), (99_999, 1)]
    rows += [(1000, None), (1001, ""), (1002, "nasty " * 20_000), (1003, "FOOL!"), (None, "sun")]
    model = toxicity.train(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.score(docs(rows), model, score_col="p", offending_col="bad").collect()
    got = {r["doc_id"]: r for r in out}
    assert all((got[i]["p"] >= 0.3) == (i % 4 == 0) for i in range(400))
    assert got[0]["text"][got[0]["bad"][0]["start"] : got[0]["bad"][0]["end"]].strip().startswith("you Nasty fool")
    assert got[1000]["p"] == got[1001]["p"] < 0.3 and got[1002]["p"] > 0.3 and got[1003]["p"] > 0.3 and got[None]["p"] < 0.3
    assert toxicity.score(docs([]), toxicity.train(docs([]), spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def jaccard_classes(rows, n=3, percent=90):
    sets = {}
    for i, t in rows:
        w = BLANK.findall((t or "").translate(LOWER))
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted(((i, len(s), root(i) if i is not None else None) for i in sets for s in sets[i]), key=str)


def test_toxicity_is_fitted_in_little_memory(monkeypatch):
    """The driver holds no hashes and no texts beside the words' numbers while it fits; sums come out as by plain counting."""
    rng = np.random.default_rng(4)
    words = np.array([f"word{i}" for i in range(3000)])
    texts = pa.array([". ".join(" ".join(words[rng.integers(0, 3000, 12)]) for _ in range(20)) for _ in range(1500)])
    labels = (np.arange(1500) % 3 == 0).astype(float)
    blocks = W.blocks
    monkeypatch.setattr(W, "blocks", lambda column: blocks(column, 1 << 17))
    toxicity.fit(texts[:50], labels[:50], rounds=1)
    tracemalloc.start()
    model = toxicity.fit(texts, labels, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.hashes) and peak < 40 * 1500 * 240
    _, word, sentence, text, docs = toxicity._entries(texts)
    assert docs == 1500 and len(text) == 30_000
    values = rng.normal(0, 1, 30_000)
    assert np.array_equal(toxicity._Sums(word, sentence, word[-1] + 1)(values), np.bincount(word, values[sentence]))


def test_similarity(spark, docs):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = list(enumerate(random_texts(40)))
    for k in range(60):  # near copies of one text, few of them within reach of each other
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = f"e{rng.randrange(40)}"
        rows.append((200 + k, " ".join(words)))
    rows += [(5, "one two three four"), (300, "one two three four"), (None, "one two three four")]
    with Scratch(spark) as scratch:
        got = scratch.result(similarity.similar_documents(docs(rows), scratch)).collect()
        kept = similarity.keep_one(docs(rows), scratch)
        empty = similarity.similar_documents(docs([]), scratch).count()
    want = jaccard_classes(rows)
    assert sorted(((r["id"], r["n_shingles"], r["component"]) for r in got), key=str) == want
    assert kept.columns == docs(rows).columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(i for i, _, c in want if i is None or c == i)
    assert empty == 0


def removed(rows, n):
    least = {}
    texts = [(i, BLANK.findall(t or "")) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - n + 1):
            if i is not None:
                g = tuple(w[k : k + n])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in texts:
        gone = {p for k in range(len(w) - n + 1) if i is not None and least[tuple(w[k : k + n])] < i for p in range(k, k + n)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [5, 50])
def test_substrings(spark, docs, n):
    texts = random_texts(50, seed=n)
    rows = list(enumerate(texts)) + [(9, texts[10]), (9, texts[10]), (None, texts[12])]
    with Scratch(spark) as scratch:
        got = scratch.result(substrings.remove_repeated(docs(rows), scratch, n))
        assert substrings.remove_repeated(docs([]), scratch, n).count() == 0
    assert got.columns == [*docs(rows).columns, "n_words", "n_removed", "kept"]
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()), key=str) == removed(rows, n)


def test_language_model(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice([["der", "die", "und", "haus"], ["the", "and", "of", "house"]][i % 2]) for _ in range(rng.randint(1, 60)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "the of " * 8000), (1003, "neverseen the"), (1003, "neverseen the"), (None, "the")]
    with Scratch(spark) as scratch:
        got = scratch.result(language.score(docs(rows), F.col("doc_id") < 150, scratch)).collect()
        assert language.score(docs([]), F.col("doc_id") < 150, scratch).count() == 0
    counts = collections.Counter(w for i, t in rows if i is not None and i < 150 for w in [*BLANK.findall(t.translate(LOWER)), "</s>"])
    n, v = sum(counts.values()), len(counts)
    base = {}
    for i, t in rows:
        w = [*BLANK.findall((t or "").translate(LOWER)), "</s>"]
        base[i] = (len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    assert len(got) == len(rows)
    for r in got:
        size, known, score = base[r["id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (size, known, n)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
    held = [r for r in got if r["id"] is not None and 150 <= r["id"] < 200]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.2 * sum(r["n_tokens"] for r in held)


def test_language_model_learns_from_every_training_token(docs):
    """More documents than the sample, and one text that alone is larger than it; what only later documents hold must be learned."""
    n = language.SAMPLE_DOCS + 400
    rows = [(i, "left right " * (1 + i % 5)) for i in range(n)] + [(n, "alpha beta gamma " * 150_000)]
    texts = docs(rows).select(F.col("doc_id").alias("id"), "text").repartition(3)
    with Scratch(texts.sparkSession) as scratch:
        counts = scratch.store(language.count_words(texts))
        total = counts.agg(F.sum("c")).first()[0]
        model = language.train(texts, counts, 1)
    assert model.fitted == total == sum(len(t.split()) + 1 for _, t in rows)
    start = language._flat(model.p).copy()
    assert language._averaged(texts.limit(0), model, 2)[1] == 0
    again, tokens = language._averaged(texts, model, 2)
    assert tokens == total and not np.array_equal(language._flat(again), start)


def test_language_model_learns_from_token_numbers(spark, monkeypatch):
    """Training and scoring read stored token numbers: texts are coded once, and the weights are those of the texts."""
    rng = random.Random(8)
    rows = [(i, None if i == 3 else " ".join(f"w{min(rng.randint(0, 90), rng.randint(0, 90))}" for _ in range(rng.randint(0, 40)))) for i in range(300)]
    texts = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    monkeypatch.setattr(language, "HEAD", 64)
    monkeypatch.setattr(language, "LEAST_UPDATES", 2)
    with Scratch(spark) as scratch:
        model = language._started(texts, scratch.store(language.count_words(texts)), 1)
        coded = scratch.store(language._coded_texts(texts.select(F.col("id").alias("row"), "id", "text", language._round().alias("round")), model).coalesce(1))
        table = coded.orderBy("row").toArrow()
        ids, first = language._numbers(table["ids"].combine_chunks())
        want, starts = language._coded(model, pa.array([t for _, t in rows]))
        assert np.array_equal(ids, want) and np.array_equal(first, starts) and table["n_tokens"].to_pylist() == np.diff(starts).tolist()
        part, part_first = language._numbers(table["ids"].combine_chunks().slice(7, 5))
        assert np.array_equal(part, want[starts[7] : starts[12]]) and part_first[0] == 0
        one, n = language._averaged(coded.select("ids"), model, 1)
        two, m = language._averaged(texts, model, 1)
        assert n == m == len(want) and np.allclose(language._flat(one), language._flat(two), atol=1e-5)


def test_language_model_state_crosses_windows_and_sums_to_one():
    rng = np.random.default_rng(0)
    groups, h = 2, language.HIDDEN
    head = groups * language.GROUP
    f = lambda *s: rng.normal(0, 0.5, s).astype(np.float32)
    p = {"x": f(head + language.FORMS + 1, 3 * h), "u": f(h, 3 * h), "c": f(h, groups + language.FORMS + 1), "cb": f(groups + language.FORMS + 1), "w": f(groups, h, language.GROUP), "wb": f(groups, language.GROUP)}
    m = language.Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(64), np.zeros(64), head, groups, p)
    every = np.arange(head + language.FORMS + 1)
    assert np.exp(language._log_probabilities(m, np.repeat(f(1, h), len(every), 0), every)).sum() == pytest.approx(1, abs=1e-4)
    sizes = rng.integers(1, 90, 40)
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(0, head + language.FORMS, first[-1])
    got = language.score_texts(m, ids, first)
    for i in range(40):
        state, last, total = np.zeros((1, h), np.float32), m.start, 0.0
        for t in ids[first[i] : first[i + 1]]:
            state = language._step(p, p["x"][[last]], state)[0]
            total += float(language._log_probabilities(m, state, np.array([t]))[0])
            last = t
        assert got[i] == pytest.approx(total, rel=1e-3)


def test_language_model_steps_reuse_their_memory():
    """A window's arrays are those of the window before; nothing of what they held is left in its result."""
    rng = np.random.default_rng(1)
    groups, h = 4, language.HIDDEN
    head = groups * language.GROUP
    f = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    p = {"x": f(head + language.FORMS + 1, 3 * h), "u": f(h, 3 * h), "c": f(h, groups + language.FORMS + 1), "cb": f(groups + language.FORMS + 1), "w": f(groups, h, language.GROUP), "wb": f(groups, language.GROUP)}

    def windows():
        x = np.minimum(rng.integers(0, head + language.FORMS, (2, language.STEPS, language.LANES)), rng.integers(0, 400, (2, language.STEPS, language.LANES))).astype(np.int32)
        return x[0], x[1], rng.random(x[0].shape) < 0.9, rng.random(x[0].shape) < 0.05

    def stepped(before):
        m = language.Model(*[np.zeros(0)] * 5, head, groups, {k: w.copy() for k, w in p.items()})
        trainer = language._Trainer(m)
        for x, y, live, begin in before:
            trainer.window(x, y, live, begin, np.zeros((x.shape[1], h), np.float32), 0.0)
        trainer.step = 0
        for k in p:
            trainer.m[k][:] = trainer.v[k][:] = 0
        return trainer

    first, wide = windows(), windows()
    one = tuple(a[:, :100] for a in first)
    fresh, used = stepped([]), stepped([wide, wide])
    state = np.zeros((100, h), np.float32)
    tracemalloc.start()
    out = used.window(*one, state, 0.01)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(out, fresh.window(*one, state, 0.01))
    assert all(np.array_equal(used.p[k], fresh.p[k]) for k in p)
    assert peak < one[0].size * 3 * h * 4 * 3  # a third of what its arrays take together


def test_language_model_sums_of_tokens():
    rng = np.random.default_rng(5)
    x = np.concatenate([np.full(300, 7), np.full(language.RARE, 9), np.full(language.RARE + 1, 11), rng.integers(20, 400, 700)]).astype(np.int32)
    rng.shuffle(x)
    rows = rng.normal(size=(len(x), 6)).astype(np.float32)
    tokens, sums = language._sums(x.reshape(2, -1) if len(x) % 2 == 0 else x[None], rows)
    assert tokens.tolist() == sorted(set(x.tolist()))
    assert all(np.allclose(s, rows[x == t].astype(float).sum(0), atol=1e-4) for t, s in zip(tokens, sums, strict=True))


def slow_spans(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            good = [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_patterns():
    rng = random.Random(1)
    bits = ["1", "23", "255", "256", ".", " ", "-", "+", "@", "a", "b.c", "(", ")", "%", "é", "4111111111111111", "\n"]
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        assert pii.pattern_spans(t) == slow_spans(t)
    assert pii.pattern_spans("9" * 200_000) == [] and pii.pattern_spans("a" * 200_000 + "@") == []


def test_language_model_looks_words_up_like_a_search():
    rng = np.random.default_rng(2)
    crowd = np.uint64(77 << 44) + np.arange(40, dtype=np.uint64)  # one list far longer than the others
    held = np.unique(np.concatenate([rng.integers(0, 1 << 63, 5_000, dtype=np.uint64) * np.uint64(2), crowd, np.array([0, 2**64 - 1], np.uint64)]))
    for known in (held, held[:-1], held[:1]):
        m = language.Model(known, known, known, np.zeros(64), np.zeros(64), 0, 0, {})
        asked = np.concatenate([held, held + np.uint64(1), held - np.uint64(1), rng.integers(0, 1 << 63, 5_000, dtype=np.uint64)])
        assert (m.places(asked) == np.minimum(np.searchsorted(known, asked), len(known) - 1)).all()


def test_language_model_class_scores_never_stand_whole():
    rng = np.random.default_rng(0)
    groups, h, rows = 64, language.HIDDEN, 20_000
    head = groups * language.GROUP
    f = lambda *s: rng.normal(0, 0.5, s).astype(np.float32)
    p = {"c": f(h, groups + language.FORMS + 1), "cb": f(groups + language.FORMS + 1), "w": f(groups, h, language.GROUP), "wb": f(groups, language.GROUP)}
    states, target = np.tanh(f(rows, h)), rng.integers(0, head + language.FORMS + 1, rows)
    whole = rows * len(p["cb"]) * 4
    for shift in (0, 300):  # 300: scores that cannot be raised as they are
        m = language.Model(*[np.zeros(0)] * 5, head, groups, {**p, "cb": p["cb"] + np.float32(shift)})
        tracemalloc.start()
        got = language._log_probabilities(m, states, target)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 1.5 * whole
        logits = (states @ p["c"] + p["cb"]).astype(float)
        cls = language._classes(m, target)
        want = logits[np.arange(rows), cls] - np.log(np.exp(logits).sum(1))
        for i in np.flatnonzero(target < head):
            inside = states[i].astype(float) @ p["w"][cls[i]] + p["wb"][cls[i]]
            want[i] += inside[target[i] % language.GROUP] - np.log(np.exp(inside).sum())
        assert np.abs(got - want).max() < 1e-3


@pytest.fixture(scope="module")
def tagged():
    rng = np.random.default_rng(8)
    lines = ["they went home at night and wrote to", "please see the long note about", "nothing was said of the matter until"]
    texts = [f"{lines[i % 3]} {pii.generated(rng, i % 4)} and then some more words" for i in range(300)]
    return texts, pii.fit(*pii.examples(texts, made=1500))


def test_pii_tagger(docs, tagged):
    texts, tagger = tagged
    x, y = pii.examples([], seed=77, made=200)
    tags = pii.marginals(tagger, x.T).transpose(1, 0, 2).argmax(2)
    assert (tags == y)[x > 0].mean() > 0.9  # held-out accuracy
    rows = [(1, None), (2, ""), (3, "mail jo.x@site.example.com or +1 (822) 555-1549 é"), (4, "no digits"), (5, "7" * 5000), (None, "ab 10.0.0.1 cd"), (6, texts[0]), (6, texts[0])]
    got = {r["doc_id"]: r for r in pii.find(docs(rows), tagger).collect()}
    assert got[1]["spans"] == got[2]["spans"] == got[4]["spans"] == []
    assert all({tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]} for r in got.values())
    out = pii.mask(docs(rows), tagger)
    assert out.columns == docs(rows).columns
    masked = {r["doc_id"]: r["text"] for r in out.collect()}
    assert masked[1] is None and masked[3].startswith("mail <EMAIL> or <PHONE>") and masked[None].startswith("ab <IP>")
    assert pii.find(docs([]), tagger).count() == 0


def test_pii_windows_join(tagged):
    rng = np.random.default_rng(4)
    tagger = tagged[1]
    body = " ".join(pii.decoy(rng) + " and " + pii.generated(rng, 1) for _ in range(80))
    (spans,) = pii.tag(tagger, [body])
    assert spans == sorted(spans) and all(a[2] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_pii_windows_fill_their_batches(monkeypatch):
    """Windows of many texts go through the network together; probabilities are averaged as before where spans are decided."""
    calls = []

    def stub(_, x):
        calls.append(x.shape[1])
        out = np.full((*x.shape, pii.TAGS), 1e-9, np.float32)
        on = x == ord("q") - 31
        out[..., 0], out[..., 1] = np.where(on, 0.05, 0.995), np.where(on, 0.95, 0.005)
        return out

    monkeypatch.setattr(pii, "probabilities", stub)
    texts = ["", "q", "ab q"] + ["x" * (3_000 + i) + "q" + "x" * 299 for i in range(550)]
    got = pii.tag(None, texts)
    assert got == [[(len(t) - 1, 0, len(t))] if 0 < len(t) < 9 else [(i, 0, i + 1) for i in [t.find("q")] if i >= 0] for t in texts]
    assert len(calls) <= -(-sum(calls) // pii.BATCH)


def test_pii_probabilities_are_the_marginals():
    rng = np.random.default_rng(3)
    f = lambda *shape: rng.normal(0, 0.5, shape)
    p = {"o": f(40, pii.TAGS), "ob": f(pii.TAGS), "t": f(pii.TAGS + 1, pii.TAGS), **{k + d: f(100 if k == "e" else 20, 80) for k in "eu" for d in "fb"}}
    x, _ = pii.examples([], seed=78, made=50)
    assert np.abs(pii.probabilities(pii.Tagger(p), x.T) - pii.marginals(pii.Tagger(p), x.T))[x.T > 0].max() < 1e-3


def test_pii_tagger_compares_arrays_with_arrays(monkeypatch, tagged):
    """numpy takes the larger of an array and a number, element by element, several times as slowly as that of two arrays."""
    for name in ("maximum", "minimum"):
        own = getattr(np, name)

        def compared(a, b, *more, own=own, **named):
            assert np.ndim(b) or np.size(a) < 1000
            return own(a, b, *more, **named)

        monkeypatch.setattr(np, name, compared)
    x = np.random.default_rng(0).integers(1, 90, (40, 64))
    assert pii.probabilities(tagged[1], x).shape == (40, 64, pii.TAGS)


def test_pii_best_path():
    """The best path is that of a plain search over all steps that are allowed."""
    rng = np.random.default_rng(9)
    parts = [rng.dirichlet(np.full(pii.TAGS, 0.3), n).astype(np.float32) for n in (1, 2, 3, 17, 40)] + [np.full((5, pii.TAGS), 1 / pii.TAGS, np.float32)]
    allowed = np.where(pii._ALLOWED, 0.0, pii._FORBIDDEN)
    for p, got in zip(parts, pii._viterbi(parts), strict=True):
        scores = np.zeros((len(p), pii.TAGS))
        scores[:] = np.log(p + 1e-12)
        best, back = scores[0] + allowed[-1], []
        for s in scores[1:]:
            options = best[:, None] + allowed[:-1]
            back.append(options.argmax(0))
            best = options.max(0) + s
        path = [int(best.argmax())]
        for origin in reversed(back):
            path.append(int(origin[path[-1]]))
        assert got.tolist() == path[::-1]


def test_pii_whole_texts_are_tagged(monkeypatch):
    """Whatever the network finds is a span: without digit or @, far from one, and longer than a window."""

    def stub(_, x):
        out = np.full((*x.shape, pii.TAGS), 1e-9)
        on = x == ord("q") - 31
        begin = on & ~np.concatenate([np.zeros((1, x.shape[1]), bool), on[:-1]])
        out[..., 0], out[..., 1], out[..., 2] = ~on, begin & on, on & ~begin
        return out + 1e-9

    monkeypatch.setattr(pii, "probabilities", stub)
    texts = ["", "no", "ab qqqqq cd", "7 " + "a" * 90 + " " + "q" * 400 + " b", "q" * 30, "a" * 200_000 + " qq"]
    assert pii.tag(None, texts) == [[(m.start(), 0, m.end()) for m in re.finditer("q+", t)] for t in texts]
    assert (pii.letters(np.array([ord(c) for c in "٥5５é"])) == [22, 22, 22, 97]).all()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(importlib.import_module("public_tokenizers").path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(vocabulary, monkeypatch):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(importlib.import_module("public_tokenizers").path("byte_bpe_50k.json"))
    rng = random.Random(5)
    bits = ["a", "th", " ", "  ", "\n", "'s", "'", "r", "re", "1", "٣", "é", "漢", "😀", "<|endoftext|>", "<|", "|>", "\t", "\x1c", "\x85", "　", "-", "ing", "\r\n"]
    encoder, decoder = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    texts = ["".join(rng.choice(bits) * rng.choice([1, 1, 1, 50]) for _ in range(rng.randint(0, 20))) for _ in range(400)]
    for part in (1 << 16, 40):
        monkeypatch.setattr(bpe, "PART", part)
        for t in [*texts, "ab" * 5000, " " * 3000 + "x"]:
            ids = encoder.encode(t)
            want = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert decoder.decode(ids) == library.decode(want, skip_special_tokens=False) == t
    for t in texts[:100]:
        assert b"".join([*(encoder.feed(c) for c in t), encoder.finish()]) == encoder.encode(t)


def test_bpe_lookahead(vocabulary):
    """Tokens that end before the lookahead do not depend on what follows."""
    rng = random.Random(6)
    for _ in range(300):
        data = "".join(rng.choice(["the", "ing", "aa", "tion", "x", "é"]) for _ in range(80)).encode()
        cut = rng.randint(vocabulary.lookahead, len(data))
        whole, part = (bpe.merge(vocabulary, d) for d in (data, data[:cut]))
        at = 0
        for a, b in zip(whole, part, strict=False):
            at += len(vocabulary.bytes_of[b])
            if at > cut - vocabulary.lookahead:
                break
            assert a == b


def test_bpe_frames(docs, vocabulary):
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "é" * 70_000)]
    got = bpe.decode(bpe.encode(docs(rows), vocabulary), vocabulary).collect()
    assert [r["decoded"] for r in got] == ["", "", "Hello  world", "Hello  world", "é" * 70_000]
    assert bpe.round_trip(docs([]), vocabulary).count() == 0


def test_quality(spark, docs):
    texts = [t for t in random_texts(40)] + ["a b c a b c x", "l one\n\nl one\n  \nl one", "###$ <|> | &&"]
    rows = list(enumerate(texts)) + [(None, "a"), (3, "repeat"), (3, "repeat")]
    weights = quality.ratios(docs(rows), spark.createDataFrame([(i,) for i in range(0, 40, 2)] + [(None,)], "doc_id long"))
    out = quality.rate(docs(rows), weights)
    for r in out.collect():
        t = r["text"] or ""
        w = BLANK.findall(t)
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
        lines = [x for x in t.split("\n") if BLANK.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
    good = docs([(i, "calm clear words in plain order " * 5) for i in range(20)] + [(100 + i, "### buy $$$ now *** " * 5) for i in range(20)])
    rated = quality.rate(good, quality.ratios(good, spark.createDataFrame([(i,) for i in range(10)], "doc_id long")))
    assert {r["doc_id"] for r in rated.where(F.col("llr") >= quality.THRESHOLD).collect()} == set(range(20))
    assert quality.rate(docs([]), quality.ratios(docs([]), spark.createDataFrame([], "doc_id long"))).count() == 0


def test_licenses(docs):
    rows = [(1, None), (2, ""), (3, "Ärger: Released under the MIT License. ok"), (4, "x " * 30_000 + "licensed under the apache license version 2.0"), (5, "Permission is hereby granted, free of cost, to any person"), (None, "Licensed under CC BY-NC 4.0"), (6, licenses.TEMPLATES["MIT text"].replace("copyright", "short"))]
    got = {r["doc_id"]: r for r in licenses.scan(docs(rows)).collect()}
    names = {i: [m["license"] for m in r["licenses"]] for i, r in got.items()}
    assert names == {1: [], 2: [], 3: ["MIT"], 4: ["Apache-2.0"], 5: [], None: ["CC-BY-NC-4.0"], 6: ["MIT text"]}
    m = got[3]["licenses"][0]
    assert got[3]["text"][m["start"] : m["end"]] == "Released under the MIT License"
    assert 0.95 < got[6]["licenses"][0]["coverage"] < 1
    assert licenses.scan(docs([])).count() == 0


@pytest.mark.parametrize("name", ["MIT", "CC-BY-NC-4.0", "Apache-2.0"])
@pytest.mark.parametrize("front", ["", "foo.py: ", "x: ", "see the file a b c "])
def test_repeated_short_notices(docs, name, front):
    notice = licenses.TEMPLATES[name]
    rows = [(k, "head\n" + f"{front}{notice}.\n" * k + "tail") for k in range(12)]
    for r in licenses.scan(docs(rows)).collect():
        want = [m.span() for m in re.finditer(re.escape(notice), r["text"])]
        assert [(m["start"], m["end"]) for m in r["licenses"]] == want
        assert {m["license"] for m in r["licenses"]} <= {name}


def test_changed_header_is_not_its_first_words(docs):
    header = licenses.TEMPLATES["Apache-2.0 header"]
    words = header.split()
    changed = [header.replace("http:", "https:"), *(" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in range(20, len(words) - 1, 7))]
    for r in licenses.scan(docs([(k, "a " + t + " z") for k, t in enumerate(changed)])).collect():
        assert [(m["license"], m["start"]) for m in r["licenses"]] == [("Apache-2.0 header", 2)]
        assert r["licenses"][0]["end"] == len(r["text"]) - 3 and r["licenses"][0]["coverage"] < 1


def test_sharding(spark, docs):
    rows = [(i, "x" * (i % 97)) for i in range(500)] + [(7000, "y" * 5000), (None, None), (1, "")] + [(8000, "same" * 50)] * 40
    with Scratch(spark) as scratch:
        placed = scratch.result(sharding.shards(docs(rows), scratch, 1000)).collect()
        assert sharding.shards(docs([]), scratch, 1000).count() == 0
    assert len(placed) == len(rows)
    load = collections.Counter()
    for r in placed:
        load[r["shard"]] += r["bytes"]
    members = collections.Counter(r["shard"] for r in placed)
    assert all(load[s] <= 1000 or members[s] == 1 for s in load)
    assert all(not b.startswith(a) for a in load for b in load if a != b)
    assert all(r["shard_bytes"] == load[r["shard"]] for r in placed)
    # Only oversized buckets split: every shard's parent was over the limit.
    assert all(sum(n for t, n in load.items() if t.startswith(s[:-1])) > 1000 for s in load if s)
