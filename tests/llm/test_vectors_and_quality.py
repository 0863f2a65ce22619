"""Clustering, whitening and the additive classifier against plain versions, with every edge of their inputs."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gustledger.llm import additive, clustering, queries, vectors, whitening
from gustledger.llm import words as W
from gustledger.llm.scratch import Scratch

ROWS = "vec_id long, embedding array<double>, cluster string, distance string, low int, component string"


@pytest.fixture
def embeddings(spark):
    """Embeddings frame from (id, vector) pairs, with columns whose names operators also use."""

    def make(rows, kind="double"):
        return spark.createDataFrame([(i, v, "c", "d", 1, "x") for i, v in rows], ROWS.replace("array<double>", f"array<{kind}>"))

    return make


def plain_clusters(rows, k, rounds, length, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        best = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (_, n) in zip(kept, best, strict=True) if n == c]
            if own:
                centres[c] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, assign(), strict=True)), key=str), centres


def awkward_vectors(length, count=400, seed=3):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 3) for _ in range(length)] for _ in range(5)]
    rows = [(n, [x + rng.gauss(0, rng.choice([0.01, 1])) for x in rng.choice(middle)]) for n in range(count)]
    rows += [(1000 + n, list(middle[0])) for n in range(count // 2)]  # a third of all rows are one vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, middle[1]), (2001, None), (2002, []), (2003, middle[1][:-1]), (2004, middle[1] + [0.0])]
    bad = lambda x: middle[2][:-1] + [x]
    return rows + [(2005, bad(None)), (2006, bad(math.nan)), (2007, bad(math.inf)), (2008, bad(-math.inf))]


@pytest.mark.parametrize("k", [1, 6])
def test_clusters_match_plain_loop(spark, embeddings, k):
    rows = awkward_vectors(5)
    want, centres = plain_clusters(rows, k, 3, 5, 8)
    with Scratch(spark) as scratch:
        assigned, got_centres = clustering.cluster(embeddings(rows), scratch, k, 3, 5, 8, block=16)
        got = sorted(((r["id"], r["cluster"], r["distance"]) for r in assigned.collect()), key=str)
        assert clustering.inertia(assigned) == {c: sum(d for _, n, d in want if n == c) for c in {n for _, n, _ in want}}
    assert got == want
    assert got_centres.tolist() == centres


def test_clusters_of_few_or_no_vectors(spark, embeddings):
    with Scratch(spark) as scratch:
        assigned, centres = clustering.cluster(embeddings([(1, [0.5, 1.0]), (2, [0.5, 1.0])]), scratch, 4, 2, 2, 2)
        assert sorted(map(tuple, assigned.collect())) == [(1, 0, 0), (2, 0, 0)] and centres.tolist() == [[1, 2], [1, 2]]
        for rows in ([], [(1, None), (2, [1.0])]):
            assigned, centres = clustering.cluster(embeddings(rows), scratch, 4, 2, 2, 2)
            assert assigned.collect() == [] and len(centres) == 0
        with pytest.raises(Exception, match="has an entry of"):
            clustering.cluster(embeddings([(1, [2.0**20, 0.0])]), scratch, 4, 2, 2, 2)


def test_large_components_are_exact(spark, embeddings):
    rows = [(n, [float((-1) ** n * (1_000_000 - n)), float(n)]) for n in range(50)]
    want, _ = plain_clusters(rows, 3, 2, 2, 64)
    with Scratch(spark) as scratch:
        assigned, _ = clustering.cluster(embeddings(rows), scratch, 3, 2, 2, 64, block=4)
        assert sorted((tuple(r) for r in assigned.collect()), key=str) == want


def test_zones_keep_every_row_and_prune(spark, embeddings):
    rng = random.Random(5)
    middles = [(a, b, c) for a in (-40, 40) for b in (-40, 40) for c in (-40, 40)]
    rows = [(n, [m + rng.gauss(0, 1) for m in middles[n % 8]]) for n in range(800)]
    with Scratch(spark) as scratch:
        zoned = clustering.zones(embeddings(rows), scratch, 3, 16, block=16)
        blocks = zoned.blocks.collect()
        assert sorted(i for b in blocks for i in b["ids"]) == list(range(800)) and zoned.count == 800
        low, high = (np.array([np.frombuffer(b[side], "<i4") for b in blocks]) for side in ("low", "high"))
        may_win = clustering.candidates(low.astype(np.int64), high.astype(np.int64), np.array(middles) * 16)
        assert may_win.sum(1).mean() < 2


def test_candidates_hold_the_nearest_of_every_point():
    rng = np.random.default_rng(2)
    for _ in range(200):
        centres = rng.integers(-6, 7, (9, 3))
        low = rng.integers(-8, 8, (1, 3))
        high = low + rng.integers(0, 5, (1, 3))
        points = np.stack(np.meshgrid(*[np.arange(a, b + 1) for a, b in zip(low[0], high[0], strict=True)], indexing="ij"), -1).reshape(-1, 3)
        best, distance = clustering.nearest(points, centres)
        every = ((points[:, None] - centres[None]) ** 2).sum(2)
        assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
        assert clustering.candidates(low, high, centres)[0, best].all()


@pytest.mark.parametrize(("axes", "bits"), [(1, 3), (2, 4), (3, 3), (5, 2)])
def test_hilbert_curve_is_unbroken(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    key = clustering.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def plain_whitening(x):
    count, mean = len(x), x.mean(0)
    values, found = np.linalg.eigh((x - mean).T @ (x - mean) / count)
    return values[::-1], found[:, ::-1], (x - mean)


@pytest.mark.parametrize(("length", "wanted"), [(5, 8), (40, 4), (60, 8)])
def test_whitening_matches_dense_eigenvectors(spark, embeddings, length, wanted):
    rng = np.random.default_rng(length)
    base = rng.standard_normal((300, length)) * np.linspace(1, 3, length) + 5
    rows = [(int(n), [float(x) for x in v]) for n, v in enumerate(base)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (900, None), (901, []), (902, [1.0]), (903, [math.nan] * length), (904, [None] * length), (905, [-math.inf] * length)]
    kept = np.array([v for _, v in rows[:302]])
    x = np.floor(1024 * kept) + 100_000
    values, found, apart = plain_whitening(x)
    frame = embeddings(rows)
    with Scratch(spark) as scratch:
        model = whitening.fit(frame, scratch, wanted)
        done = whitening.transform(frame, model)
        got = sorted(done.collect(), key=lambda r: (r["id"] is None, r["id"], r["deviation"]))
        assert whitening.identity_error(done, model) < 1e-10
    k = min(wanted, length)
    assert model.count == 302 and model.residual <= whitening.TOLERANCE
    np.testing.assert_allclose(model.variances, values[:k], rtol=1e-11)
    np.testing.assert_allclose(model.trace, values.sum(), rtol=1e-12)
    want = apart @ found[:, :k] / np.sqrt(values[:k])
    order = sorted(range(302), key=lambda n: (rows[n][0] is None, rows[n][0]))
    mine = np.array([r["whitened"] for r in got])
    sign = np.sign((mine * want[order]).sum(0))
    np.testing.assert_allclose(mine * sign, want[order], atol=1e-8)
    whole = x.astype(int).astype(object)
    exact = ((302 * whole - whole.sum(0)) ** 2).sum(1)
    assert [int(r["deviation"]) for r in got] == [exact[n] for n in order]


def test_whitening_without_variance(spark, embeddings):
    with Scratch(spark) as scratch:
        assert whitening.fit(embeddings([]), scratch) is None
        assert whitening.fit(embeddings([(1, None), (2, [])]), scratch) is None
        for rows in ([(1, [1.0, 2.0, 3.0])], [(1, [1.0, 2.0, 3.0])] * 4):
            frame = embeddings(rows)
            model = whitening.fit(frame, scratch)
            got = whitening.transform(frame, model).collect()
            assert [list(r["whitened"]) for r in got] == [[None] * 3] * len(rows) and all(r["deviation"] == 0 for r in got)
            assert whitening.identity_error(whitening.transform(frame, model), model) == 0
        # All on one line: one component has variance.
        frame = embeddings([(n, [float(n), 2.0 * n, 0.0]) for n in range(40)])
        model = whitening.fit(frame, scratch)
        assert (model.variances > 0).tolist() == [True, False, False]
        assert whitening.identity_error(whitening.transform(frame, model), model) < 1e-12


def test_filter_finds_close_eigenvalues():
    rng = np.random.default_rng(0)
    basis = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    for values in (np.linspace(100, 99, 64), np.r_[1e6, np.full(3, 5.0), np.linspace(4.999, 1, 60)], np.r_[3.0, 2.0, np.zeros(62)], np.zeros(64)):
        matrix = basis * values @ basis.T
        got, found, _ = whitening.leading(lambda q, m=matrix: m @ q, 64, 8)
        np.testing.assert_allclose(got, values[:8], rtol=1e-11, atol=1e-12 * values[0])
        np.testing.assert_allclose(found.T @ found, np.eye(8), atol=1e-12)
        assert np.linalg.norm(matrix @ found - found * got, axis=0).max() <= whitening.TOLERANCE * max(values[0], 1e-300) * 1.5


def test_deviations_of_any_size():
    rng = np.random.default_rng(1)
    for count, low, high, width in ((10, 0, 2000, 3), (10**9, 0, 300, 70), (10**12, 0, 2**31 - 1, 3)):
        x = rng.integers(low, high, (20, width))
        sums = [int(v) * count // 2 for v in x.sum(0)]
        want = [sum((count * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
        if max(want) < 10**38:
            assert [int(v) for v in whitening.deviations(x, count, sums).to_pylist()] == want


def test_packed_vectors_keep_their_rows(spark, embeddings):
    rows = [(n, [n + 0.25, -n - 0.25]) for n in range(25)]
    got = vectors.packed(embeddings(rows, "float"), "vec_id", "embedding", 2, 4).collect()
    assert {r["id"]: np.frombuffer(r["vector"], "<i4").tolist() for r in got} == {n: [4 * n + 1, -4 * n - 1] for n in range(25)}


TEXTS = [None, "", " \n\t", "one", "ONE ONE one", "a b c a b c a b c\na b c a b c a b c\n", "Ärger, naïve. 漢字!? <|> $5 x", "word " * 3000, "z" * 5000, "Line one.\nLine two.\nLine one.\n" * 40]


def test_features_by_hand():
    got = dict(zip(additive.FEATURES, additive.features(pa.array(["Ab ab ab 12!\nAb ab ab 12!\n"]))[0], strict=True))
    assert got["log_words"] == pytest.approx(math.log(9)) and got["again"] == pytest.approx(2 / 8)
    assert got["distinct_words"] == pytest.approx(3 / 8) and got["distinct_triples"] == pytest.approx(4 / 6)
    assert got["repeated_lines"] == 0.5 and got["capital_words"] == 0.25 and got["bare_words"] == 0.25
    assert got["upper"] == pytest.approx(2 / 12) and got["digits"] == pytest.approx(4 / 26) and got["excited"] == pytest.approx(2 / 26)
    assert not additive.features(pa.array([None, "", ""])).any() and additive.features(pa.array([], pa.string())).shape == (0, len(additive.FEATURES))


def test_features_do_not_depend_on_neighbours_or_blocks():
    together = additive.features(pa.array(TEXTS))
    for row, text in zip(together, TEXTS, strict=True):
        np.testing.assert_array_equal(additive.features(pa.array([text], pa.string()))[0], row)


def test_long_text_in_parts():
    """Cut at line ends, a long text has the features it has in one piece; one word without blanks is cut inside characters' borders."""
    lines = ["".join(random.Random(n % 300).choices("abcdefg ÄöX.,", k=80)) for n in range(9000)]
    text = "\n".join(lines) + "\n"
    whole, cut = (additive.features(pa.array([text]), most) for most in (1 << 30, 1 << 16))
    assert len(text.encode()) > W.BLOCK_BYTES
    same = [i for i, name in enumerate(additive.FEATURES) if name not in ("again", "distinct_triples")]
    np.testing.assert_array_equal(cut[0, same], whole[0, same])
    np.testing.assert_allclose(cut, whole, rtol=0.01, atol=1e-3)
    block = next(W.blocks(pa.array(["漢" * 300_000])))
    pieces = list(additive.parts(block, 1000))
    assert b"".join(p.data.tobytes() for p in pieces) == block.data.tobytes()
    assert all(p.data.tobytes().decode() for p in pieces)


def test_tables_learn_single_and_joint_effects():
    rng = np.random.default_rng(4)
    x = rng.random((6000, 4))
    odds = np.where(x[:, 0] > 0.7, 3.0, -1.0) + np.where((x[:, 1] > 0.5) == (x[:, 2] > 0.5), 2.5, -2.5)
    y = rng.random(6000) < 1 / (1 + np.exp(-odds))
    model = additive.fit(x[:5000], y[:5000])
    assert (1, 2) in model.pairs
    got = model.log_odds(x[5000:])
    assert np.corrcoef(got, odds[5000:])[0, 1] > 0.95
    without = additive.fit(x[:5000], y[:5000], pairs=0).log_odds(x[5000:])
    assert np.corrcoef(without, odds[5000:])[0, 1] < 0.8


def test_trees_match_every_cut():
    rng = np.random.default_rng(6)
    g, h = rng.normal(size=(5, 4)), rng.random((5, 4)) + 3
    gain, values = additive.pair_tree(g, h)

    def of(i, j):
        leaves = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 4)), (slice(i, 5), slice(0, j)), (slice(i, 5), slice(j, 4))]
        return sum(g[c].sum() ** 2 / (h[c].sum() + additive.RIDGE) for c in leaves)

    assert gain == pytest.approx(max(of(i, j) for i in range(1, 5) for j in range(1, 4)))
    assert len(np.unique(values)) <= 4
    steps = additive.feature_tree(np.array([5.0, 5, -9, -9, 4, 4]), np.full(6, 3.0))
    assert steps.tolist() == pytest.approx([10 / 7, 10 / 7, -18 / 7, -18 / 7, 8 / 7, 8 / 7])


def test_lookups_equal_a_plain_sum(spark, docs):
    texts = [f"{'junk ' * (n % 7)}w{n} some words here{'!' * (n % 3)}" for n in range(300)]
    x = additive.features(pa.array(texts))
    model = additive.fit(x, np.array([n % 7 < 3 for n in range(300)]))
    frame = docs([(n, t) for n, t in enumerate(texts)] + [(0, texts[0]), (None, None), (-1, "")])
    got = additive.score(frame, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "score"]
    for r in got.collect():
        row = additive.features(pa.array([r["text"]], pa.string()))[0]
        odds = model.constant + sum(t[sum(e <= v for e in edges)] for v, edges, t in zip(row, model.edges, model.tables, strict=True))
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            odds += t[sum(e <= row[a] for e in model.coarse[a]), sum(e <= row[b] for e in model.coarse[b])]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-odds)))


def test_quality_training_edges(spark, docs):
    frame = docs([(n, t) for n, t in enumerate(TEXTS)] + [(3, "another text of document three"), (None, "no id")])
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, text string, score string")
    for rows, share in (([], 0.5), ([(1, 1, "", ""), (2, 1, "", ""), (None, 0, "", ""), (4, None, "", ""), (99, 0, "", "")], 0.75)):
        model = additive.train(frame, labels(rows))
        assert {round(r["score"], 12) for r in additive.score(frame, model).collect()} == {share}
    mixed = labels([(n, n % 2, "", "") for n in range(10)] + [(3, 0, "", "")])
    one, two = (additive.train(frame, mixed).log_odds(additive.features(pa.array(TEXTS))) for _ in range(2))
    np.testing.assert_array_equal(one, two)
    assert additive.score(docs([]), additive.train(docs([]), mixed)).count() == 0


def test_quality_query_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.op12_quality_classifier(spark, sf_dir).join(queries.table(spark, sf_dir, "labels"), "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([r["predicted"] for r in good]) > 0.99 and np.mean([1 - r["predicted"] for r in bad]) > 0.95


def test_whitening_query_is_whole(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = queries.op13_embedding_whitening(spark, sf_dir)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    facts = got.groupBy("component").agg(F.count("*").alias("rows"), F.countDistinct("vec_id").alias("ids"), F.max("identity_error").alias("error"), F.first("explained").alias("share")).orderBy("component").collect()
    assert [(r["component"], r["rows"], r["ids"]) for r in facts] == [(c, 500, 500) for c in range(1, 9)]
    assert facts[0]["error"] <= 1e-4 and sorted((r["share"] for r in facts), reverse=True) == [r["share"] for r in facts]


def test_mask_takes_overlapping_spans_together(spark, docs):
    """Every pair of kinds that overlap, one in the other, or touch: nothing of either stays."""
    import gustledger.llm.pii as pii

    text = "0123456789abcdefghij"
    cases = [((2, 8), (5, 12)), ((2, 12), (4, 6)), ((2, 6), (6, 9)), ((2, 6), (2, 9))]
    spans = [[(a, j, b), (c, k, d)] for (a, b), (c, d) in cases for j in range(4) for k in range(4)]
    original, rows = pii.find, [(n, text) for n in range(len(spans))]

    def found(frame, tagger, text_col, base_col, spans_col):
        kind = "array<struct<start:int,kind:int,end:int>>"
        table = frame.sparkSession.createDataFrame([(n, s) for n, s in enumerate(spans)], f"_n long, {spans_col} {kind}")
        return frame.join(table, F.col("doc_id") == F.col("_n")).drop("_n")

    pii.find = found
    try:
        got = {r["doc_id"]: r["text"] for r in pii.mask(docs(rows), None).collect()}
    finally:
        pii.find = original
    for n, ((a, j, b), (c, k, d)) in enumerate(spans):
        first, second = (f"<{pii.KINDS[i].upper()}>" for i in (j, k))
        assert got[n] == (text[:a] + first + second + text[d:] if c >= b else text[:a] + first + text[max(b, d) :])
