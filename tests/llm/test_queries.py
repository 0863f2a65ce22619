"""The registered queries against DuckDB or brute force, and the pipeline against its stages done plainly."""

import hashlib
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from checks.compare import TABLES, rows_of
from gustledger.llm import pii, queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    result = con.sql(queries.ORACLES[name])
    assert sorted(result.columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(list(result.columns), result.fetchall())


def test_bpe_query(spark):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_file())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries.op8_bpe(spark, SF_DIR).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_pii_query_counts_and_digest(spark, docs, tmp_path, monkeypatch):
    """Counts by kind, whatever the order of the spans, and the digest of the patterns' spans."""
    rows = [
        (1, "a@b.c then d@e.f"), (2, "call +1 (234) 567-8901 or x@y.z at 10.0.0.1, +44 20 7946 0958"), (3, "4111 1111 1111 1111 é 1.2.3.4"),
        (4, None), (5, "no one"), (5, "1.1.1.1 2.2.2.2 1.1.1.999"), (None, "p@q.r"),
    ]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    weights = {"o": np.zeros((32, pii.TAGS)), "ob": np.array([50.0] + [0.0] * (pii.TAGS - 1)), "t": np.zeros((pii.TAGS + 1, pii.TAGS))}
    nothing = pii.Tagger({**weights, **{f"e{d}": np.zeros((100, 64)) for d in "fb"}, **{f"u{d}": np.zeros((16, 64)) for d in "fb"}})
    monkeypatch.setattr(pii, "train", lambda docs: nothing)
    expected = []
    for ident, text in rows:
        spans = pii.pattern_spans(text or "")
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        expected.append((ident, *[sum(k == i for _, k, _ in spans) for i in range(4)], hashlib.sha256(listed.encode()).hexdigest(), listed))
    got = [tuple(r) for r in queries.op7_pii(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sorted(r[1:5] for r in got) == sorted([(2, 0, 0, 0), (1, 1, 0, 2), (0, 1, 1, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 2, 0, 0), (1, 0, 0, 0)])


@pytest.mark.parametrize("name", ["op2_sharding", "op6_lm_scoring", "op9_quality_rules", "op10_license_scans"])
def test_one_row_per_document(spark, name):
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    assert sorted(r["doc_id"] for r in queries.QUERIES[name](spark, SF_DIR).collect()) == ids


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    source = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert set(got) <= set(source) and all(r["restored"] for r in got.values())
    similar = {r["doc_id"]: r["component_id"] for r in queries.op5_ngram_jaccard_join(spark, SF_DIR).collect()}
    classes = [similar[i] for i in got]
    assert len(classes) == len(set(classes))
    dirty = {r["doc_id"] for r in queries.op1_decontamination(spark, SF_DIR).where("contaminated").collect()}
    assert not dirty & set(got)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns, name
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert not any(email.search(r["text"] or "") for r in corpus_pipeline.masked(spark, docs, SF_DIR).collect())


def test_pipeline_joins_copies_of_eight_tenths(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:170])), (3, " ".join(words[:150]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs.where("doc_id < 3"), SF_DIR).collect()] == [1]
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs.where("doc_id <> 2"), SF_DIR).collect()) == [1, 3]
