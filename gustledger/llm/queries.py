"""The operators on the driver's tables, with their production parameters."""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustledger.llm import additive, bpe, clustering, decontamination, language, licenses, pii, quality, sharding, similarity, substrings, toxicity, whitening
from gustledger.llm.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Most bytes of text in a shard.
SHARD_BYTES = 16 << 20


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The public byte-level vocabulary, where it is installed."""
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13)
    joined = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", joined.alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        placed = sharding.shards(table(spark, sf_dir, "documents"), scratch, SHARD_BYTES)
        return scratch.result(placed.withColumnRenamed("id", "doc_id"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(remainder("doc_id", 4) != 2))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        found = substrings.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch, 50)
        return scratch.result(found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        found = similarity.similar_documents(table(spark, sf_dir, "documents"), scratch)
        return scratch.result(found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id")))


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    with Scratch(spark) as scratch:
        scored = language.score(table(spark, sf_dir, "documents"), ~held_out, scratch)
        return scratch.result(scored.withColumnRenamed("id", "doc_id").withColumn("held_out", held_out))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))

    def listed(column: str):
        kinds = F.array(*[F.lit(k) for k in pii.KINDS])
        return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))

    def counted(i: int):
        # One parameter only: F.filter hands a second one the place in the array.
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    counts = [counted(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query
def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, bpe.load_vocabulary(vocabulary or tokenizer_file()))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.ratios(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    rated = quality.rate(docs, weights)
    base = quality.failed()
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.col("llr") >= quality.THRESHOLD)).alias("kept"), "llr")


@query
def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(listed, ",").alias("spans"), F.coalesce(F.array_max(F.transform("licenses", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"))


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        assigned, centroids = clustering.cluster(table(spark, sf_dir, "embeddings"), scratch, k=16, rounds=3, length=64, scale=64)
        sums = clustering.inertia(assigned)
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
        facts = spark.createDataFrame([(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        # One row per centroid, sixteen at most.
        joined = assigned.join(F.broadcast(facts), "cluster")
        return scratch.result(joined.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


@query
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = additive.train(docs, labels.where(remainder("doc_id", 5) != 0))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return additive.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    with Scratch(spark) as scratch:
        model = whitening.fit(embeddings, scratch)
        if model is None:
            return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
        rows = scratch.store(whitening.transform(embeddings, model))
        error = whitening.identity_error(rows, model)
        shares = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else 0.0) for v in model.variances])
        each = rows.select(F.col("id").alias("vec_id"), F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("component", "whitened"))
        return scratch.result(
            each.select("vec_id", (F.col("component") + 1).alias("component"), F.lit(model.count).cast("long").alias("n"), "deviation", "whitened", shares[F.col("component")].alias("explained"), F.lit(error).alias("identity_error"))
        )


ORACLES["op1_decontamination"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS g, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLES["op5_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * common >= 90 * (p.n + q.n - common)),
sym AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, sym.y FROM reach JOIN sym ON sym.x = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c ON c.doc_id = d.doc_id
"""

ORACLES["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT doc_id, list(i) AS starts FROM win JOIN least USING (g) WHERE doc_id > m GROUP BY doc_id),
dead AS MATERIALIZED (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM (SELECT doc_id, unnest(starts) AS s FROM gone))),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS t, count(*) AS n
  FROM each e LEFT JOIN dead x ON x.doc_id = e.doc_id AND x.p = e.p WHERE x.p IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def _clustering_sql() -> str:
    """Three rounds of assignment and floor means, one after the other, then the last assignment."""
    parts = [
        """p AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x
  FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, x FROM p ORDER BY h NULLS LAST, x LIMIT 16))""",
    ]
    for k in range(4):
        parts.append(
            f"""a{k} AS MATERIALIZED (
  SELECT r, min(d) AS d, arg_min(c, d * 16 + c) AS c
  FROM (SELECT r, c, list_sum(list_transform(list_zip(p.x, c{k}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p, c{k})
  GROUP BY r)"""
        )
        if k < 3:
            parts.append(
                f"""c{k + 1} AS MATERIALIZED (
  WITH m AS (
    SELECT c, i, CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS v
    FROM (SELECT c, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} JOIN p USING (r), range(1, 65) t(i) GROUP BY c, i)),
  l AS (SELECT c, list(v::BIGINT ORDER BY i) AS x FROM m GROUP BY c)
  SELECT c{k}.c, coalesce(l.x, c{k}.x) AS x FROM c{k} LEFT JOIN l ON l.c = c{k}.c)"""
            )
    return "WITH " + ",\n".join(parts) + """
SELECT p.vec_id, a3.c::INTEGER AS cluster, a3.d AS distance,
  (sum(a3.d) OVER (PARTITION BY a3.c))::BIGINT AS cluster_inertia, (sum(a3.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM p JOIN a3 USING (r) JOIN c3 ON c3.c = a3.c
"""


ORACLES["op11_centroid_clustering"] = _clustering_sql()
