"""Benchmark decontamination through a positional index of the collection.

The index holds postings ``(term, document, position)`` of the test terms that are rarest in the
collection, each with the tokens around it. A test window is looked up by its rarest term: the
posting's position less the term's offset in the window is the only place where the window can
start, and the neighbouring tokens decide whether its other terms stand there too. Document
frequencies come from the whole collection. Only DataFrame functions are used.

Nulls: a text without words, a null text and an empty table give rows without hits; items without
words are no windows. Rows repeated exactly give a result row each. Items are told apart by
``item_id``; items with a null id have no windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Test words looked up in one pass over the collection. Larger test sets go in blocks of items.
WORDS_PER_BLOCK = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """Lower-cased words of a text, an empty list for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, window``: every run of ``n`` words of an item; an item of fewer words is one window."""
    words = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), word_list(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    return words.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), n).alias("window")).distinct()


def document_frequency(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, n``: occurrences in the collection of the given terms (at most a block's words, so they are broadcast)."""
    tokens = docs.select(F.explode(word_list(F.col(text_col))).alias("term"))
    return tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def leading_terms(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """Each window with its rarest term and that term's offset. Windows with a term the collection lacks are gone."""
    terms = windows.select("item", "window", F.posexplode("window").alias("offset", "term"))
    known = terms.join(frequency, "term", "left")
    lead = known.groupBy("item", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")).alias("lead"))
    return lead.where("lead.n > 0").select("item", "window", F.col("lead.term").alias("term"), F.col("lead.offset").alias("offset"))


def postings(docs: DataFrame, terms: list[str], reach: int, keep: list[str], text_col: str = "text") -> DataFrame:
    """The index: a row for each occurrence of a term, with its position and up to ``reach`` tokens on both sides.

    Every document also has one row with a null term, which carries its number of words; ``keep`` columns stay.
    """
    held = docs.select(*keep, word_list(F.col(text_col)).alias("words"))
    at = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.element_at("words", i).isin(terms)) if terms else F.array().cast("array<int>")
    at = F.when(F.size("words") > 0, at).otherwise(F.array().cast("array<int>"))

    def around(i):
        low = F.greatest(i - reach, F.lit(1))
        return F.struct(F.element_at("words", i).alias("term"), (i - 1).alias("pos"), (i - low).alias("before"), F.slice("words", low, i - low + 1 + reach).alias("near"))

    base = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("pos"), F.lit(0).alias("before"), F.array().cast("array<string>").alias("near")))
    rows = F.concat(base, F.transform(at, around))
    return held.select(*keep, F.size("words").cast("long").alias("n_words"), F.explode(rows).alias("p")).select(*keep, "n_words", "p.*")


def _blocks(windows: DataFrame, width: int) -> int:
    """Blocks of items so that a block has at most about WORDS_PER_BLOCK words."""
    return max(1, math.ceil(windows.count() * width / WORDS_PER_BLOCK))


def phrase_matches(index: DataFrame, leads: DataFrame) -> DataFrame:
    """Index rows at which a window occurs, with ``item``, ``start`` and ``length``; the documents' own rows have a null item.

    ``leads`` is a block of the test set, so it is broadcast; the collection's postings do not move.
    """
    there = index.join(F.broadcast(leads.withColumnRenamed("term", "lead")), F.col("term") == F.col("lead"), "left")
    first = F.col("before") - F.col("offset") + 1
    fits = (first >= 1) & (F.slice("near", F.greatest(first, F.lit(1)), F.size("window")) == F.col("window"))
    return there.where(F.col("term").isNull() | fits).select("*", (F.col("pos") - F.col("offset")).alias("start"), F.size("window").alias("length")).drop("near", "lead", "window", "offset", "before")


def proximity_matches(index: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings near which all terms of a group stand, in any order, within the index's reach.

    ``groups``: ``item, term`` (the rarest, by which it is looked up) and ``terms`` (all of them); a block of the test set.
    """
    there = index.where(F.col("term").isNotNull()).join(F.broadcast(groups.withColumnRenamed("term", "lead")), F.col("term") == F.col("lead"))
    return there.where(F.size(F.array_except("terms", "near")) == 0).drop("near", "lead", "before")


def rare_groups(items: DataFrame, frequency: DataFrame, terms: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``terms`` rarest words of each item as a group for proximity_matches; items with a word the collection lacks among them are gone."""
    words = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.explode(F.array_distinct(word_list(F.col(text_col)))).alias("term"))
    ranked = words.join(frequency, "term", "left").groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))), 1, terms).alias("rare"))
    return ranked.where(F.element_at("rare", 1)["n"] > 0).select("item", F.element_at("rare", 1)["term"].alias("term"), F.col("rare.term").alias("terms"))


def contamination(docs: DataFrame, items: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit (words inside an occurring window), n_items and the sorted ``items``; row_hash tells
    rows of one id apart.

    One pass over the collection counts the test terms, one looks the windows up. Documents move
    once, as counts and matches.
    """
    windows = item_windows(items, n, item_id, item_text)
    blocks = _blocks(windows, n)
    keys = docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_row"), F.col(text_col).alias("_text"))
    found = None
    for b in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        terms = part.select(F.explode("window").alias("term")).distinct()
        leads = leading_terms(part, document_frequency(keys, terms, "_text")).collect()
        leads = docs.sparkSession.createDataFrame(leads, "item string, window array<string>, term string, offset int")
        rare = sorted(r["term"] for r in leads.select("term").distinct().collect())
        rows = phrase_matches(postings(keys, rare, n - 1, ["_id", "_row"], "_text"), leads)
        rows = rows.where(F.col("term").isNotNull()) if b else rows
        found = rows if found is None else found.unionByName(rows)
    spans = F.collect_set(F.when(F.col("item").isNotNull(), F.struct("start", "length")))
    per_row = found.groupBy("_id", "_row", "n_words").agg(
        F.sum(F.col("term").isNull().cast("int")).alias("_copies"), spans.alias("_spans"), F.sort_array(F.collect_set("item")).alias("items")
    )
    covered = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    out = per_row.select(F.col("_id").alias(id_col), "n_words", F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.col("_row").alias("row_hash"), F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy"))
    return out.drop("_copy")


def clean(docs: DataFrame, items: DataFrame, n: int = 13, percent: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which less than ``percent`` of the words lie in occurring windows."""
    found = contamination(docs, items, n, id_col, text_col).where((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
    gone = found.select(F.col(id_col).alias("_gone"), "row_hash").distinct()
    return docs.join(gone, (F.xxhash64(docs[id_col], docs[text_col]) == gone["row_hash"]) & docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
