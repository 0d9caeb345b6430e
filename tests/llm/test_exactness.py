"""Inputs that once went wrong: structured texts, links through rows without id, many ids of one item."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from homeround.llm import decontaminate, repeats, simhash


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("length", [512, 1024, 2048])
def test_structured_texts_that_nowhere_repeat_stay(spark, length):
    word = thue_morse(length)
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, "x" + word[: length - 1]), (4, "yy" + other), (5, "z" + other)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs, length).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (0, sha(word)), 2: (length, sha("")), 3: (0, sha("x" + word[: length - 1])), 4: (length, sha("yy")), 5: (length, sha("z"))}


def test_crowded_windows_are_told_apart(spark):
    """Short lines in very many contexts end in counted windows."""
    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(list("ab"), 12)) + "l" * 30 + "".join(rng.choice(list("ab"), 12))) for i in range(300)]
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, 8, 4).collect()}
    seen = {}
    for i, t in rows:
        for k in range(len(t) - 39):
            seen.setdefault(t[k : k + 40], []).append((i, k))
    for i, t in rows:
        gone = {p for k in range(len(t) - 39) if len(seen[t[k : k + 40]]) > 1 for p in range(k, k + 40)}
        assert got[i] == len(gone)


def test_links_through_rows_without_id(spark, monkeypatch):
    given = {"zero": 0, "seven": 7, "far": 63, "alone": 0x0F0F0F0F0F0F0F0F, "top": 0xF0F0F0F0F0F0F0F0}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, text_col, keep, shingle: docs.select(*keep, F.col("text").cast("long").alias("fp")))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(1, "zero"), (None, "seven"), (2, "far"), (None, "alone"), (5, "top"), (6, "top")]
    docs = spark.createDataFrame([(i, str(signed(given[t]))) for i, t in rows], "doc_id long, text string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 0): 1, (None, 7): 1, (2, 63): 1, (None, given["alone"]): None, (5, signed(given["top"])): 5, (6, signed(given["top"])): 5}


def test_many_ids_of_one_item(spark):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.range(20_000).select(F.concat(F.lit("i"), F.col("id")).alias("item_id"), F.when(F.col("id") < 19_990, item).otherwise(F.concat(F.lit(item + " "), F.col("id"))).alias("text"))
    items = items.union(spark.createDataFrame([(None, "a b c d e f g h i j")], "item_id string, text string"))
    docs = spark.createDataFrame([(1, "x " + item), (2, "nothing"), (3, "a b c d e f g h i j k")], "doc_id long, text string")
    for part_bytes in (2_000_000, 100):
        got = {r.doc_id: (r.n_hit, r.n_items, len(r.item_ids)) for r in decontaminate.find_items(docs, items, part_bytes=part_bytes).collect()}
        assert got == {1: (11, 20_000, 20_000), 2: (0, 0, 0), 3: (10, 0, 0)}
