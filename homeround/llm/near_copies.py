"""Near copies by the Jaccard similarity of word shingles: SimHash links first, then prefix filtering for what they miss, all verified.

Three differing bits of a SimHash (``simhash``) miss most pairs at 0.8; prefix filtering loses none. The links that SimHash finds
are cheap and join most of a group of copies, so that the prefix keys have to tell apart far fewer components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homeround.operators.graphs import components

from .common import TextBlock, annotate, blocks, forget, trim, written
from .simhash import SEED, majority, near_links, one_of_each, shingle_hashes, with_text_hash

SHINGLE = 5
PERCENT = 80
SAMPLE, COMMON = 8_192, 200_000
SLOTS = 1 << 24
BITMAP = 8  # longs
SIMHASH_GROUP = 4096  # fewer, larger groups than by default: fewer small jobs


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``shingle`` words (a shorter text is one run); words as in ``simhash``."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def set_hash(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def bitmap(hashes: np.ndarray, longs: int = BITMAP) -> np.ndarray:
    """For each of ``64 * longs`` slots (a power of two) whether an odd number of the hashes falls in it.

    Two sets differ by at least as many hashes as their bitmaps do by bits. The halves of a bitmap give, by XOR, the one of half its slots.
    """
    odd = np.bincount(hashes & (64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_bitmap(hashes: np.ndarray) -> np.ndarray:
    """The bitmap with a slot a hash at least: one of 512 slots is full for long texts and tells them no more apart."""
    return bitmap(hashes, max(BITMAP, 1 << max(0, len(hashes) - 1).bit_length() >> 6))


def _fine_apart(a: str, b: str) -> Column:
    """By how many bits two fine bitmaps differ, the larger one folded to the slots of the smaller; sizes within a factor of two."""

    def folded(x: str, other: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        halves = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), halves).otherwise(F.col(x))

    bits = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many of n shingles, in an order that all texts share, hold one of any set that is similar enough; 0 where only an equal set is."""
    need = -(-n * percent // 100)
    largest = n * 100 // percent  # the largest set that can be similar enough
    return n - need + 1 if need < n or largest > n else 0


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]), pa.int64()))


LONGS = T.ArrayType(T.LongType())


def common_shingles(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) and counts of those found in two or more of about 8,192 different texts. They only set the order: any order loses no pair."""
    every = max(1, docs.count() // SAMPLE)
    text = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    sets = annotate(text, lambda block: [_lists([shingle_set(t, shingle) for t in block.raw()])], [T.StructField("set", LONGS)], "text", [])
    often = sets.select(F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    rows = sorted((r.h, r.c) for r in often.orderBy(F.desc("c"), "h").limit(COMMON).collect())
    return np.array([h for h, _ in rows], np.int64), np.array([c for _, c in rows], np.int64)


def _rare_first(hashes: np.ndarray, known: np.ndarray, count: np.ndarray) -> np.ndarray:
    if not len(known):
        return hashes
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return hashes[np.argsort(np.where(known[at] == hashes, count[at], 0), kind="stable")]


def _shared_keys(keys: DataFrame) -> DataFrame:
    """(key, n, fp, pos) of the keys that two or more nodes hold, n shingles each, the key at place pos of their prefix; and the same of a leader and of the node before.

    The leader is the key's node of fewest shingles: where a passage makes texts alike, the one that holds the least besides.
    The node before is the next smaller one (both are the node itself where it is the first). Streams sorted rows, one row held.
    """
    names = [f"{who}{c}" for who in ("", "leader_", "before_") for c in ("key", "n", "fp", "pos") if not who or c != "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = leader = before = None  # the last row waits for the next one, with its leader and the node before it

        def out(rows: np.ndarray, leaders: np.ndarray, befores: np.ndarray, following: int | None) -> pa.RecordBatch:
            """Rows but those alone with their key; ``following`` is the key of the row after the last."""
            after = np.append(rows[1:, 0] == rows[:-1, 0], following == rows[-1, 0])
            kept = after | (leaders[:, 1] != rows[:, 2])
            return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (*rows.T, *leaders.T, *befores.T)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(c, dtype=np.int64) for c in batch.columns], axis=1)
            if held is not None:
                rows = np.concatenate([held, rows])
            first = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
            at = np.arange(len(rows))
            leaders = rows[np.maximum.accumulate(np.where(first, at, 0)), 1:]
            befores = rows[np.where(first, at, at - 1), 1:]
            if held is not None:
                leaders[np.cumsum(first) == 1], befores[0] = leader, before
            if len(rows) > 1:
                yield out(rows[:-1], leaders[:-1], befores[:-1], rows[-1, 0])
            held, leader, before = rows[-1:], leaders[-1], befores[-1]
        if held is not None:
            yield out(held, leader[None], before[None], None)

    return keys.select("key", "n", "fp", "pos").repartition("key").sortWithinPartitions("key", "n", "fp").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    a = sets.select(F.col("fp").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("fp").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    similar = both * (100 + percent) >= percent * (F.size("sa") + F.size("sb"))
    return pairs.join(a, "a").join(b, "b").where(similar).select("a", "b")


def _sets_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(fp, set) of the nodes (``id``, null where no row has one). A bitmap of their ids' slots picks the texts, without a shuffle; others that it lets pass do no harm."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    place = slot("id") + 1  # Spark's bitmaps count from 1
    parts = nodes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    taken = np.zeros((SLOTS >> 15, 4096), np.uint8)
    for r in parts.collect():  # made in tasks: at most 512 bitmaps of 4 KB
        taken[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    bits = docs.sparkSession.sparkContext.broadcast(taken.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # picks and hashes in one worker a task
        for batch in batches:
            at = np.asarray(batch.column(0))
            batch = batch.filter(pa.array((bits.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            for part in blocks(batch, 1):
                rows = [shingle_set(t, shingle) for t in TextBlock(part.column(1)).raw()]
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(r) for r in rows], pa.int64()), _lists(rows)], names=["fp", "set"])
            trim()

    rows = docs.select(slot(id_col).alias("slot"), F.col(text_col).cast("string").alias("text"))
    sets = rows.mapInArrow(run, "fp long, set array<long>")
    return sets.join(nodes.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def simhash_links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the nodes (fp, sim) within three bits of each other's SimHash; nodes of one SimHash hang on their smallest."""
    alike = written(nodes.groupBy("sim").agg(F.min("fp").alias("node")), "alike")
    same = nodes.join(alike, "sim").where("fp <> node").select(F.col("node").alias("a"), F.col("fp").alias("b"))
    return same.union(near_links(alike.select("node", F.col("sim").alias("fp")), group=SIMHASH_GROUP))


def near_copy_links(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) of nodes that connect all pairs of ``percent`` or more, straight or through others.

    Nodes that share a prefix key are candidates. First those within three bits are compared, and each with its keys' leaders and
    the nodes before it; then, of the keys that still hold several components, the pairs of different components. A key counts
    for a pair only if what follows it on both sides can make them similar enough: of a similar pair the first common key always
    does. Bitmaps with the parity of the shingles in each of 512 slots bound the difference of two sets from below, and before
    any set is fetched those with a slot a shingle (an eighth to a quarter of a byte each) decide again on the pairs left.
    """
    one = ("n", "prefix", "sim", "bits", "fine")
    nodes = written(marked.groupBy("fp").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in one]), "nodes")
    shared = written(_shared_keys(nodes.select("fp", "n", F.posexplode("prefix").alias("pos", "key"))), "shared")
    there = written(nodes.drop("prefix").join(shared.select("fp").distinct(), "fp", "left_semi"), "candidates")
    forget(nodes)
    total = F.col("na") + F.col("nb")
    need = F.ceil(total * percent / (100 + percent))  # common shingles that a similar pair has at least
    ahead = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (ahead + 1 >= need)

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are similar enough, by their sets."""
        a, b = (there.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}")) for x in "ab")
        alike = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent  # then a bitmap has at most twice the other's slots
        possible = F.when(alike, total - _fine_apart("fa", "fb") >= 2 * need)
        pairs = written(pairs.distinct().join(a, "a").join(b, "b").where(possible).select("a", "b"), name)
        ends = written(there.select("fp", "id").join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi"), f"{name}-ends")
        sets = written(_sets_of(docs, ends, id_col, text_col, shingle), f"{name}-sets")
        found = written(_verified(pairs, sets, percent), f"{name}-links")
        forget(pairs, ends, sets)
        return found

    def with_other(who: str) -> DataFrame:
        pairs = shared.where(f"fp <> {who}_fp").select(*[F.col(x).alias(y) for x, y in zip((f"{who}_fp", f"{who}_n", f"{who}_pos", "fp", "n", "pos"), ("a", "na", "pa", "b", "nb", "pb"))])
        return pairs.where(near).select("a", "na", "b", "nb", ahead.alias("ahead"))

    # Of a pair's keys only some count here, so similar pairs may be left to the second step.
    counted = with_other("leader").union(with_other("before")).groupBy("a", "na", "b", "nb").agg((F.count("*") + F.min("ahead")).alias("most"))
    found = similar(counted.where(F.col("most") >= need).select("a", "b").union(simhash_links(there.select("fp", "sim"))), "first")
    labels = there.select("fp", "bits").join(components(found).withColumnRenamed("node", "fp"), "fp", "left")
    # A key that follows the same shared key in both texts finds no pair that that one has not found.
    part = shared.select("key", "fp", "n", "pos").join(labels, "fp").withColumn("last", F.lag("key").over(Window.partitionBy("fp").orderBy("pos", "key")))
    part = written(part.select("key", "fp", "n", "pos", "last", "bits", F.coalesce("component", "fp").alias("c")), "parts")
    mixed = part.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    columns = ("fp", "n", "pos", "c", "last", "bits")
    left = part.join(mixed, "key", "left_semi").select("key", *[F.col(x).alias(y) for x, y in zip(columns, ("a", "na", "pa", "ca", "la", "ba"))])
    right = left.select("key", *[F.col(x).alias(y) for x, y in zip(("a", "na", "pa", "ca", "la", "ba"), ("b", "nb", "pb", "cb", "lb", "bb"))])
    apart = sum((F.bit_count(F.col("ba")[k].bitwiseXOR(F.col("bb")[k])) for k in range(1, BITMAP)), F.bit_count(F.col("ba")[0].bitwiseXOR(F.col("bb")[0])))
    new = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ~F.coalesce(F.col("la") == F.col("lb"), F.lit(False))
    more = similar(left.join(right, "key").where(new & near & (total - apart >= 2 * need)).select("a", "b"), "rest")
    forget(shared, there, part)
    return found.union(more)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The document of smallest id of each group of near copies, with all its columns; see :func:`simhash.one_of_each`.

    Two texts are near copies if ``percent`` or more of their ``shingle``-word runs are common (Jaccard, on distinct runs);
    a group is linked directly or through others. Texts without words are copies of each other.
    """
    known = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, shingle))

    def compute(block: TextBlock) -> list:
        fp, n, prefix, sim, bits, fine = [], [], [], [], [], []
        for t in block.raw():
            h = shingle_hashes(t, shingle)
            own = np.unique(h.view(np.int64))
            fp.append(set_hash(own))
            n.append(len(own))
            prefix.append(_rare_first(own, *known.value)[: prefix_size(len(own), percent)])
            sim.append(majority(h))
            bits.append(bitmap(own))
            fine.append(fine_bitmap(own))
        return [np.array(fp, np.int64), np.array(n, np.int64), _lists(prefix), np.array(sim, np.uint64).view(np.int64), _lists(bits), _lists(fine)]

    fields = [T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("prefix", LONGS), T.StructField("sim", T.LongType()), T.StructField("bits", LONGS), T.StructField("fine", LONGS)]
    marked = written(annotate(with_text_hash(docs, id_col, text_col), compute, fields, "text", ["id", "h"]), "shingles")
    found = components(near_copy_links(docs, marked, id_col, text_col, shingle, percent))
    return one_of_each(docs, marked.select("id", "h", "fp"), found, id_col, text_col)
