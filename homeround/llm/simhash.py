"""SimHash near-duplicates, paired through tables of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homeround.operators.graphs import components

from .common import TextBlock, annotate, written

SHINGLE = 3
SEED = 42
NEAR = 3
PIVOTS = 32
GROUP = 256


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words, repeats included; a shorter text is one run, one without words none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: lower-cases A-Z only, splits at \x20 and \x09-\x0D only
    n = len(words)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)] if n else [], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have set."""
    if len(h) < 2:
        return int(h[0]) if len(h) else 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        bits = np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``fp``, the 64-bit fingerprint as a signed long; no shuffle. Null or wordless text: 0."""

    def compute(block: TextBlock) -> list:
        return [np.array([majority(shingle_hashes(t, shingle)) for t in block.raw()], np.uint64).view(np.int64)]

    return annotate(docs, compute, [T.StructField("fp", T.LongType())], text_col, keep)


def block_masks(level: int) -> list[int]:
    """Masks of a level: each mask above with one quarter of its free bits added.

    Two fingerprints at ``NEAR`` = 3 or fewer differing bits agree on one of any four disjoint parts, so
    they share a key (mask, masked value) at every level.
    """
    masks = [0]
    for _ in range(level):
        deeper = []
        for m in masks:
            free = [i for i in range(64) if not m >> i & 1]
            for q in range(4):
                part = free[q * len(free) // 4 : (q + 1) * len(free) // 4]
                deeper.append(m | sum(1 << i for i in part))
        masks = deeper
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(nodes: DataFrame, level: int) -> DataFrame:
    """(node, fp, path, value) for each mask of this level under the row's path of masks above."""
    if level == 1:
        options = F.array(*[F.struct(F.lit(i).alias("path"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(block_masks(1))])
    else:
        masks = F.array(*[F.lit(_signed(m)) for m in block_masks(level)])
        options = F.transform(
            F.array(*[F.lit(q) for q in range(4)]),
            lambda q: F.struct((F.col("path") * 4 + q).alias("path"), F.element_at(masks, F.col("path") * 4 + q + 1).alias("mask")),
        )
    return nodes.withColumn("o", F.explode(options)).select(
        "node", "fp", F.col("o.path").alias("path"), F.col("fp").bitwiseAND(F.col("o.mask")).alias("value")
    )


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 64, n, np.uint64)


def _links(keys: np.ndarray, fp: np.ndarray, near: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with the same key and ``near`` or fewer differing bits.

    Rows are sorted by key and distance to the first reference; a sweep compares each row with the
    next, second next and so on while that distance differs by ``near`` at most. A pair stays only if
    no coordinate differs by more (triangle inequality), and is then verified bit by bit.
    """
    table = np.stack([np.bitwise_count(fp ^ p) for p in pivots], axis=1).astype(np.int16)
    order = np.lexsort((fp, table[:, 0], keys))
    keys, fp, table = keys[order], fp[order], table[order]
    at = np.arange(len(fp))
    left, right, lag = [], [], 0
    while len(at):
        lag += 1
        at = at[at + lag < len(fp)]
        b = at + lag
        go = (keys[at] == keys[b]) & (table[b, 0] - table[at, 0] <= near)
        at, b = at[go], b[go]
        i, j = at, b
        for c in range(1, table.shape[1]):
            ok = np.abs(table[i, c] - table[j, c]) <= near
            i, j = i[ok], j[ok]
            if not len(i):
                break
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= near
        left.append(order[i[ok]])
        right.append(order[j[ok]])
    return np.concatenate(left or [at]), np.concatenate(right or [at])


def _forest(n: int, i: np.ndarray, j: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of n rows the row of smallest rank that it reaches over the links."""
    by = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[by] = np.arange(n)
    a, b, label = place[i], place[j], np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return by[label[place]]
        label = new


def near_links(nodes: DataFrame, near: int = NEAR, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect every pair of nodes (node, fp) within ``near`` bits, as a spanning forest per group.

    Keys of one quarter of the bits bring each close pair together. A key that holds more than
    ``group`` fingerprints is split: its rows get keys with one more quarter of the free bits each, again
    and again, which loses no pair; after six levels 11 free bits remain, at most 2,048 fingerprints.
    Inside a group the distance table to the reference fingerprints discards pairs.
    """
    if near > 3:
        raise ValueError("the keys hold for 3 differing bits or fewer")
    ready, rest = [], nodes
    for level in range(1, 7):
        keyed = written(_keyed(rest, level), f"keys{level}")
        sizes = keyed.groupBy("path", "value").agg(F.count("*").alias("__n")).where("__n > 1")
        sized = keyed.join(sizes, ["path", "value"])
        if level == 6:
            ready.append(sized)
            break
        large = sizes.where(F.col("__n") > group)
        if large.isEmpty():
            ready.append(sized)
            break
        ready.append(sized.where(F.col("__n") <= group))
        rest = keyed.join(large, ["path", "value"]).drop("__n", "value")
    pivots = reference_fingerprints()
    edges = None
    for part in ready:
        rows = part.select("path", "value", "node", "fp").repartition("path", "value").sortWithinPartitions("path", "value")

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((0, 4), np.int64)
            for batch in _then_end(batches):
                if batch is not None:
                    new = np.stack([np.asarray(c, dtype=np.int64) for c in batch.columns], axis=1)
                    held = np.concatenate([held, new]) if len(held) else new
                    if not len(held):
                        continue
                    earlier = np.flatnonzero((held[:, :2] != held[-1, :2]).any(axis=1))
                    whole = int(earlier[-1]) + 1 if len(earlier) else 0  # the last group may go on
                else:
                    whole = len(held)
                rows, held = held[:whole], held[whole:]
                if not len(rows):
                    continue
                keys = np.concatenate([[0], np.cumsum((rows[1:, :2] != rows[:-1, :2]).any(axis=1))])
                i, j = _links(keys, np.ascontiguousarray(rows[:, 3]).view(np.uint64), near, pivots)
                root = _forest(len(rows), i, j, rows[:, 2])
                moved = root != np.arange(len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(rows[moved, 2]), pa.array(rows[root[moved], 2])], names=["a", "b"])

        found = rows.mapInArrow(link, "a long, b long")
        edges = found if edges is None else edges.union(found)
    return edges


def _then_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, shingle: int = SHINGLE) -> DataFrame:
    """(id, ``fp``, ``component_id``) per row: documents linked, directly or through others, at ``near`` or fewer differing bits.

    Equal fingerprints collapse to one node before any pairing, so a group of copies of any size costs one node; ids come in afterwards.
    ``component_id`` is the smallest id of the component. Documents without words have fingerprint 0 and link like any other. A row
    with a null id links like any other and takes its component's id, null if all ids of the component are null. Repeated rows each get
    their row.
    """
    fp = written(fingerprints(docs, text_col, [id_col], shingle), "fingerprints")
    nodes = written(fp.groupBy("fp").agg(F.min(id_col).alias("id")), "nodes")
    found = components(near_links(nodes.select(F.col("fp").alias("node"), "fp"), near))
    labels = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    smallest = labels.groupBy("component").agg(F.min("id").alias("component_id"))
    return fp.join(labels.join(smallest, "component").select("fp", "component_id"), "fp", "left").select(id_col, "fp", "component_id")


def with_text_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ``h``, text): what a row is known by in :func:`one_of_each`."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def one_of_each(docs: DataFrame, marked: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One document of each component, with all columns: of smallest id; if no id of the component is set, of smallest fingerprint.

    ``marked`` holds (``id``, ``h``, ``fp``) of each row, ``found`` the component of each fingerprint that has a link. A row is
    known by its id, which may be null or repeated, and the 64-bit hash of its text; of rows alike in both one stays, chosen
    by a hash of all columns. Always a sort-merge join: what stays grows with the documents, so the plan is the same at every size.
    """
    labels = marked.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    smallest = F.min(F.struct(F.col("id").isNull(), "id", "fp", "h")).alias("k")
    name = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")).alias("name")
    kept = labels.groupBy(F.coalesce("component", "fp").alias("component")).agg(smallest).select("k.id", "k.h").select(name, "h")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.xxhash64(*docs.columns).alias("all"))
    left = rows.select("row", name, "h", "all").join(written(kept, "kept").hint("merge"), ["name", "h"], "left_semi")
    one = left.groupBy("name", "h").agg(F.min_by("row", "all").alias("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group of near-duplicates, of smallest id, with all its columns; see :func:`one_of_each`."""
    marked = written(fingerprints(with_text_hash(docs, id_col, text_col), "text", ["id", "h"], shingle), "fingerprints")
    nodes = written(marked.select("fp", F.col("fp").alias("node")).distinct(), "nodes")
    return one_of_each(docs, marked, components(near_links(nodes, near)), id_col, text_col)
