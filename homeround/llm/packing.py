"""Best-fit packing planned over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import TextBlock, annotate, written

PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def cut(docs: DataFrame, tokenizer_path: str, limit: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: a document's ids, then ``end_id``; only documents over ``limit`` are cut, the first piece takes the remainder."""

    outside = bpe.exceptions(tokenizer_path)

    def compute(block: TextBlock) -> list:
        out, counts = [], []
        for text in block.strings():
            ids = np.append(np.asarray(bpe.ids(tokenizer_path, text, outside), "<u4"), np.uint32(end_id)).astype("<u4")
            n = len(ids)
            k = -(-n // limit)
            ends = [n - limit * i for i in range(k - 1, -1, -1)]
            start = 0
            for piece, end in enumerate(ends):
                out.append((piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                start = end
            counts.append(k)
        cols = list(zip(*out)) or [()] * 4
        pieces = pa.StructArray.from_arrays(
            [pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=PIECE.names
        )
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return [pa.ListArray.from_arrays(offsets, pieces)]

    field = T.StructField("__pieces", T.ArrayType(PIECE))
    cut_up = annotate(docs, compute, [field], text_col, keep=[id_col])
    return cut_up.select(id_col, F.explode("__pieces").alias("p")).select(id_col, "p.*")


def plan(histogram: dict[int, int], limit: int) -> np.ndarray:
    """Best-fit decreasing over counts.

    Returns segments (length, first_rank, last_rank + 1, first sequence, pieces per sequence, offset):
    pieces of that length with those ranks fill those sequences in turn. Sequences with the same room
    are handled together, so the work depends on the number of distinct lengths, never on documents.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, count)
    fits = np.zeros(limit + 1, bool)
    segments, opened = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            rooms.setdefault(room, []).append((first, count))
            fits[room] = True

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            best = np.flatnonzero(fits[length:])
            if best.size:
                room = length + int(best[0])
                first, count = rooms[room].pop()
                if not rooms[room]:
                    fits[room] = False
            else:
                room, per = limit, limit // length
                first, count = opened, -(-left // per)
                opened += count
            per = room // length
            full = min(count, left // per)
            if full:
                segments.append((length, rank, rank + full * per, first, per, limit - room))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < count:
                if left:  # fewer than ``per`` remain: they go into one sequence
                    segments.append((length, rank, rank + left, first + full, left, limit - room))
                    put(room - left * length, first + full, 1)
                    full, rank, left = full + 1, rank + left, 0
                put(room, first + full, count - full)
    return np.array(segments, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into few sequences of at most ``limit`` tokens; one row per piece with its ``sequence_id`` and ``offset``.

    Tokenises once into a small written table of pieces (no ids in it). The driver sees only the length
    histogram, at most ``limit`` rows, and plans best-fit over its counts. Pieces then get their rank
    within their length: a hot length is dealt over buckets by a hash of the id, ranks count up inside
    a bucket, and a running total over buckets makes them gapless. Each piece finds its segment of
    the plan by (length, rank); no group of pieces is ever in one task.

    Null text counts as empty: one piece of one id. Repeated rows are packed as often as they occur.
    """
    spark = docs.sparkSession
    pieces = written(cut(docs, tokenizer_path, limit, end_id, id_col, text_col), "pieces")
    counts = pieces.groupBy("length").count().collect()  # at most ``limit`` rows
    total = sum(r["count"] for r in counts)
    segments = plan({r["length"]: r["count"] for r in counts}, limit)
    buckets = max(16, -(-total // 200_000))
    dealt = pieces.withColumn("__b", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("length", "__b").orderBy(id_col, "piece")
    ranked = dealt.withColumn("__r", F.row_number().over(inside).cast("long") - 1)
    sizes = dealt.groupBy("length", "__b").count()
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    ranked = ranked.join(sizes, ["length", "__b"]).select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("__r") + F.col("__base")).alias("__rank")
    )
    schema = T.StructType(
        [f for f in ranked.schema.fields[:5]] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    shift = 1 << 44
    planned = spark.sparkContext.broadcast(segments[np.lexsort((segments[:, 1], segments[:, 0]))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = planned.value
        keys = seg[:, 0] * shift + seg[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            s = seg[np.searchsorted(keys, length * shift + rank, "right") - 1] if len(rank) else seg[:0]
            nth, turn = (rank - s[:, 1]) // s[:, 4], (rank - s[:, 1]) % s[:, 4]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(s[:, 3] + nth), pa.array(s[:, 5] + turn * length)], names=schema.names
            )

    return ranked.mapInArrow(place, schema)
