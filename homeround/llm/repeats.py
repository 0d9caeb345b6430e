"""Long repeated passages, marked through run-length indexes of routed text pieces.

A window is ``length`` consecutive bytes. Its anchor is the k-gram in it of least hash, so equal windows have
equal anchors wherever they stand. Consecutive windows with one anchor form a piece (about 285 bytes
for windows of 200). Pieces meet by the hash of their anchor:

1. one anchor, one piece: nothing repeats. Equal pieces are counted before anything is shuffled by text: all their windows
   repeat, and one copy stands for them from here on, so that a group of thousands of copies costs one piece;
2. different pieces at one anchor (mostly at borders of repeats): one copy of each goes, with the other
   pieces of its anchor, into a bucket. A task builds the run-length compressed Burrows-Wheeler transform of
   the bucket with sampled run ends, streams each piece through it by LF steps over the runs, gets its matching statistics
   and marks matches of ``length`` or more;
3. an anchor with more different pieces than ``group`` (a short line in very many contexts) does not go
   into one task: its windows get a second, third and fourth anchor under other hashes, which part most of
   them, and each smaller group goes the same ways; windows that four anchors leave in a crowd are
   counted one by one by a 128-bit hash, pre-aggregated before the shuffle.

All three are exact but for hash collisions: the XXH64 of their bytes tells two pieces of one anchor apart (128 bits of XXH3 two windows). With
6e11 pieces (100 TB) and ten others at the anchor of each, the chance of any collision is below 10^-6. Anchors come from a rolling
hash, which structured texts can make collide: that only brings more pieces to one anchor.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TextBlock, annotate, blocks, forget, written

LENGTH = 200
GRAM = 32
GROUP = 2048
BUCKET_BYTES = 1 << 20
BLOCK = 1 << 20
STRIDE = 8 << 20  # longer texts are scanned in strides that overlap by a window less one byte
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PLACE = 24
SEEDS = (0x51ED270B0B4A1F63, 0x7C15F39CC0605CED, 0x2545F4914F6CDD1D)


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.cumprod(np.full(n, base, np.uint64)),
        np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64)),
    )


def _prefix(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(base, 1 << max(21, (len(data) + 1).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power[: len(data)], out=total[1:])
    return total, inverse


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def pieces(data: np.ndarray, off: np.ndarray, length: int, gram: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor hash, piece hash) of the pieces of several texts side by side in ``data``."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < length:
        return none
    total, inverse = _prefix(data, BASES[0])
    n = len(data) - gram + 1
    h = _mix(((total[gram:] - total[:-gram]) * inverse[:n]) ^ np.uint64(seed))
    tagged = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(n, dtype=np.uint64)
    anchor = (_sliding_min(tagged, length - gram + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    m = len(anchor)
    last = off[1:] - length  # last window of each text
    valid = np.zeros(m + 1, np.int32)
    fit = last >= off[:-1]
    np.add.at(valid, off[:-1][fit], 1)
    np.add.at(valid, last[fit] + 1, -1)
    valid = np.cumsum(valid[:m]) > 0
    new = np.ones(m, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[off[:-1][off[:-1] < m]] = True
    new[1:] |= valid[1:] != valid[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], m)
    keep = valid[start]
    start, end = start[keep], end[keep]
    stop = end - 1 + length
    raw = memoryview(data.tobytes())
    content = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist())), np.uint64, len(start))
    text = np.searchsorted(off, start, "right") - 1
    return text, start - off[text], end - start, h[anchor[start]].view(np.int64), content.view(np.int64)


PLACED = "doc long, first long, count int"  # a piece: its first window, and how many


def _scan(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    """(anchor, piece, doc, first, count) of all pieces."""
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, BLOCK):
                block, ids = TextBlock(part.column(1)), np.asarray(part.column(0))
                for lo in range(0, max(1, len(block.buf) - length + 1), STRIDE):
                    whole = len(block.buf) <= STRIDE
                    data = block.buf if whole else block.buf[lo : lo + STRIDE + length - 1]
                    off = block.off if whole else np.array([0, len(data)])  # only a text alone is that long
                    text, first, count, anchor, piece = pieces(data, off, length, gram)
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, (anchor, piece, ids[text], first + (0 if whole else lo), count.astype(np.int32)))],
                        names=["anchor", "piece", "doc", "first", "count"],
                    )

    return source.mapInArrow(run, f"anchor long, piece long, {PLACED}")


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of texts, each closed by an end mark of its own, with sampled run ends.

    Kept per run: where it starts, where its first row goes in an LF step, and of the suffix at its head the one before
    it in order and how far the two agree. Within a run, all bytes before the suffixes are equal, so their neighbours
    and agreements follow from those of the places one byte earlier: the same distance on, that many bytes less.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        n = int(sizes.sum()) + len(texts)
        symbols = np.empty(n, np.int64)
        marks = np.cumsum(sizes + 1) - 1
        inside = np.ones(n, bool)
        inside[marks] = False
        symbols[inside] = np.frombuffer(b"".join(texts), np.uint8)
        symbols[inside] += len(texts)
        symbols[marks] = np.arange(len(texts))
        self.n, self.sizes = n, sizes
        self.first = np.concatenate([[0], marks[:-1] + 1])
        order, ranks = self._suffixes(symbols)
        before = symbols[order - 1]
        head = np.ones(n, bool)
        head[1:] = before[1:] != before[:-1]
        self.start = np.flatnonzero(head)
        self.runs = len(self.start)
        size = np.diff(np.append(self.start, n))
        by = np.argsort(before[self.start], kind="stable")  # runs in order of their bytes: so their rows lie in the first column
        self.leads = np.empty(self.runs, np.int64)
        self.leads[by] = np.cumsum(size[by]) - size[by]
        place, self.neighbour = order[self.start], np.where(self.start > 0, order[self.start - 1], -1)
        self.agree = self._agreement([*[(1, symbols)] * (ranks[0][0] - 1), *ranks], place, self.neighbour, n)

    @staticmethod
    def _suffixes(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Order of all suffixes by prefix doubling, and the ranks by prefixes of 4, 8, 16 ... symbols."""
        n, span = len(symbols), 4
        bits = int(symbols.max()).bit_length() + 1 if n else 1
        while bits * span > 62:
            span //= 2
        padded = np.concatenate([symbols + 1, np.zeros(span, np.int64)])
        key = np.zeros(n, np.int64)
        for k in range(span):
            key = (key << bits) | padded[k : k + n]
        ranks, order = [], np.arange(n)
        while True:
            order = order[np.argsort(key[order], kind="stable")]  # in the order so far: what is sorted already costs one pass
            ordered = key[order]
            step = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) if n else ordered
            rank = np.empty(n, np.int64)
            rank[order] = step
            ranks.append((span, rank))
            if not n or step[-1] == n - 1:
                return order, ranks
            key = rank * (n + 1)
            key[:-span] += rank[span:] + 1
            span *= 2

    @staticmethod
    def _agreement(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """How many symbols the suffixes at a and b share, by spans from the longest to single symbols."""
        shared = np.zeros(len(a), np.int64)
        for span, rank in ranks[::-1]:
            x, y = a + shared, b + shared
            same = (b >= 0) & (x < n) & (y < n)
            same[same] = rank[x[same]] == rank[y[same]]
            shared[same] += span
        return shared

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place its neighbour in suffix order, and how many symbols both share.

        Every text is streamed from its end mark, whose row is the text's number, by LF steps over the runs, all texts in
        step; places whose row heads a run take the sample, the others go on from the place before them.
        """
        sample = np.full(self.n, -1, np.int64)
        order = np.argsort(-self.sizes, kind="stable")
        row, size = order.copy(), self.sizes[order]
        at = self.first[order] + size
        ending = np.searchsorted(-size, -np.arange(int(size.max(initial=0)) + 1), "right")  # texts of at least so many symbols
        for done in range(len(ending)):
            live = ending[done]
            run = np.searchsorted(self.start, row[:live], "right") - 1
            ahead = row[:live] - self.start[run]
            heads = ahead == 0
            sample[at[:live][heads] - done] = run[heads]
            row[:live] = self.leads[run] + ahead
        known = np.maximum.accumulate(np.where(sample >= 0, np.arange(self.n), 0))  # the first place of a text heads a run
        ahead, run = np.arange(self.n) - known, sample[known]
        return self.neighbour[run] + ahead, self.agree[run] - ahead

    def repeated(self, length: int) -> np.ndarray:
        """Places where at least ``length`` symbols begin that also begin elsewhere."""
        neighbour, shared = self.matching_statistics()
        hit = shared >= length
        out = hit.copy()
        out[neighbour[hit]] = True
        return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _mark_bucket(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a bucket are together; several small buckets share an index."""
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            texts = rows.column("text").to_pylist()
            count, doc, place = (np.asarray(rows.column(c)) for c in ("n", "doc", "first"))
            index = RunLengthIndex(texts)
            begin, end = _runs(index.repeated(length))
            which = np.searchsorted(index.first, begin, "right") - 1
            single = count[which] == 1  # others are wholly marked already
            begin, end, which = begin[single], end[single], which[single]
            first = place[which] + begin - index.first[which]
            yield pa.RecordBatch.from_arrays([pa.array(doc[which]), pa.array(first), pa.array(first + end - begin)], names=["doc", "first", "last"])

        size, now = 0, None
        for batch in batches:
            bucket = np.asarray(batch.column(0))
            cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                if held and bucket[a] != now and size >= BUCKET_BYTES // 2:
                    yield from flush(pa.Table.from_batches(held))
                    held, size = [], 0
                now = bucket[a]
                part = batch.slice(a, b - a)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("text"))).as_py()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, batch.schema.get_field_index("text"), BLOCK):
                block = TextBlock(part.column("text"))
                doc, first, count, times = (np.asarray(part.column(c)) for c in ("doc", "first", "count", "n"))
                text = np.repeat(np.arange(len(block)), count)
                turn = np.arange(len(text)) - np.repeat(np.cumsum(count, dtype=np.int64) - count, count)
                at = block.off[text] + turn
                raw = memoryview(block.buf.tobytes())
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a : a + length]) for a in at.tolist()), np.int64).reshape(-1, 2)
                both = [np.ascontiguousarray(d) for d in digests.T]
                yield pa.RecordBatch.from_arrays([*map(pa.array, both), pa.array(times[text]), pa.array(doc[text]), pa.array(first[text] + turn)], names=["w1", "w2", "n", "doc", "first"])

    return run


def _spans_of(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "first", (F.col("first") + F.col("count")).alias("last"))


def _in_buckets(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    """Marks of the pieces (bucket, n, doc, first, text), bucket by bucket."""
    rows = rows.select("bucket", "n", "doc", "first", "text").repartition(max(1, min(buckets, 4096)), "bucket").sortWithinPartitions("bucket", "doc", "first")
    return rows.mapInArrow(_mark_bucket(length), "doc long, first long, last long")


def _part_crowds(rows: DataFrame, seed: int, length: int, gram: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(marks, what is still crowded): pieces of crowded anchors cut by one more anchor each, as on the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, batch.schema.get_field_index("text"), BLOCK):
                block = TextBlock(part.column("text"))
                above, n, doc, place = (np.asarray(part.column(c)) for c in ("anchor", "n", "doc", "first"))
                text, first, count, anchor, piece = pieces(block.buf, block.off, length, gram, seed)
                at, stop = block.off[text] + first, block.off[text] + first + count - 1 + length
                joint = _mix(above[text].view(np.uint64) * np.uint64(BASES[1]) + anchor.view(np.uint64)).view(np.int64)
                cut = [block.buf[a:b].tobytes() for a, b in zip(at.tolist(), stop.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, (joint, piece, n[text], doc[text], place[text] + first, count.astype(np.int32))), pa.array(cut, pa.binary())],
                    names=["anchor", "piece", "n", "doc", "first", "count", "text"],
                )

    cut = written(rows.mapInArrow(run, f"anchor long, piece long, n long, {PLACED}, text binary"), "cut-crowds")
    different = cut.groupBy("anchor", "piece").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "first", "count", "text")).alias("at"))
    different = written(different.select("anchor", "piece", "n", "at.*"), "different-crowds")
    whole = cut.where("n = 1").join(different.where("n > 1").select("anchor", "piece"), ["anchor", "piece"], "left_semi")
    whole = written(_spans_of(whole), "whole-crowds")
    forget(cut)
    sizes = different.groupBy("anchor").agg(F.count("*").alias("__m")).where("__m > 1")
    sized = written(different.join(sizes, "anchor"), "sized-crowds")
    forget(different)
    buckets = max(1, sized.count() * (length + 40) // BUCKET_BYTES)
    small = sized.where(F.col("__m") <= group).withColumn("bucket", F.pmod("anchor", F.lit(buckets)))
    left = sized.where(F.col("__m") > group).select("anchor", "n", "doc", "first", "count", "text")
    return whole.union(_in_buckets(small, buckets, length)), left


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, spans): for each document with any, the windows that also start elsewhere, as runs (first, last + 1).

    ``id_col`` holds a long that is unique and not null (see :func:`remove_repeats`). The texts are scanned once; marks found by
    a join are written by themselves, so that a key with very many rows is a skewed join that the adaptive planner splits.
    """
    if not 1 <= gram <= length or length > 1 << 20:
        raise ValueError("gram is from 1 to length, length up to 2^20 bytes")
    found = written(_scan(docs, id_col, text_col, length, gram), "found")
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("piece").alias("lo"), F.max("piece").alias("hi"))
    anchors = written(anchors.where("n > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("equal")), "anchors")
    met = written(found.join(anchors, "anchor"), "met")
    forget(found, anchors)
    mixed = met.where("not equal")
    different = mixed.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first", "count")).alias("at"))
    different = written(different.select("anchor", "piece", "n", "at.*"), "different")
    often = mixed.join(different.where("n > 1").select("anchor", "piece"), ["anchor", "piece"], "left_semi")
    marks = written(_spans_of(met.where("equal")).union(_spans_of(often)), "whole")
    forget(met)

    crowded = different.groupBy("anchor").agg(F.count("*").alias("__m")).where(F.col("__m") > group).select("anchor", F.lit(True).alias("crowded"))
    wanted = different.join(crowded, "anchor", "left")
    size = max(1, different.count() * (length + 80) // BUCKET_BYTES)
    per_doc = wanted.groupBy("doc").agg(
        F.collect_list(F.struct("first", "count", "n", F.coalesce("crowded", F.lit(False)).alias("crowded"), F.pmod("anchor", F.lit(size)).alias("bucket"))).alias("cuts")
    )
    texts = docs.select(F.col(id_col).alias("doc"), F.encode(F.col(text_col), "UTF-8").alias("raw"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            docs_, raws, lists = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            for i, doc in enumerate(docs_):
                raw = raws[i].as_py()
                for c in lists[i].as_py():
                    row = (c["bucket"], c["crowded"], c["n"], doc, c["first"], c["count"], raw[c["first"] : c["first"] + c["count"] - 1 + length])
                    for column, x in zip(out, row):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["bucket", "crowded", "n", "doc", "first", "count", "text"])

    got = texts.join(per_doc, "doc").select("doc", "raw", "cuts")
    got = written(got.mapInArrow(cut, f"bucket long, crowded boolean, n long, {PLACED}, text binary"), "pieces")
    forget(different)

    marks = marks.union(_in_buckets(got.where("not crowded"), size, length))
    rest = got.where("crowded").select(F.lit(0).cast("long").alias("anchor"), "n", "doc", "first", "count", "text")
    for seed in SEEDS:
        if rest.isEmpty():
            break
        more, rest = _part_crowds(rest, seed, length, gram, group)
        marks = marks.union(more)
    else:
        windows = rest.select("n", "doc", "first", "count", "text").mapInArrow(_window_hashes(length), "w1 long, w2 long, n long, doc long, first long")
        windows = written(windows, "windows")
        often = windows.groupBy("w1", "w2").agg(F.sum("n").alias("all")).where("all > 1").select("w1", "w2")
        counted = windows.where("n = 1").join(often, ["w1", "w2"], "left_semi").select("doc", "first", (F.col("first") + 1).alias("last"))
        marks = marks.union(written(counted, "counted"))
        forget(windows)
    return marks.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per document ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` after removal of repeated passages (UTF-8 bytes).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in this document or
    another; strings are judged on the input. With ``with_text``, ``kept`` holds the bytes that stay.
    Null or empty text: 0 bytes. Where ids repeat or are null, the rows get numbers in a written copy of the
    table, so repeated rows count as copies of each other and each gets its row.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, ids = source.agg(F.count("*"), F.count_distinct("id")).first()
    if isinstance(source.schema["id"].dataType, T.LongType) and rows == ids:
        source = source.withColumn("row", F.col("id"))
    else:
        source = written(source.withColumn("row", F.monotonically_increasing_id()), "numbered")
    spans = find_repeats(source, length, gram, group, "row", "text")
    joined = source.join(spans.withColumnRenamed("doc", "row"), "row", "left")
    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ] + [T.StructField("kept", T.BinaryType())] * with_text

    def compute(block: TextBlock, part: pa.RecordBatch) -> list:
        at = part.schema.get_field_index("spans")
        out: list[list] = [[] for _ in fields]
        for raw, marks in zip(block.raw(), part.column(at)):
            removed = runs = 0
            kept = raw
            if marks.is_valid:
                flat = marks.values.flatten()
                first, last = (np.asarray(x) for x in flat)
                depth = np.zeros(len(raw) + 1, np.int32)
                np.add.at(depth, first, 1)
                np.add.at(depth, last - 1 + length, -1)
                gone = np.cumsum(depth[:-1]) > 0
                begin, _ = _runs(gone)
                removed, runs = int(gone.sum()), len(begin)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            row = (len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept)
            for column, x in zip(out, row):
                column.append(x)
        return out

    marked = annotate(joined, compute, fields, "text", keep=["id", "spans"], with_rows=True)
    return marked.select(F.col("id").alias(id_col), *[f.name for f in fields])
