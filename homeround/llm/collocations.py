"""Phrases whose words stand together more often than chance, counted from longest windows alone.

Each word begins one window of the longest length, padded where its piece of text ends. Windows are counted, and Spark's ROLLUP sums
those counts over ever shorter prefixes, which are all the n-grams of the corpus, so no n-gram of another length is ever emitted. A
window is also padded where no phrase that is frequent enough can go on: a first pass counts words and pairs of words into a fixed
number of counters by hash, a second one the longer grams all of whose pairs may be frequent, and a counter never holds less than what
it counts, so what has a counter below the threshold is surely rare. What is dropped from windows is thus in no candidate and in no part of
one; all words still count in their language's total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TextBlock, blocks, trim, written

#: log2 of the counters of words and pairs, and of those in a chunk. A counter takes one bit of what is broadcast: 16 MB, whatever the corpus.
COUNTER_BITS, CHUNK_BITS = 27, 16
BLOCK = 2_000_000

_KIND = np.full(256, 2, np.uint8)  # 2 word, 1 end of a piece, 0 white space
_KIND[[0x20, 0x09]] = 0
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class BlockWords:
    """Words of a block: ``ids`` in ``names`` (distinct (language, word)); ``joined``: whether the next word follows in the same piece."""

    def __init__(self, texts: TextBlock, langs: pa.Array):
        n = len(texts)
        joined = np.frombuffer(b"\n".join([*texts.raw(), b""]), np.uint8)
        kind = _KIND[joined]
        inside = kind == 2
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        packed = _LOWER[joined[inside]]
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        piece = np.searchsorted(np.flatnonzero(kind == 1), start)
        self.joined = np.append(piece[1:] == piece[:-1], False)[: len(start)]
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        text = np.searchsorted(texts.off[:-1] + np.arange(n), start, "right") - 1
        lang = coded.indices.to_numpy()[text].astype(np.int64)
        # (language, word) numbered densely
        both = lang * max(len(words.dictionary), 1) + words.indices.to_numpy()
        distinct, self.ids = np.unique(both, return_inverse=True)
        self.lang = distinct // max(len(words.dictionary), 1)
        self.word = words.dictionary.take(pa.array(distinct % max(len(words.dictionary), 1)))
        self.count = np.bincount(self.ids, minlength=len(distinct))

    def hashes(self) -> np.ndarray:
        """One of each distinct word."""
        seeds = [xxhash.xxh64_intdigest(x, 1) for x in self.langs]
        return np.fromiter((xxhash.xxh64_intdigest(w, seeds[k]) for w, k in zip(self.word.to_pylist(), self.lang.tolist())), np.uint64, len(self.lang))

    def grams(self, hashes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
        """Hashes of the grams of 2, 3 .. ``longest`` words that begin at each place (meant where the words are in one piece)."""
        here = gram = hashes[self.ids]
        for k in range(1, longest):
            gram = gram * _ODD[0] + _ahead(here, k)
            gram = (gram ^ gram >> np.uint64(32)) * _ODD[1]
            yield gram


def _ahead(values: np.ndarray, k: int) -> np.ndarray:
    """What stands ``k`` places on; zero past the end."""
    return np.append(values[k:], np.zeros(min(k, len(values)), values.dtype))


class Slots:
    """Which of 2^``bits`` counters, found by hash, reached the threshold."""

    def __init__(self, reached: bytes, bits: int):
        self.reached, self.shift = np.frombuffer(reached, np.uint8), np.uint64(64 - bits)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> self.shift
        return (self.reached[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _alive(words: BlockWords, hashes: np.ndarray, pair: np.ndarray, frequent: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Places whose word may be frequent, and those whose pair with the next word may be."""
    known = frequent[hashes][words.ids]
    on = words.joined & known & _ahead(known, 1)
    on[on] = frequent[pair[on]]
    return known, on


def _lang(docs: DataFrame, lang_col: str) -> Column:
    return F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[BlockWords]:
    for batch in batches:
        for part in blocks(batch, 0, BLOCK):
            yield BlockWords(TextBlock(part.column(0)), part.column(1))
        trim()


def _merged(slots: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal slots summed up to 65,535, by slot."""
    slot, count = np.concatenate(slots), np.concatenate(counts)
    order = np.argsort(slot, kind="stable")
    slot, count = slot[order], count[order]
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
    return slot[first], np.minimum(np.add.reduceat(count, first), 65_535) if len(slot) else count


def frequent_slots(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang", bits: int = COUNTER_BITS, longest: int = 2, pairs=None) -> bytes:
    """One bit for each of 2^``bits`` counters: whether it reached ``least`` (at most 65,535) over all words and pairs of the corpus.

    Given such bits as broadcast ``pairs``: over its grams of 3 to ``longest`` words all of whose words and pairs may be frequent.

    Tasks send the counters they used, chunk by chunk; chunks are summed as a sorted stream, one dense chunk at a time. The driver gets
    2^``bits`` bits.
    """
    chunk_bits = min(CHUNK_BITS, bits)
    schema = "chunk int, slots binary, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            slot, number = _merged(slots, counts)
            chunk = slot >> chunk_bits
            edges = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(slot)) if len(slot) else np.zeros(1, int)
            low = (slot & (1 << chunk_bits) - 1).astype(np.uint16)
            number = number.astype(np.uint16)
            columns = chunk[edges[:-1]].astype(np.int32), *([x[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:])] for x in (low, number))
            for k in range(0, len(edges) - 1, 512):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 512], t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "slots", "counts"])

        held = 0
        shift = np.uint64(64 - bits)
        for words in _read(batches):
            hashes = words.hashes()
            grams = words.grams(hashes, longest)
            first = next(grams)
            if pairs is None:
                slots.append((hashes >> shift).astype(np.int64))
                counts.append(words.count)
                taken = [first[words.joined]]
            else:
                on = going = _alive(words, hashes, first, Slots(pairs.value, bits))[1]
                taken = []
                for k, gram in enumerate(grams, 1):
                    going = going & _ahead(on, k)
                    taken.append(gram[going])
            slot, number = np.unique((np.concatenate(taken) >> shift).astype(np.int64), return_counts=True)
            slots.append(slot)
            counts.append(number)
            held += sum(map(len, slots[-2:]))
            if held > 4_000_000:
                slots[:], counts[:] = [[x] for x in _merged(slots, counts)]
                held = len(slots[0])
                if held > 3_000_000:
                    yield from flush()
                    slots.clear()
                    counts.clear()
                    held = 0
        if slots:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bits_of(chunk: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

        at, total = None, np.zeros(1 << chunk_bits, np.int64)
        for batch in batches:
            for chunk, slot, number in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != at:
                    if at is not None:
                        yield bits_of(at, total)
                    at, total = chunk, np.zeros(1 << chunk_bits, np.int64)
                total[np.frombuffer(slot, np.uint16)] += np.frombuffer(number, np.uint16)
        if at is not None:
            yield bits_of(at, total)

    sent = docs.select(F.col(f"`{text_col}`").cast("string"), _lang(docs, lang_col)).mapInArrow(count, schema)
    summed = sent.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, bits binary")
    out = np.zeros((1 << bits - chunk_bits, max(1, 1 << chunk_bits >> 3)), np.uint8)
    for row in summed.collect():  # 2^bits bits in all
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def longest_windows(docs: DataFrame, least: int, longest: int = 5, text_col: str = "text", lang_col: str = "lang", bits: int = COUNTER_BITS) -> DataFrame:
    """(lang, w1 .. w``longest``, n): how often each padded window of lead words occurs; w1 is null for words that are surely rare."""
    spark = docs.sparkSession
    sent = docs, least, text_col, lang_col, bits
    frequent = spark.sparkContext.broadcast(frequent_slots(*sent))
    longer = spark.sparkContext.broadcast(frequent_slots(*sent, longest, frequent) if longest > 2 else b"")
    names = ["lang", *(f"w{k}" for k in range(1, longest + 1)), "n"]
    schema = T.StructType([T.StructField(n, T.LongType() if n == "n" else T.StringType()) for n in names])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rest = Slots(frequent.value, bits), Slots(longer.value, bits)
        for words in _read(batches):
            hashes = words.hashes()
            grams = words.grams(hashes, longest)
            known, on = _alive(words, hashes, next(grams, hashes), first)
            # lead columns: the next words as far as the window goes on; 0 pads
            columns = [np.where(known, words.ids + 1, 0)]
            going = on
            for k in range(1, longest):
                if k > 1:
                    going = going & _ahead(on, k - 1)
                    going[going] = rest[next(grams)[going]]
                columns.append(np.where(going, _ahead(columns[0], k), 0))
            alone = columns[1] == 0 if longest > 1 else np.ones(len(known), bool)
            lang_of = words.lang[words.ids]
            # windows of one word, then those of more
            one = np.bincount(columns[0][alone], minlength=len(hashes) + 1)
            rare = np.bincount(lang_of[alone & ~known], minlength=len(words.langs))
            rows = np.stack([c[~alone] for c in columns], 1)
            several, n = np.unique(rows, axis=0, return_counts=True) if len(rows) else (np.zeros((0, longest), np.int64), np.zeros(0, np.int64))
            ones, kinds = np.flatnonzero(one[1:]), np.flatnonzero(rare)
            pad = np.zeros((len(ones) + len(kinds), longest), np.int64)
            pad[: len(ones), 0] = ones + 1
            table = np.concatenate([several, pad])
            lang = np.concatenate([words.lang[several[:, 0] - 1], words.lang[ones], kinds])
            n = np.concatenate([n, one[1:][ones], rare[kinds]])
            take = lambda values, at, none: values.take(pa.array(at, pa.int64(), mask=none))
            text = words.word.cast(pa.string())
            arrays = [take(pa.array(words.langs, pa.string()), lang, None), *(take(text, c - 1, c == 0) for c in table.T), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    source = docs.select(F.col(f"`{text_col}`").cast("string"), _lang(docs, lang_col))
    return source.mapInArrow(emit, schema).groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def phrase_counts(windows: DataFrame, least: int, longest: int = 5) -> DataFrame:
    """(lang, size, phrase, f) of all phrases that occur ``least`` times or more; size 0 is a language's number of words, however small."""
    w = [f"w{k}" for k in range(1, longest + 1)]
    size = longest - F.bit_count(F.grouping_id())  # columns rolled up
    rolled = windows.rollup("lang", *w).agg(F.sum("n").alias("f"), size.alias("size"))
    last = F.when(F.col("size") == 0, F.lit(""))
    for k, name in enumerate(w, 1):
        last = last.when(F.col("size") == k, F.col(name))
    kept = (F.col("lang").isNotNull()) & last.isNotNull() & ((F.col("size") == 0) | (F.col("f") >= least))
    return rolled.where(kept).select("lang", "size", F.concat_ws(" ", *w).alias("phrase"), "f")


def score_phrases(counts: DataFrame, top: int = 2000, longest: int = 5, cover: int = 100) -> DataFrame:
    """Rows lang, rank, phrase, a, l, r, n, score of each language's first ``top`` collocations, from a written :func:`phrase_counts`.

    A phrase scores by its weakest cut: floor(1000 a n / (l r)), ties to the earliest cut. Phrases inside a longer one that has at
    least ``cover`` percent of their count are left out. Products are decimals of 38 digits.
    """
    big = lambda c: F.col(c).cast("decimal(19,0)")
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    phrases = counts.where("size > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ", -1)
    candidates = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), words.alias("w"))
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    sides = lambda side, f: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(sides("left", "l"), ["lang", "left"]).join(sides("right", "r"), ["lang", "right"]).join(total, "lang")
    # two steps: 1000 a n can pass 38 digits only where a n passes 35
    score = F.expr("(CAST(a AS decimal(19,0)) * CAST(n AS decimal(16,0)) * 1000BD) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))")
    cuts = cuts.withColumn("score", score)
    weakest = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("c"))
    inner = candidates.where("size > 2").select(
        "lang", F.col("a").alias("longer"),
        F.explode(F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), s -> array_join(slice(w, s, m), ' '))))")).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = weakest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (big("longer") * 100 < F.lit(cover) * F.col("c.a").cast("decimal(19,0)")))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("c.a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(f"c.{x}").alias(x) for x in ("a", "l", "r", "n", "score")])


def mine(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = 5, text_col: str = "text", lang_col: str = "lang", bits: int = COUNTER_BITS, cover: int = 100) -> DataFrame:
    """Each language's first collocations of 2 to ``longest`` words that occur ``least`` times or more.

    A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and line breaks, words at spaces and tabs. Null text counts as empty, null language as
    ``und``. Repeated rows count each time. Ties in score go to the more frequent, then to the smaller phrase in bytes. Empty table:
    empty result. Other columns are not read.
    """
    counts = written(phrase_counts(longest_windows(docs, least, longest, text_col, lang_col, bits), least, longest), "phrases")
    return score_phrases(counts, top, longest, cover)
