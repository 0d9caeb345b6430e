"""Benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

import functools
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TextBlock, Words, annotate, forget, written

BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
STEPS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
WORD_BITS = 20
PART_BYTES = 2 << 20  # item text of one automaton
PASS_BYTES = 160 << 20  # automata of one pass over the documents


class Automaton:
    """Suffix automaton over word numbers of several items; a state stands for word sequences with the same ends.

    It is built online; a state's first edge lies in flat arrays, only states with more have a dictionary. Then all is
    frozen into 32-bit arrays: suffix links, lengths, edges sorted by state and word, and per state the windows that end
    there with the items that hold them. Words are known by a 64-bit hash and compared byte by byte.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        numbers: dict[bytes, int] = {}
        names: dict[str | None, int] = {}
        self._link, self._length, self._one, self._to = (array("i", [x]) for x in (-1, 0, -1, -1))
        self._more: dict[int, dict[int, int]] = {}
        sequences = []
        for item, words in items:
            if words:
                sequence = array("i", [numbers.setdefault(w, len(numbers)) for w in words])
                sequences.append((names.setdefault(item, len(names)), sequence))
                last = 0
                for c in sequence:
                    last = self._extend(last, c)
        self.names = list(names)
        self.least = min((min(window, len(s)) for _, s in sequences), default=0)
        self.grams = min(3, self.least)
        self._keep_words(list(numbers))
        self._filter([s for _, s in sequences])
        del numbers
        ends = self._window_ends(sequences)
        del sequences
        self._freeze(*ends)

    def _after(self, state: int, c: int) -> int:
        if self._one[state] == c:
            return self._to[state]
        more = self._more.get(state)
        return -1 if more is None else more.get(c, -1)

    def _lead(self, state: int, c: int, to: int) -> None:
        if self._one[state] in (-1, c):
            self._one[state], self._to[state] = c, to
        else:
            self._more.setdefault(state, {})[c] = to

    def _new(self, length: int, link: int, like: int = -1) -> int:
        state = len(self._link)
        self._length.append(length)
        self._link.append(link)
        self._one.append(self._one[like] if like >= 0 else -1)
        self._to.append(self._to[like] if like >= 0 else -1)
        if like in self._more:
            self._more[state] = dict(self._more[like])
        return state

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the longest sequence of p and c, when q also holds longer ones."""
        if self._length[q] == self._length[p] + 1:
            return q
        twin = self._new(self._length[p] + 1, self._link[q], q)
        self._link[q] = twin
        while p >= 0 and self._after(p, c) == q:
            self._lead(p, c, twin)
            p = self._link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if (q := self._after(last, c)) >= 0:
            return self._split(last, c, q)
        state, p = self._new(self._length[last] + 1, 0), last
        while p >= 0 and (q := self._after(p, c)) < 0:
            self._lead(p, c, state)
            p = self._link[p]
        if p >= 0:
            self._link[state] = self._split(p, c, q)
        return state

    def _window_ends(self, sequences: list[tuple[int, array]]) -> tuple[array, array, array]:
        """(state, window size, item) for each place of an item where a window ends."""
        at, size, item = array("i"), array("i"), array("i")
        link, length = self._link, self._length
        for name, sequence in sequences:
            n, state = min(self.window, len(sequence)), 0
            for i, c in enumerate(sequence):
                state = self._after(state, c)
                while state and length[link[state]] >= n:  # the last n words are enough to go on with
                    state = link[state]
                if i + 1 >= n:
                    at.append(state)
                    size.append(n)
                    item.append(name)
        return at, size, item

    def _freeze(self, at: array, size: array, item: array) -> None:
        link, length, one, to = (np.array(x, np.int32) for x in (self._link, self._length, self._one, self._to))
        first = np.flatnonzero(one >= 0).astype(np.int32)
        extra = sum(map(len, self._more.values()))
        state = np.concatenate([first, np.fromiter((s for s, m in self._more.items() for _ in m), np.int32, extra)])
        label = np.concatenate([one[first], np.fromiter((c for m in self._more.values() for c in m), np.int32, extra)])
        target = np.concatenate([to[first], np.fromiter((t for m in self._more.values() for t in m.values()), np.int32, extra)])
        del self._more, self._one, self._to, self._link, self._length
        order = np.lexsort((label, state))
        self.label, self.target = label[order], target[order]
        self.edges = np.searchsorted(state[order], np.arange(len(link) + 1)).astype(np.int32)
        self.link, self.length = link, length
        link[0] = 0
        rows = np.stack([np.array(x, np.int32) for x in (at, size, item)], axis=1)
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])] if len(rows) else rows
        head = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
        groups = np.flatnonzero(head)
        self.items = rows[:, 2].copy()
        self.group_size = rows[groups, 1].copy()
        self.group_first = np.append(groups, len(rows)).astype(np.int32)
        self.groups = np.searchsorted(rows[groups, 0], np.arange(len(link) + 1)).astype(np.int32)
        own = self.groups[1:] > self.groups[:-1]
        near = np.where(own, np.arange(len(link)), link).astype(np.int32)  # itself or the nearest suffix at which a window ends
        near[0] = 0
        while (near != near[near]).any():
            near = near[near]
        self.near = near

    def _keep_words(self, words: list[bytes]) -> None:
        joined = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size + 1) - size - 1
        self.word_hash = word_hashes(joined, start, start + size)
        order = np.argsort(self.word_hash, kind="stable")
        self.sorted_hash, self.by_hash = self.word_hash[order], order.astype(np.int32)
        self.spelled, self.word_start = joined, np.append(start, len(joined)).astype(np.int64)

    def _filter(self, sequences: list[array]) -> None:
        grams = sum(map(len, sequences))
        self.gram_bits = max(WORD_BITS, (8 * grams).bit_length())
        self.word_filter, self.gram_filter = np.zeros(1 << WORD_BITS, bool), np.zeros(1 << self.gram_bits, bool)
        if self.grams:
            self.word_filter[slot(self.word_hash, WORD_BITS)] = True
            for sequence in sequences:
                self.gram_filter[slot(gram_hashes(self.word_hash[np.array(sequence, np.int32)], self.grams), self.gram_bits)] = True
        del self.word_hash

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def numbers_of(self, hashes: np.ndarray, words: list[bytes]) -> list[int]:
        """Number of each word, -1 for one that no item has."""
        at = np.minimum(np.searchsorted(self.sorted_hash, hashes), len(self.sorted_hash) - 1)
        out = np.where(self.sorted_hash[at] == hashes, self.by_hash[at], -1).tolist()
        spelled, start = self.spelled, self.word_start
        return [c if c >= 0 and spelled[start[c] : start[c + 1] - 1].tobytes() == w else -1 for c, w in zip(out, words)]

    def _views(self) -> tuple[memoryview, ...]:
        if not hasattr(self, "_seen"):
            self._seen = tuple(memoryview(x) for x in (self.link, self.length, self.edges, self.label, self.target, self.near, self.groups, self.group_size, self.group_first, self.items))
        return self._seen

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_seen"}

    def follow(self, numbers: list[int]):
        """Streams word numbers; yields (first word, last word + 1, item numbers) for each window that ends at a word."""
        link, length, edges, label, target, near, groups, group_size, group_first, items = self._views()
        state = size = 0
        window = self.window
        for i, c in enumerate(numbers):
            if c < 0:
                state = size = 0
                continue
            while True:
                lo, hi = edges[state], edges[state + 1]
                e = lo if hi - lo == 1 else bisect_left(label, c, lo, hi)
                if e < hi and label[e] == c:
                    state, size = target[e], size + 1
                    break
                if not state:
                    break
                state = link[state]
                size = length[state]
            while length[link[state]] >= window:
                state = link[state]
            size = min(size, length[state])
            at = near[state]
            while at:
                for g in range(groups[at], groups[at + 1]):
                    n = group_size[g]
                    if n <= size:
                        yield i + 1 - n, i + 1, items[group_first[g] : group_first[g + 1]]
                at = near[link[at]]


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power = np.cumprod(np.full(n, BASE, np.uint64))
    inverse = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))
    return power, inverse


def word_hashes(norm: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial of each word's bytes; equal words have equal values."""
    power, inverse = _powers(1 << max(20, int(len(norm)).bit_length()))
    total = np.zeros(len(norm) + 1, np.uint64)
    np.cumsum(norm * power[: len(norm)], out=total[1:])
    return (total[end] - total[start]) * inverse[start]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    m = max(0, len(h) - n + 1)
    return sum((h[k : k + m] * STEPS[k] for k in range(n)), np.zeros(m, np.uint64))


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * MIX) >> np.uint64(64 - bits)


def _match(words: Words, h: np.ndarray, automaton: Automaton) -> list[list[tuple[int, int, memoryview]]]:
    """Windows found in each text of the block, as (first word, last word + 1, item numbers), words from 0 in the text.

    Any window lies inside a run of words whose overlapping word triples all occur in items; only such
    runs, found by arrays and bitmaps (which never miss one), go through the automaton with their words.
    """
    out: list[list] = [[] for _ in words.base]
    g, least = automaton.grams, automaton.least
    if not g or len(words.start) < least:
        return out
    mask = automaton.gram_filter[slot(gram_hashes(h, g), automaton.gram_bits)]
    known = automaton.word_filter[slot(h, WORD_BITS)]
    for k in range(g):
        mask &= known[k : k + len(mask)]
    for k in range(1, g):  # a triple never spans two texts
        across = words.first[1:-1] - k
        mask[across[(across >= 0) & (across < len(mask))]] = False
    begins = np.zeros(len(words.start) + 1, bool)  # a run ends with its text, also where a single word is a window
    begins[words.first] = True
    first = np.flatnonzero(mask & (begins[: len(mask)] | ~np.concatenate([[False], mask[:-1]])))
    last = np.flatnonzero(mask & (begins[1 : len(mask) + 1] | ~np.concatenate([mask[1:], [False]]))) + 1
    long = last - first >= least - g + 1
    norm, start, end = words.norm, words.start, words.end
    for a, b in zip(first[long].tolist(), (last[long] + g - 1).tolist()):
        text = int(np.searchsorted(words.first, a, "right")) - 1
        base = int(words.first[text])
        run = [norm[s:e].tobytes() for s, e in zip(start[a:b].tolist(), end[a:b].tolist())]
        out[text] += [(a - base + i, a - base + j, ids) for i, j, ids in automaton.follow(automaton.numbers_of(h[a:b], run))]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
STRINGS = T.ArrayType(T.StringType())


def _spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
    flat = [x for r in rows for x in r]
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array([{"start": a, "end": b} for a, b in flat], kind))


def _passes(items: DataFrame, window: int, part_bytes: int, pass_bytes: int) -> list:
    """Broadcast lists of automata; a list takes about ``pass_bytes`` at most, an automaton holds about ``part_bytes`` of item text."""
    spark = items.sparkSession
    texts = written(items.groupBy("text").agg(F.collect_set("id").alias("ids")), "items")  # a text's ids stay together, however many they are
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    if parts > 1:  # a file a part, so that each is read by itself
        dealt = texts.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts))).repartitionByRange(min(parts, 1000), "part")
        forget_after, texts = texts, written(dealt.sortWithinPartitions("part"), "item-parts")
        forget(forget_after)
    out, held = [], []
    for k in range(parts):
        part = texts if parts == 1 else texts.where(F.col("part") == k)
        ids, texts_of = [], []
        for r in part.collect():  # one part, at most about ``part_bytes`` and its ids
            ids.append(tuple(r["ids"]))
            texts_of.append(r["text"])
        words = Words(TextBlock(pa.array(texts_of, pa.string())))
        cut = [words.norm[a:b].tobytes() for a, b in zip(words.start.tolist(), words.end.tolist())]
        made = Automaton([(i, cut[words.first[k] : words.first[k + 1]]) for k, i in enumerate(ids)], window)
        if held and sum(a.nbytes() for a in [*held, made]) > pass_bytes:
            out.append(spark.sparkContext.broadcast(held))
            held = []
        held.append(made)
    forget(texts)
    return [*out, spark.sparkContext.broadcast(held)]


def _scan(docs: DataFrame, items: DataFrame, window: int, text_col: str, keep: list[str], how: dict, fields: list[T.StructField], finish) -> DataFrame:
    """``docs`` with what ``finish(texts, words, spans, ids)`` makes of the hits: merged runs of words and sorted item ids of each text.

    One pass over the documents, and one more for each further list of automata, which hands its hits on in two columns.
    """
    how = {"item_id": "item_id", "item_text": "text", "part_bytes": PART_BYTES, "pass_bytes": PASS_BYTES} | how
    items = items.select(F.col(how["item_id"]).cast("string").alias("id"), F.col(how["item_text"]).cast("string").alias("text"))
    passes = _passes(items, window, how["part_bytes"], how["pass_bytes"])
    out, handed = docs, []
    for k, automata in enumerate(passes):
        final = k == len(passes) - 1

        def compute(block: TextBlock, part: pa.RecordBatch, automata=automata, final=final, handed=handed) -> list:
            words = Words(block)
            h = word_hashes(words.norm, words.start, words.end)
            spans, ids = [[] for _ in range(len(block))], [set() for _ in range(len(block))]
            if handed:
                spans = [[(s["start"], s["end"]) for s in row] for row in part.column(handed[0]).to_pylist()]
                ids = [set(row) for row in part.column(handed[1]).to_pylist()]
            for automaton in automata.value:
                for i, found in enumerate(_match(words, h, automaton)):
                    if found:
                        spans[i] += [(a, b) for a, b, _ in found]
                        ids[i].update(*(automaton.names[x] for _, _, own in found for x in own))
            spans, ids = [merged(s) for s in spans], [sorted(x - {None}) for x in ids]
            return finish(block, words, spans, ids) if final else [_spans(spans), pa.array(ids, pa.list_(pa.string()))]

        made = fields if final else [T.StructField(f"__spans{k}", SPAN), T.StructField(f"__items{k}", STRINGS)]
        carried = list(dict.fromkeys([*keep, *([] if final else [text_col]), *handed]))
        out = annotate(out, compute, made, text_col, keep=carried, with_rows=True).drop(*(handed if final else []))
        handed = [f.name for f in made]
    return out


def find_items(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", keep: list[str] | None = None, **how) -> DataFrame:
    """Adds to each document what it shares with test items; one pass over the documents, no shuffle.

    ``n_words``; ``n_hit``, words inside any occurrence of a window (``window`` consecutive item words; a
    shorter item is one window); ``n_items`` and ``item_ids`` (sorted as strings), items with occurring
    windows; ``hit_spans``, maximal hit runs of words; ``hit_bytes``, the same in bytes of the text.

    The automata are broadcast. Items are dealt by a hash of their texts into parts of about ``part_bytes`` (2 MB), one
    automaton each (ten times its text in memory); automata of more than ``pass_bytes`` (160 MB) in all make further passes. Each Python worker
    holds the automata of one pass: an executor with four workers takes four times ``pass_bytes`` at most. Ids of one text are held together, once.
    ``item_id`` and ``item_text`` in ``how`` name the columns of ``items``. Null or
    empty texts have no words; items without words have no window; an item with a null id hits but is not
    listed. Repeated item rows count once, repeated documents each get their row. Input columns named like a result, in any case, are replaced.
    """
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
        T.StructField("item_ids", STRINGS), T.StructField("hit_spans", SPAN), T.StructField("hit_bytes", SPAN),
    ]

    def finish(block: TextBlock, words: Words, spans: list, ids: list) -> list:
        hit = [sum(b - a for a, b in s) for s in spans]
        return [np.diff(words.first), hit, [len(x) for x in ids], pa.array(ids, pa.list_(pa.string())), _spans(spans), _spans(_in_bytes(words, spans))]

    return _scan(docs, items, window, text_col, docs.columns if keep is None else keep, how, fields, finish)


def _in_bytes(words: Words, spans: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Runs of words of each text as places in its bytes."""
    first, base = words.first, words.base
    return [[(int(words.start[first[i] + a] - base[i]), int(words.end[first[i] + b - 1] - base[i])) for a, b in s] for i, s in enumerate(spans)]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", **how) -> DataFrame:
    """Documents with the passages of test items cut out; those covered by more than ``max_coverage`` of their words go.

    Found, cut and dropped in the same pass; see :func:`find_items` for ``how``. Columns and their order stay.
    """
    columns = docs.columns
    fields = [T.StructField(text_col, T.StringType()), T.StructField("__covered", T.BooleanType())]

    def finish(block: TextBlock, words: Words, spans: list, ids: list) -> list:
        n, out, covered = np.diff(words.first).tolist(), [], []
        for i, (raw, null, cuts) in enumerate(zip(block.raw(), block.null.tolist(), _in_bytes(words, spans))):
            covered.append(sum(b - a for a, b in spans[i]) > n[i] * max_coverage)
            at, kept = 0, []
            for a, b in cuts:
                kept.append(raw[at:a])
                at = b
            out.append(None if null else b"".join([*kept, raw[at:]]).decode())
        return [pa.array(out, pa.string()), covered]

    found = _scan(docs, items, window, text_col, columns, how, fields, finish)
    return found.where("not __covered").select(*[F.col(f"`{c}`") for c in columns])
