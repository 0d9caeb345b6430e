"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in the corpus.

Both token sequences of a text are arrays of byte ends. Where both go on one to one, the arrays agree at one shift of their indices: probes
of doubling length compare them there and jump the stretch. Where they part, the two ends are walked until they meet again, which gives
the group, its links and the next shift.

Links are counted per document and pair of ids. A task keeps one list of distinct pairs for each few megabytes of text, with the
documents that hold each, so what is shuffled to count pairs and to bring counts back is a row for each pair of a block, not of a document.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, pieces
from .common import TextBlock, annotate

BLOCK = 4_000_000
LONGS = pa.list_(pa.field("element", pa.int64()))


def diagonal_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of two arrays of byte ends (32-bit, rising, equal in the last).

    Returns rows: one-to-one stretches (first index of a, first of b, length); the links (index of a, index of b) of the other groups;
    and the indices after those groups. A probe reads both stretches as whole numbers, whose lowest differing bit gives the place.
    """
    a, b = ends_a.tobytes(), ends_b.tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    n = len(list_a)
    runs, links, groups = array("i"), array("i"), array("i")
    run, link, group, number = runs.extend, links.extend, groups.extend, int.from_bytes
    i = j = 0
    while i < n:
        p, q = list_a[i], list_b[j]
        if p == q:
            x, y, step = 4 * i + 4, 4 * j + 4, 48
            while not (differ := number(a[x : x + step], "little") ^ number(b[y : y + step], "little")) and x < 4 * n:
                x += step
                y += step
                step *= 2
            same = min(n, (x >> 2) + (((differ & -differ).bit_length() - 1) >> 5 if differ else 0)) - i
            run((i, j, same))
            i += same
            j += same
            if i == n:
                break
            p, q = list_a[i], list_b[j]
        while p != q:
            link((i, j))
            if p < q:
                i += 1
                p = list_a[i]
            else:
                j += 1
                q = list_b[j]
        link((i, j))
        i += 1
        j += 1
        group((i, j))
    rows = lambda values, k: np.frombuffer(values, np.int32).reshape(-1, k)
    return rows(runs, 3), rows(links, 2), rows(groups, 2)


def _written_ids(count: int, *ends: str) -> np.ndarray:
    """Each id in decimal followed by an end, for each end in turn, as bytes filled up with zeros."""
    texts = np.array([f"{i}{end}" for end in ends for i in range(count)], bytes)
    return texts.view(np.uint8).reshape(len(texts), -1)


class Aligner:
    """Both tokenizers in a task."""

    def __init__(self, bpe_path: str, piece_path: str, outside: str):
        self.bpe_path, self.outside = bpe_path, outside
        self.a_bytes = bpe.token_bytes(bpe_path)
        self.a_size = np.array(list(map(len, self.a_bytes)), np.int32)
        self.words = pieces.Words(lambda parts: [bpe.plain_ids(bpe_path, p, outside) for p in parts])
        self.pieces = pieces.load(piece_path)
        self.b_bytes = self.pieces.bytes
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int32)
        # every byte is a token of a, and b spells its normalised text, in which only spaces are changed
        self.exact = self.pieces.plain and self.pieces.apart and {bytes([i]) for i in range(256)} <= set(self.a_bytes)
        # an id followed by a comma, or by what ends its side of a group
        a, b = _written_ids(len(self.a_bytes), ",", "|"), _written_ids(len(self.b_bytes), ",", ";")
        self.written = np.zeros((len(a) + len(b), max(a.shape[1], b.shape[1])), np.uint8)
        self.written[: len(a), : a.shape[1]] = a
        self.written[len(a) :, : b.shape[1]] = b

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, str]:
        """(number of groups, links as pairs of ids, the groups as text)."""
        runs, links, groups = diagonal_groups(np.cumsum(self.a_size[a], dtype=np.int32), np.cumsum(self.b_size[b], dtype=np.int32))
        length = runs[:, 2]
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        run_a, run_b = np.repeat(runs[:, 0], length) + inner, np.repeat(runs[:, 1], length) + inner
        pairs = a[np.append(run_a, links[:, 0])].astype(np.int64) << 32 | b[np.append(run_b, links[:, 1])]
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[run_a] = last_b[run_b] = True
        last_a[groups[:, 0] - 1] = last_b[groups[:, 1] - 1] = True
        # in the text, tokens of a stand before those of b of the same group
        end_a, end_b = np.flatnonzero(last_a) + 1, np.append(0, np.flatnonzero(last_b) + 1)
        text = np.empty(len(a) + len(b), np.int64)
        text[np.arange(len(a)) + end_b[np.cumsum(last_a) - last_a]] = a + last_a * len(self.a_bytes)
        text[np.arange(len(b)) + end_a[np.cumsum(last_b) - last_b]] = b + last_b * len(self.b_bytes) + 2 * len(self.a_bytes)
        written = self.written[text].ravel()
        return len(end_a), pairs, written[written != 0][:-1].tobytes().decode()

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both; None where either does not give back the bytes of a space and the text."""
        whole = [f" {t}".encode() for t in texts]
        out = []
        for text, data, a, b in zip(texts, whole, self._a_ids(texts, whole), self.pieces.ids([self.pieces.normalise(t)[0] for t in texts])):
            same = bool(text) and self.a_size[a].sum() == self.b_size[b].sum() == len(data)
            if not self.exact:  # equal sizes do not prove equal bytes
                same = same and all(b"".join(map(x.__getitem__, y.tolist())) == data for x, y in ((self.a_bytes, a), (self.b_bytes, b)))
            out.append((a, b) if same else None)
        return out

    def _a_ids(self, texts: list[str], whole: list[bytes]) -> list[np.ndarray]:
        odd = [bpe.has_exceptions(t, self.outside) for t in texts]
        parts = iter(self.words.ids([w for w, o in zip(whole, odd) if not o], _before_words))
        return [np.array(bpe.plain_ids(self.bpe_path, " " + t, self.outside), np.int32) if o else next(parts) for t, o in zip(texts, odd)]


#: Bytes that begin a character which is no white space in any library; first bytes of some white space beyond ASCII are left out.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


def _before_words(data: np.ndarray) -> np.ndarray:
    """A space before a character that is no white space begins a pre-token, whatever stands before it."""
    return np.flatnonzero((data[:-2] == 32) & _SOLID[data[1:-1]])


_aligners: dict = {}


def _aligner(*key: str) -> Aligner:
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _ragged(rows: list[np.ndarray], kind: pa.DataType, numbers: type) -> pa.ListArray:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, numbers)]).astype(numbers, copy=False)), type=kind)


def align(docs: DataFrame, bpe_path: str, piece_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the alignment of a byte-level BPE (a, a ``tokenizers`` .json, over a space and the text) with a SentencePiece model (b); one pass, no shuffle.

    ``n_a``, ``n_b``: tokens. ``n_groups``: stretches between byte offsets where tokens of both end. ``n_links``: pairs of tokens whose bytes
    overlap. ``groups``: their ids, ``a1,a2|b1;a3|b2``. For :func:`link_counts`: ``block``, a stretch of rows; on its first row
    ``block_pairs``, its distinct linked pairs (id of a times 2^32 plus id of b), with ``block_docs``, the rows that hold each; and
    ``link_at``, ``link_n``, the row's pairs as places in that list with their numbers.

    Null or empty text, and text that either tokenizer does not give back byte for byte: zeros and ''. Repeated rows each get their row.
    An input column named like an output column is replaced. Empty table: empty result.
    """
    outside = bpe.exceptions(bpe_path)
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    fields = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [
        T.StructField("groups", T.StringType()), T.StructField("block", T.LongType()), T.StructField("block_pairs", longs),
        T.StructField("block_docs", ints), T.StructField("link_at", ints), T.StructField("link_n", ints),
    ]
    seen = {"block": 0}

    def compute(block: TextBlock) -> list:
        aligner = _aligner(bpe_path, piece_path, outside)
        counts = np.zeros((len(block), 4), np.int64)
        groups, held, times = [], [], []
        for k, found in enumerate(aligner.tokens(block.strings())):
            n, pairs, text = aligner.align(*found) if found else (0, np.zeros(0, np.int64), "")
            counts[k] = (len(found[0]), len(found[1]), n, len(pairs)) if found else 0
            pairs, number = np.unique(pairs, return_counts=True)
            groups.append(text)
            held.append(pairs)
            times.append(number.astype(np.int32))
        pairs, at = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_inverse=True)
        edges = np.cumsum([0, *map(len, held)])
        number = (pyspark.TaskContext.get().partitionId() << 32) + seen["block"]
        seen["block"] += 1
        none = [None] * (len(block) - 1)
        return [
            *counts.T, pa.array(groups, pa.string()), np.full(len(block), number),
            pa.array([pairs, *none], LONGS), pa.array([np.bincount(at, minlength=len(pairs)).astype(np.int32), *none], pieces.LIST),
            pieces.lists([at[i:j].astype(np.int32) for i, j in zip(edges[:-1], edges[1:])]), pieces.lists(times),
        ]

    return annotate(docs, compute, fields, text_col, keep, BLOCK)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs, best) of an aligned table: the documents in which the pair is linked, and whether no pair of its id of a has more.

    The largest counts are a row for each id of a, so at most a row for each entry of its vocabulary: small enough to broadcast at any size of the corpus.
    """
    each = aligned.where(F.col("block_pairs").isNotNull()).select(F.explode(F.arrays_zip("block_pairs", "block_docs")).alias("p"))
    counts = each.groupBy(F.col("p.block_pairs").alias("pair")).agg(F.sum("p.block_docs").alias("n_docs"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def link_counts(aligned: DataFrame) -> DataFrame:
    """Replaces the columns of links and blocks of a written :func:`align` by ``n_best`` (links whose pair has the highest count of its id of a, ties
    included) and ``count_sum`` (counts summed over links).

    Counts come back to a block as one row for each of its pairs, so a task holds the rows of one block of a few megabytes of text.
    """
    gone = ("block", "block_pairs", "block_docs", "link_at", "link_n")
    asked = aligned.where(F.col("block_pairs").isNotNull()).select(F.col("block").alias("home"), F.posexplode("block_pairs").alias("at", "pair"))
    answers = asked.join(pair_counts(aligned), "pair").select("home", "at", "n_docs", "best")
    rows = aligned.drop("block_pairs", "block_docs")
    made = ("n_best", "count_sum")
    kept = [f for f in rows.schema if f.name.lower() not in (*gone, *made)]
    schema = T.StructType(kept + [T.StructField(n, T.LongType()) for n in made])

    def finish(docs: pa.Table, found: pa.Table) -> pa.Table:
        size = found.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, bool)
        at = found.column("at").to_numpy()
        count[at], best[at] = found.column("n_docs").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        places, times = (docs.column(c).combine_chunks() for c in ("link_at", "link_n"))
        where, n = places.flatten().to_numpy(), times.flatten().to_numpy()
        edges = np.append(0, np.cumsum(np.asarray(places.value_lengths())))
        sums = [np.append(0, np.cumsum(x))[edges] for x in (n * best[where], n * count[where])]
        new = [pa.array(np.diff(x)) for x in sums]
        return pa.Table.from_arrays([*(docs.column(f.name) for f in kept), *new], names=[f.name for f in schema])

    return rows.groupBy("block").cogroup(answers.groupBy("home")).applyInArrow(finish, schema)
