"""Shared pieces of the corpus operators: text blocks and words inside tasks."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homeround.storage import forget, written  # noqa: F401  the corpus operators take them from here

BLOCK_BYTES = 1_000_000
_TEXT = "__homeround_text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class TextBlock:
    """A few megabytes of texts: one byte buffer with row offsets. A null text counts as empty."""

    def __init__(self, column: pa.Array):
        self.null = np.asarray(column.is_null())
        self.column = column
        data = column.cast(pa.large_binary())
        if column.null_count:
            data = data.fill_null(b"")
        _, offsets, values = data.buffers()
        off = np.frombuffer(offsets, np.int64, len(data) + 1, data.offset * 8)
        whole = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
        self.buf = whole[off[0] : off[-1]]
        self.off = off - off[0]
        self._data = data

    def __len__(self) -> int:
        return len(self.off) - 1

    def strings(self) -> list[str]:
        return [x or "" for x in self.column.to_pylist()]

    def raw(self) -> list[bytes]:
        return self._data.to_pylist()


def blocks(batch: pa.RecordBatch, at: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of column ``at``, one row at least."""
    n = batch.num_rows
    if not n:
        return
    column = batch.column(at)
    sizes = pc.fill_null(pc.binary_length(column), 0)
    total = np.cumsum(np.asarray(sizes, dtype=np.int64) + 16)
    i = 0
    while i < n:
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


@functools.cache
def _malloc_trim():
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def trim() -> None:
    """Give memory that is not in use back to the machine: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def annotate(
    df: DataFrame,
    compute: Callable[..., list],
    fields: list[T.StructField],
    text_col: str = "text",
    keep: list[str] | None = None,
    limit: int = BLOCK_BYTES,
    with_rows: bool = False,
) -> DataFrame:
    """``df`` with columns that ``compute`` derives from each block of texts; no shuffle, rows as they came.

    ``keep`` names the input columns to carry (default: all). A computed column replaces an input
    column of the same name.
    """
    made = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in made]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in keep] + fields)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(_TEXT))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for batch in batches:
            for part in blocks(batch, at, limit):
                texts = TextBlock(part.column(at))
                new = compute(texts, part) if with_rows else compute(texts)
                if target is None:
                    from pyspark.sql.pandas.types import to_arrow_schema

                    target = to_arrow_schema(schema)
                arrays = [*part.columns[:at], *new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, f.type) if not isinstance(a, pa.Array) else a for a, f in zip(arrays, target)],
                    names=target.names,
                )
            trim()

    return source.mapInArrow(run, schema)


#: Lower-case A-Z and keep word bytes (digits, letters and all of 0x80 up); 0 elsewhere.
WORD_BYTES = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    WORD_BYTES[_b] = _b
WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B]


class Words:
    """The words of a block's texts, runs of word bytes after lower-casing A-Z.

    ``norm``: the texts with two bytes after each, other bytes 0; ``start`` and ``end``: places of
    the words in it; ``first``: for each text the number of its first word, then the total;
    ``base``: where each text begins in ``norm``.
    """

    def __init__(self, block: TextBlock):
        n = len(block)
        base = block.off[:-1] + 2 * np.arange(n)
        joined = np.frombuffer(b" \n".join([*block.raw(), b""]), np.uint8)
        self.norm = WORD_BYTES[joined]
        inside = self.norm != 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]  # the bytes after a text close its last word
        self.base = base
        self.first = np.searchsorted(self.start, np.append(base, len(joined)))
