"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import TextBlock, annotate


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8) and ``n_tokens`` to each row; one pass, no shuffle.

    ``tokenizer_path``: a ``tokenizers`` .json with byte-level pre-tokens, or a sentencepiece .model.
    For the .json, the driver proves once which vocabulary strings encode alone as one token; a task
    splits a text into pre-tokens, counts the proven ones directly, and merges each other distinct
    pre-token once, in any script. Special strings inside a text count as the library counts them. The proven set is
    bounded by the vocabulary.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows each get their row. An input column named
    like an output column is replaced. Empty table: empty result.
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    if tokenizer_path.endswith(".model"):

        def compute(block: TextBlock) -> list:
            from sentencepiece import SentencePieceProcessor

            model = _pieces.get(tokenizer_path) or _pieces.setdefault(
                tokenizer_path, SentencePieceProcessor(model_file=tokenizer_path)
            )
            return [np.diff(block.off), np.fromiter((len(model.encode(t)) for t in block.strings()), np.int64, len(block))]

        return annotate(docs, compute, fields, text_col, keep)

    whole = docs.sparkSession.sparkContext.broadcast(bpe.whole_tokens(tokenizer_path))
    outside = bpe.exceptions(tokenizer_path)

    def compute(block: TextBlock) -> list:
        count = bpe.counter(tokenizer_path, whole.value, outside).count
        return [np.diff(block.off), np.fromiter(map(count, block.strings()), np.int64, len(block))]

    return annotate(docs, compute, fields, text_col, keep)


_pieces: dict = {}


def over_limit(counted: DataFrame, limit: int = 1024) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
