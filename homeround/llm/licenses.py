"""Licence notices in texts: exact phrases, and short notices with a few edits."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import TextBlock, Words, annotate

#: Phrase words and label of the exact scan.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Short notices for the search with edits; (words, edits allowed, words that must stand exactly after them, label).
NOTICES = (
    ("under the mit license", 2, "", "mit"),
    ("apache license version", 2, " 2", "apache-2"),
    ("creative commons attribution noncommercial", 4, "", "cc-by-nc"),
    ("gnu general public license", 2, "", "gpl"),
    ("gnu lesser general public license", 3, "", "lgpl"),
    ("gnu affero general public license", 3, "", "agpl"),
    ("mozilla public license", 2, "", "mpl"),
    ("eclipse public license", 2, "", "epl"),
    ("redistribution and use in source and binary forms", 4, "", "bsd"),
    ("boost software license", 2, "", "bsl"),
    ("permission is hereby granted free of charge", 4, "", "permissive-grant"),
    ("permission to use copy modify and or distribute this software", 5, "", "isc"),
    ("released into the public domain", 3, "", "public-domain"),
    ("all rights reserved", 1, "", "all-rights-reserved"),
)


@functools.lru_cache(maxsize=8)
def _exact(phrases: tuple[str, ...]) -> list[re.Pattern]:
    return [re.compile(rb"(?<![^ \n])" + re.escape(p.encode()) + rb"(?![^ \n])") for p in phrases]


@functools.lru_cache(maxsize=8)
def _fuzzy(notices: tuple) -> list[tuple[list[tuple[bytes, int]], regex.Pattern, int, int, str]]:
    """Each notice as seeds with their places, pattern, length, edits and label.

    Cut into edits + 1 pieces, at least one piece of a notice with that many edits is intact.
    """
    out = []
    for words, edits, after, label in notices:
        raw = words.encode()
        cuts = [round(k * len(raw) / (edits + 1)) for k in range(edits + 2)]
        seeds = [(raw[a:b], a) for a, b in zip(cuts, cuts[1:])]
        pattern = regex.compile(
            rb"(?b)(?<![^ \n])(?:" + regex.escape(words, literal_spaces=True).encode() + rb"){e<=%d}" % edits + after.encode() + rb"(?![^ \n])"
        )
        out.append((seeds, pattern, len(raw) + len(after), edits, label))
    return out


def _search(norm: bytes, notices: tuple) -> list[tuple[int, int, str, float]]:
    """(start, end, label, score) of notices with edits; score is 1 less the share of edited letters."""
    found = {}
    for seeds, pattern, size, edits, label in _fuzzy(notices):
        windows = []
        for seed, place in seeds:
            at = norm.find(seed)
            while at >= 0:
                windows.append((at - place - edits - 1, at - place + size + edits + 1))
                at = norm.find(seed, at + 1)
        reach = 0
        for lo, hi in sorted(windows):
            lo, hi = max(lo, 0), min(hi, len(norm))
            if hi <= reach:
                continue
            for m in pattern.finditer(norm, lo, hi, overlapped=True):
                # An edit at a border may take in or leave out a space or a letter of a neighbouring word.
                a, b = m.span()
                if b"\n" in norm[a:b] or not norm[a:b].strip(b" "):
                    continue
                score = 1 - sum(m.fuzzy_counts) / size
                key = (a, b, label)
                found[key] = max(found.get(key, 0), score)
            reach = hi
    return [(a, b, label, score) for (a, b, label), score in found.items()]


def scan(
    docs: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    phrases: dict[str, str] | None = None,
    notices: tuple = NOTICES,
) -> DataFrame:
    """Adds what licence notices each text holds; one pass, no shuffle.

    Words are runs of digits, letters and all above U+007F after lower-casing A-Z, and notices are
    sought in the words joined by spaces. ``n_words``; ``n_base``, ``first_word``, ``last_word`` (null if
    none) and ``base_labels`` of the exact phrases; ``labels``, also with those of fuzzy notices;
    ``score``, the best share of unedited letters, 1 for an exact phrase, 0 for none; ``notices``, the spans
    (first word, last word + 1, label, score) of both. Null or empty text: no words, no labels.
    """
    phrases = PHRASES if phrases is None else phrases
    labels = list(phrases.values())
    span = T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("notices", T.ArrayType(span)),
    ]

    def compute(block: TextBlock) -> list:
        words = Words(block)
        norm = words.norm
        line_end = np.append(words.base[1:], len(norm)) - 1
        spaced = norm.copy()
        spaced[words.end] = 0x20
        spaced[line_end] = 0x0A
        kept = spaced != 0
        start = (np.cumsum(kept) - 1)[words.start]
        joined = spaced[kept].tobytes()
        first = words.first
        n = len(block)
        hits: list[list] = [[] for _ in range(n)]
        for pattern, label in zip(_exact(tuple(phrases)), labels):
            for m in pattern.finditer(joined):
                a, b = np.searchsorted(start, m.start()), np.searchsorted(start, m.end())
                hits[int(np.searchsorted(first, a, "right")) - 1].append((int(a), int(b), label, 1.0, True))
        for lo, hi, label, score in _search(joined, notices):
            a, b = int(np.searchsorted(start, lo, "right")) - 1, int(np.searchsorted(start, hi))
            a = max(a, 0)
            hits[int(np.searchsorted(first, a, "right")) - 1].append((a, b, label, score, False))
        out: list[list] = [[] for _ in fields]
        for i, found in enumerate(hits):
            f = int(first[i])
            base = [h for h in found if h[4]]
            row = (
                int(first[i + 1]) - f,
                len(base),
                min((h[0] - f for h in base), default=None),
                max((h[0] - f for h in base), default=None),
                ",".join(sorted({h[2] for h in base})),
                ",".join(sorted({h[2] for h in found})),
                max((h[3] for h in found), default=0.0),
                [{"start": a - f, "end": b - f, "label": l, "score": s} for a, b, l, s, _ in sorted(found)],
            )
            for column, x in zip(out, row):
                column.append(x)
        return out

    return annotate(docs, compute, fields, text_col, keep)
