"""Language of texts by a byte convolutional network trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TextBlock, annotate

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
CLASSES = 128
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
CHUNK = 64  # windows at a time, so that activations stay in the cache
_PAD, _SPACE, _DIGIT, _OTHER, _CONTROL = 30, 26, 27, 28, 29


def _byte_classes() -> np.ndarray:
    """128 classes: letters with case folded, space, digits, other ASCII, controls, padding; 64 for bytes inside a character, 32 for those that begin one."""
    out = np.full(256, _OTHER, np.uint8)
    out[:32], out[127] = _CONTROL, _CONTROL
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[48:58] = _DIGIT
    for k in range(26):
        out[65 + k] = out[97 + k] = k
    out[128:192] = 32 + np.arange(64)
    out[192:] = 96 + (np.arange(64) & 31)
    return out


BYTE_CLASS = _byte_classes()


@dataclass
class Network:
    """Filters of several widths over byte classes, maximum over a window, then softmax.

    ``tables[w][k]``: what a byte class at place k of a width-w filter adds, for each filter.
    """

    labels: list[str]
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out_bias: np.ndarray

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The same sums by pairs of neighbouring bytes, all filters side by side: places 0-1, and 2-3."""
        front = np.zeros((CLASSES, CLASSES, FILTERS * len(WIDTHS)), np.float32)
        rear = np.zeros_like(front)
        for i, w in enumerate(WIDTHS):
            own, t = slice(i * FILTERS, (i + 1) * FILTERS), self.tables[w]
            front[:, :, own] = t[0][:, None] + t[1][None]
            if w > 2:
                rear[:, :, own] = t[2][:, None] + (t[3][None] if w > 3 else 0)
        front += self.bias
        return front.reshape(CLASSES * CLASSES, -1), rear.reshape(CLASSES * CLASSES, -1)

    def activations(self, windows: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        code = windows.astype(np.int32)
        code = code[:, :-1] * CLASSES + code[:, 1:]
        return np.take(pairs[0], code[:, :-2], axis=0) + np.take(pairs[1], code[:, 2:], axis=0)

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.dense + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, windows: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        pooled = [self.activations(windows[i : i + CHUNK], pairs).max(axis=1) for i in range(0, len(windows), CHUNK)]
        return self.softmax(np.concatenate(pooled))


def train(windows: np.ndarray, truth: np.ndarray, labels: list[str], epochs: int = 10, batch: int = 128, rate: float = 0.01, seed: int = 11) -> Network:
    """Adam on cross-entropy; the maximum passes its gradient to the one place that it came from."""
    rng = np.random.default_rng(seed)
    net = Network(
        labels,
        {w: rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )
    params = [*net.tables.values(), net.bias, net.dense, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            x, y = windows[order[i : i + batch]], truth[order[i : i + batch]]
            act = net.activations(x, net.pair_tables())
            at = act.argmax(axis=1)
            pooled = np.take_along_axis(act, at[:, None], axis=1)[:, 0]
            p = net.softmax(pooled)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            hidden = np.maximum(pooled, 0)
            back = (p @ net.dense.T) * (pooled > 0)
            grads = []
            for j, w in enumerate(WIDTHS):
                own = slice(j * FILTERS, (j + 1) * FILTERS)
                g = np.zeros_like(net.tables[w])
                filters = np.broadcast_to(np.arange(FILTERS), at[:, own].shape)
                for k in range(w):
                    byte = np.take_along_axis(x, at[:, own] + k, axis=1)
                    np.add.at(g[k], (byte, filters), back[:, own])
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
    return net


def cut_windows(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """All texts as windows of ``WINDOW`` byte classes, the last of each padded; and the first window of each text, then the total."""
    sizes = np.diff(block.off)
    counts = -(-sizes // WINDOW)
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = np.full(int(first[-1]) * WINDOW, _PAD, np.uint8)
    shift = np.repeat(first[:-1] * WINDOW - block.off[:-1], sizes)
    flat[np.arange(len(block.buf)) + shift] = BYTE_CLASS[block.buf]
    return flat.reshape(-1, WINDOW), first


def fit(docs: DataFrame, label: Column | str = "lang", where: Column | None = None, text_col: str = "text", per_label: int = 600, per_text: int = 4) -> Network | None:
    """Train on a bounded sample of the labelled rows: about ``per_label`` texts of each label, ``per_text`` windows of each.

    Texts are picked by a hash of the text against a threshold from the label's count of different texts,
    alike at every size. The tasks cut the windows and equal ones collapse before the shuffle, so copies,
    however many, count once and the driver gets about labels x per_label x per_text x 256 bytes.
    Some windows are shortened, so that short texts are learned too. None if there is no labelled text.
    """
    rows = docs.select(F.col(label).alias("label") if isinstance(label, str) else label.alias("label"), F.col(text_col).alias("text"), (where if where is not None else F.lit(True)).alias("use"))
    rows = rows.where("use and label is not null and text is not null").drop("use").withColumn("h", F.xxhash64("text"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    labels = sorted(counts)
    scale = 1 << 48
    limits = F.create_map(*[f(x) for k in labels for f, x in ((F.lit, k), (lambda n: F.lit(n).cast("long"), scale * min(per_label, counts[k]) // counts[k]))])
    sample = rows.where(F.pmod("h", F.lit(scale)) < limits[F.col("label")])

    def compute(block: TextBlock) -> list:
        windows, first = cut_windows(block)
        out = []
        for a, b in zip(first[:-1], first[1:]):
            picked = np.unique(np.linspace(a, b - 1, min(per_text, b - a)).astype(int)) if b > a else []
            out.append([windows[k].tobytes() for k in picked])
        return [out]

    got = annotate(sample, compute, [T.StructField("w", T.ArrayType(T.BinaryType()))], "text", keep=["label"])
    got = got.select("label", F.explode("w").alias("w")).distinct().collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["label"], bytes(r["w"])))
    windows = np.frombuffer(b"".join(r["w"] for r in got), np.uint8).reshape(-1, WINDOW).copy()
    rng = np.random.default_rng(5)
    for k in np.flatnonzero(rng.random(len(windows)) < 0.25):
        windows[k, rng.integers(12, WINDOW) :] = _PAD
    number = {k: i for i, k in enumerate(labels)}
    truth = np.array([number[r["label"]] for r in got])
    seen = np.bincount(truth, minlength=len(labels))  # balance: rare labels are repeated
    most = int(seen.max())
    order = np.concatenate([np.resize(np.flatnonzero(truth == k), most) for k in range(len(labels)) if seen[k]])
    return train(windows[order], truth[order], labels)


def predict(docs: DataFrame, network: Network | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1): mean over all windows of the whole text; one pass, no shuffle.

    Null text, or one without a letter: ``und``, score 0. The network is a few thousand numbers.
    """
    model = docs.sparkSession.sparkContext.broadcast(network)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def compute(block: TextBlock) -> list:
        net = model.value
        n = len(block)
        none = np.array([not LETTER.search(t) for t in block.strings()], bool)
        if net is None:
            return [[UNDETERMINED] * n, np.zeros(n)]
        windows, first = cut_windows(block)
        mean = np.zeros((n, len(net.labels)))
        if len(windows):
            p = net.probabilities(windows, net.pair_tables()).astype(np.float64)
            filled = np.flatnonzero(np.diff(first))
            mean[filled] = np.add.reduceat(p, first[filled], axis=0) / np.diff(first)[filled, None]
        best = mean.argmax(axis=1)
        names = [UNDETERMINED if x else net.labels[k] for x, k in zip(none.tolist(), best.tolist())]
        return [names, np.where(none, 0.0, np.clip(mean.max(axis=1), 0, 1))]

    return annotate(docs, compute, fields, text_col, keep)


def fold(id_col: Column | str) -> Column:
    """The row's fold from 0 to 3: crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")), F.lit(4))


def keep_determined(docs: DataFrame, network: Network | None, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """Documents whose language the network tells with at least ``min_score``; all their columns."""
    columns = docs.columns
    marked = docs.select(*[F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(columns)])
    found = predict(marked, network, f"__in_{columns.index(text_col)}")
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
    return kept.select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(columns)])
