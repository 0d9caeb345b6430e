"""Personal data: exact patterns, and a semi-Markov conditional random field over whole candidate spans."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TextBlock, annotate

KINDS = ("email", "ip", "card", "phone")

#: The patterns of the exact scan.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT = re.compile("[0-9]")

MAX_SPAN = 32  # tokens of an entity
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|.", re.DOTALL)
CLUSTER = re.compile(r"\+?[0-9](?:[\x20().-]{0,3}[0-9])+")
PAD = 24
PART = 1 << 17  # characters of a region that are scored at a time
STARTS = 2048  # tokens whose spans are scored at a time


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _around_at(text: str):
    """Maximal runs of characters that an address can hold around each ``@``; matches never leave such a run."""
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in EMAIL_CHARS:
            lo -= 1
        hi = at + 1
        while hi < len(text) and (text[hi] in EMAIL_CHARS or text[hi] == "@"):
            hi += 1
        yield lo, hi
        done = hi
        at = text.find("@", hi)


def _addresses(text: str) -> list[tuple[str, int, int]]:
    """Addresses around each ``@``: the domain that follows it, and the local characters before it back to the last match. Linear."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in EMAIL_CHARS:
            lo -= 1
        ahead = DOMAIN.match(text, at + 1) if lo < at else None
        done = at + 1
        if ahead:
            done = ahead.end()
            out.append(("email", lo, done))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Exact matches, leftmost and non-overlapping within a kind, ordered by kind as listed and start.

    Addresses with ``@`` are sought around each ``@``; four numbers joined by dots in the
    maximal dotted runs, in turn. Both give what a scan of the pattern over the text gives, in linear time.
    """
    out = _addresses(text)
    if DIGIT.search(text):
        if text.count(".") >= 3:
            for m in DOTTED.finditer(text):
                parts = m.group().split(".")
                at = m.start()
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    end = at + sum(map(len, four)) + 3
                    if all(map(_byte, four)):
                        out.append(("ip", at, end))
                    at = end + 1
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(DIGIT.findall(m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold an entity: around ``@``, and clusters of 7 or more digits, with some context."""
    found = []
    if "@" in text:
        found += [(lo - PAD, hi + PAD) for lo, hi in _around_at(text)]
    if DIGIT.search(text):
        found += [(m.start() - PAD, m.end() + PAD) for m in CLUSTER.finditer(text) if m.end() - m.start() >= 7]
    out: list[list[int]] = []
    for lo, hi in sorted(found):
        lo, hi = max(lo, 0), min(hi, len(text))
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def parts(text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """A region as stretches (first, end, end of what its spans may reach) of about ``PART`` characters, cut between tokens."""
    out = []
    while hi - lo > PART:
        cut = TOKEN.match(text, lo + PART, hi).end()
        ahead = cut
        for m, _ in zip(TOKEN.finditer(text, cut, hi), range(MAX_SPAN)):
            ahead = m.end()
        out.append((lo, cut, ahead))
        lo = cut
    return [*out, (lo, hi, hi)] if lo < hi else out


_SPACE, _LETTER, _NUMBER = 1, 2, 4


def _ascii_classes() -> np.ndarray:
    out = np.zeros(128, np.uint8)
    for c in map(chr, range(128)):
        out[ord(c)] = _SPACE * c.isspace() | _LETTER * c.isalpha() | _NUMBER * c.isdigit()
    return out


ASCII_CLASS = _ascii_classes()
WORD = re.compile(r"[^\W\d_]")


def _classes(codes: np.ndarray) -> np.ndarray:
    """Class of each code point as ``TOKEN`` sees it: space, letter, digit 0-9, or other."""
    out = ASCII_CLASS[np.minimum(codes, 127)]
    high = codes > 127
    if high.any():
        seen, where = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([_SPACE if c.isspace() else _LETTER if WORD.match(c) else 0 for c in map(chr, seen.tolist())], np.uint8)[where]
    return out


#: What a span is described by; ``Spans.rows`` has one column each.
FEATURES = (
    "always", "digits 1-7", "digits 8-15", "digits 16-19", "digits 20+", "one @", "more @", "@ with inner dot after", "four bytes", "three dots, no bytes",
    "begins +", "+ and 8-15 digits", "begins alnum", "ends alnum", "letters", "letters without @", "blank", "line or tab", "digits, blanks, dashes", "such with check digit",
    "alnum or ._%+-@ before", "alnum or @ after", "+ before", "bracket, dot or dash at an end", "not ASCII", "dash or bracket",
)
N_FEATURES = len(FEATURES)


class Spans:
    """Candidate spans of several stretches side by side: they hold a digit or ``@``, are bounded in tokens, start and end at no space, and cross no line.

    All counts of a span come from running sums over characters or tokens. Stretches are parted by a NUL of their own,
    which no span crosses, and see one character more on each side.
    """

    def __init__(self, stretches: list[tuple[str, int, int, int]]):
        pieces, base, owned, at = ["\0"], [], [], 1
        for k, (text, lo, cut, hi) in enumerate(stretches):
            before, after = max(lo - 1, 0), min(hi + 1, len(text))
            pieces.append(text[before:after] + "\0")
            base.append(at - before)
            owned.append((at + lo - before, at + cut - before, at + hi - before))
            at += after - before + 1
        codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes, kind = codes, _classes(codes)
        n = len(codes)
        self.base, owned = np.array(base, np.int64), np.array(owned, np.int64).reshape(-1, 3)
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, owned[:, 0], 1)
        np.add.at(inside, owned[:, 2], -1)
        inside = np.cumsum(inside[:n]) > 0
        run = (kind == _LETTER) | (kind == _NUMBER)
        new = np.ones(n, bool)
        new[1:] = (kind[1:] != kind[:-1]) | ~run[1:] | (inside[1:] != inside[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        keep = inside[starts]
        self.a, self.b = starts[keep], ends[keep]
        self.piece = np.searchsorted(owned[:, 0], self.a, "right") - 1
        self.usable = self.a < owned[self.piece, 1]  # spans that begin beyond belong to the next stretch
        self.last = np.searchsorted(self.a, owned[:, 2])[self.piece]  # tokens of the stretch end here
        head = codes[self.a]
        self.kind, self.head = kind[self.a], head
        self.blank = self.kind == _SPACE
        sums = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
        is_ = lambda c: head == ord(c)
        size = self.b - self.a
        self.digits = sums(np.where(self.kind == _NUMBER, size, 0))
        self.letters = sums(self.kind == _LETTER)
        self.ats, self.dots, self.lines, self.tabs = sums(is_("@")), sums(is_(".")), sums(is_("\n")), sums(is_("\t"))
        self.spaces, self.dashes, self.brackets = sums(is_(" ")), sums(is_("-")), sums(is_("("))
        self.useful = sums((self.kind == _NUMBER) | is_("@"))
        plain = (self.kind == _NUMBER) | is_(" ") | is_("-")
        self.others = sums(~plain)
        high = np.concatenate([[0], np.cumsum(codes > 127, dtype=np.int32)])
        self.high_a, self.high_b = high[self.a], high[self.b]
        # Digits alone, to sum those at odd and even places for the check digit.
        digit = (codes[(kind == _NUMBER) & inside] - 48).astype(np.int32)
        double = np.where(digit > 4, 2 * digit - 9, 2 * digit)
        even = np.arange(len(digit)) % 2 == 0
        self.check = [sums(np.where(even == bool(p), digit, double)) for p in (1, 0)]
        byte = np.zeros(len(self.a), bool)
        number = np.flatnonzero(self.kind == _NUMBER)
        short = number[size[number] <= 3]
        value = np.zeros(len(short), np.int32)
        for k in range(3):
            there = size[short] > k
            value[there] = value[there] * 10 + (codes[self.a[short[there]] + k].astype(np.int32) - 48)
        byte[short] = value <= 255
        for i in number[size[number] > 3].tolist():  # leading zeros
            byte[i] = _byte("".join(map(chr, codes[self.a[i] : self.b[i]].tolist())))
        self.byte, self.dot = byte, is_(".")
        self.last_at = np.concatenate([[-1], np.maximum.accumulate(np.where(is_("@"), np.arange(len(head)), -1))]) if len(head) else np.zeros(1, np.int64)
        alnum = (kind == _LETTER) | (kind == _NUMBER)
        left, right = codes[np.maximum(self.a - 1, 0)], codes[np.minimum(self.b, n - 1)] if n else codes
        self.left_plus = left == ord("+")
        self.left_joined = alnum[np.maximum(self.a - 1, 0)] | np.isin(left, [ord(c) for c in "._%+-@"])
        self.right_joined = alnum[np.minimum(self.b, n - 1)] | (right == ord("@"))
        self.edge = np.isin(head, [ord(c) for c in "(.-"])
        self.alnum = (self.kind == _LETTER) | (self.kind == _NUMBER)

    def __len__(self) -> int:
        return len(self.a)

    def candidates(self, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first token, last token + 1) of the spans that begin at tokens ``lo`` to ``hi``."""
        hi = len(self) if hi is None else hi
        at = np.arange(lo, hi)
        far = np.minimum(at + MAX_SPAN, self.last[lo:hi])
        at, far = (x[self.usable[lo:hi] & ~self.blank[lo:hi] & (self.useful[far] > self.useful[lo:hi])] for x in (at, far))
        i = np.repeat(at, far - at)
        j = np.arange(len(i)) - np.repeat(np.cumsum(far - at) - (far - at), far - at) + i + 1
        ok = (self.lines[j] == self.lines[i]) & (self.useful[j] > self.useful[i]) & ~self.blank[j - 1]
        return i[ok], j[ok]

    def rows(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Features of the spans."""
        of = lambda x: x[j] - x[i]
        n, ats, dots, letters = of(self.digits), of(self.ats), of(self.dots), of(self.letters) > 0
        quad = (j - i == 7) & (dots == 3)
        k = i[quad]
        quad[quad] = self.byte[k] & self.byte[k + 2] & self.byte[k + 4] & self.byte[k + 6] & self.dot[k + 1] & self.dot[k + 3] & self.dot[k + 5]
        after = np.minimum(self.last_at[j] + 2, j - 1)
        inner = (ats == 1) & (self.head[i] != ord("@")) & (self.dots[j - 1] > self.dots[np.maximum(after, 0)])
        plus, grouped = self.head[i] == ord("+"), of(self.others) == 0
        card = grouped & (n >= 16) & (n <= 19)
        x, y = self.digits[i[card]], self.digits[j[card]]
        total = np.where(y % 2 == 1, self.check[0][y] - self.check[0][x], self.check[1][y] - self.check[1][x])
        checked = card.copy()
        checked[card] = total % 10 == 0
        out = np.stack([
            np.ones(len(i), bool), (n > 0) & (n < 8), (n >= 8) & (n <= 15), (n >= 16) & (n <= 19), n > 19, ats == 1, ats > 1, inner, quad, (dots == 3) & ~quad,
            plus, plus & (n >= 8) & (n <= 15) & ~letters, self.alnum[i], self.alnum[j - 1], letters, letters & (ats == 0), of(self.spaces) > 0, of(self.tabs) > 0, grouped, checked,
            self.left_joined[i], self.right_joined[j - 1], self.left_plus[i], self.edge[i] | self.edge[j - 1], self.high_b[j - 1] > self.high_a[i], of(self.dashes) + of(self.brackets) > 0,
        ])
        return out.T.astype(np.float32)

    def scored(self, weights: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Some starts at a time, (stretch, first character, last + 1, kind, score) of the spans that score over 0, in order of their starts."""
        for lo in range(0, len(self), STARTS):
            i, j = self.candidates(lo, min(lo + STARTS, len(self)))
            if not len(i):
                continue
            scores = self.rows(i, j) @ weights.T.astype(np.float32)
            top = scores.max(axis=1)
            good = np.flatnonzero(top > 0)
            piece = self.piece[i[good]]
            yield piece, self.a[i[good]] - self.base[piece], self.b[j[good] - 1] - self.base[piece], scores[good].argmax(axis=1), top[good]


class Lattice:
    """All candidate spans of one short text, for training."""

    def __init__(self, text: str):
        spans = Spans([(text, 0, len(text), len(text))])
        i, j = spans.candidates()
        self.n = len(spans)
        self.starts, self.ends = (spans.a - spans.base[0]).tolist(), (spans.b - spans.base[0]).tolist()
        self.spans = np.stack([i, j], axis=1)
        self.rows = spans.rows(i, j).astype(np.float64)
        self.by_end = np.argsort(j, kind="stable")
        self.end_at = np.searchsorted(j[self.by_end], np.arange(self.n + 2))
        self.start_at = np.searchsorted(i, np.arange(self.n + 2))


def _log_sum(x: np.ndarray) -> float:
    top = x.max()
    return float(top + np.log(np.exp(x - top).sum()))


def expectation(lattice: Lattice, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Probability of each (span, kind) over all segmentations, and the log of the sum over them.

    Segments are whole spans of a kind, or single tokens outside any, whose score is 0.
    """
    scores = lattice.rows @ weights.T
    n, spans = lattice.n, lattice.spans
    forward, backward = np.zeros(n + 1), np.zeros(n + 1)
    for p in range(1, n + 1):
        ids = lattice.by_end[lattice.end_at[p] : lattice.end_at[p + 1]]
        ways = (forward[spans[ids, 0]][:, None] + scores[ids]).ravel()
        forward[p] = _log_sum(np.append(ways, forward[p - 1]))
    for p in range(n - 1, -1, -1):
        ids = slice(lattice.start_at[p], lattice.start_at[p + 1])
        ways = (backward[spans[ids, 1]][:, None] + scores[ids]).ravel()
        backward[p] = _log_sum(np.append(ways, backward[p + 1]))
    total = forward[n]
    return np.exp(forward[spans[:, 0]][:, None] + scores + backward[spans[:, 1]][:, None] - total), total


class Decoder:
    """Best segmentation of a text, from its spans that score over 0 in order of their starts.

    Any other span never beats leaving its tokens outside, whose score is 0, so the choice over these is the choice over all.
    Held are the best way to the place reached and those to the ends ahead of it, which the bound on an entity keeps few.
    """

    def __init__(self) -> None:
        self.total, self.way, self.ahead = 0.0, None, {}

    def reach(self, place: float) -> None:
        for end in sorted(e for e in self.ahead if e <= place):
            total, way = self.ahead.pop(end)
            if total > self.total:
                self.total, self.way = total, way

    def add(self, a: int, b: int, kind: int, score: float) -> None:
        if self.ahead:
            self.reach(a)
        if (total := self.total + score) > self.ahead.get(b, (self.total,))[0]:
            self.ahead[b] = (total, (self.way, kind, a, b))

    def chosen(self) -> list[tuple[int, int, int]]:
        """(kind, first character, last + 1) in order."""
        self.reach(float("inf"))
        out, way = [], self.way
        while way:
            out.append(way[1:])
            way = way[0]
        return out[::-1]


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 8, rate: float = 0.5, seed: int = 7) -> np.ndarray:
    """Weights (kind, feature) by likelihood ascent over regions with their labelled spans."""
    weights, seen = np.zeros((len(KINDS), N_FEATURES)), np.full((len(KINDS), N_FEATURES), 1e-6)
    weights[:, 0] = -2.0
    made = []
    for text, labels in examples:
        lattice = Lattice(text)
        truth = np.zeros((len(lattice.spans), len(KINDS)))
        place = {(lattice.starts[i], lattice.ends[j - 1]): k for k, (i, j) in enumerate(lattice.spans.tolist())}
        for kind, a, b in labels:
            if (a, b) in place:
                truth[place[a, b], KINDS.index(kind)] = 1
        if len(lattice.spans):
            made.append((lattice, truth))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(made)):
            lattice, truth = made[k]
            expected, _ = expectation(lattice, weights)
            slope = (truth - expected).T @ lattice.rows - 1e-4 * weights
            seen += slope * slope
            weights += rate * slope / np.sqrt(seen)
    return weights


def fit(docs: DataFrame, text_col: str = "text", max_rows: int = 20_000, max_regions: int = 600) -> np.ndarray | None:
    """Train on a bounded sample: regions of at most about ``max_rows`` rows, ``max_regions`` of them, labelled by the exact patterns.

    Rows and regions are picked by a hash of the text, alike at every size; regions of over 400 characters are not learned from.
    None if nothing is labelled.
    """
    total = docs.count()
    share = min(1.0, max_rows / max(total, 1))
    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(1_000_003)) <= F.lit(int(share * 1_000_003)))
    example = T.StructType(
        [T.StructField("region", T.StringType())]
        + [T.StructField(c, T.ArrayType(t)) for c, t in (("kind", T.StringType()), ("a", T.IntegerType()), ("b", T.IntegerType()))]
    )

    def compute(block: TextBlock) -> list:
        out = []
        for text in block.strings():
            base, got = None, []
            for lo, hi in regions(text):
                base = base_spans(text) if base is None else base
                if hi - lo <= 400:
                    inside = [(k, a - lo, b - lo) for k, a, b in base if lo <= a and b <= hi]
                    got.append({"region": text[lo:hi], "kind": [x[0] for x in inside], "a": [x[1] for x in inside], "b": [x[2] for x in inside]})
            out.append(got)
        return [out]

    found = annotate(sample, compute, [T.StructField("e", T.ArrayType(example))], text_col, keep=[])
    found = found.select(F.explode("e").alias("e")).select("e.*").dropDuplicates(["region"])
    found = found.orderBy(F.xxhash64("region"), "region").limit(max_regions).collect()
    examples = [(r["region"], list(zip(r["kind"], r["a"], r["b"]))) for r in found]
    return train(examples) if any(labels for _, labels in examples) else None


def learned_spans(texts: list[str], weights: np.ndarray, base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """For each text the spans that the trained field adds: those that overlap no exact match. Stretches of several texts are scored together."""
    decoders: dict[int, Decoder] = {}
    held: list[tuple[int, tuple[str, int, int, int]]] = []
    size = 0

    def score() -> None:
        for columns in Spans([x for _, x in held]).scored(weights):
            for k, a, b, kind, value in zip(*(c.tolist() for c in columns)):
                decoders.setdefault(held[k][0], Decoder()).add(a, b, kind, value)
        held.clear()

    for i, text in enumerate(texts):
        for lo, hi in regions(text):
            for first, cut, reach in parts(text, lo, hi):
                held.append((i, (text, first, cut, reach)))
                size += reach - first
                if size >= PART:
                    score()
                    size = 0
    if held:
        score()
    out = []
    for i, exact in enumerate(base):
        taken = sorted((a, b) for _, a, b in exact)
        reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
        own = []
        for kind, a, b in decoders[i].chosen() if i in decoders else ():
            k = bisect.bisect_left(taken, (b,)) - 1  # the last exact match that begins before b, and how far those up to it reach
            if k < 0 or reach[k] <= a:
                own.append((KINDS[kind], a, b))
        out.append(own)
    return out


def find_pii(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (exact matches), ``base_sha256`` and ``spans``, all as kind:start:end in code points.

    ``weights`` from :func:`fit` (None: exact patterns only). The field scores every candidate span of a region
    as a whole, and dynamic programming over entities of at most 32 tokens picks boundaries and kinds
    together; its spans join the exact ones where they overlap none. ``n_spans`` counts all. One pass, no shuffle; time is linear in
    a text, and of a long one only some thousand tokens are scored at a time. Null or empty text: no spans.
    """
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())]
    order = {k: i for i, k in enumerate(KINDS)}

    def compute(block: TextBlock) -> list:
        out: list[list] = [[] for _ in fields]
        texts = block.strings()
        exact = [base_spans(t) for t in texts]
        added = learned_spans(texts, weights, exact) if weights is not None else [[]] * len(texts)
        for base, more in zip(exact, added):
            every = sorted([*base, *more], key=lambda s: (order[s[0]], s[1])) if more else base
            for i, k in enumerate(KINDS):
                out[i].append(sum(s[0] == k for s in base))
            out[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out[5].append(_joined(every))
            out[6].append(len(every))
        return out

    return annotate(docs, compute, fields, text_col, keep)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text") -> DataFrame:
    """Texts with each span replaced by its kind in angle brackets; every row and column stays."""

    def compute(block: TextBlock) -> list:
        out, texts = [], block.strings()
        exact = [base_spans(t) for t in texts]
        added = learned_spans(texts, weights, exact) if weights is not None else [[]] * len(texts)
        for text, null, base, more in zip(texts, block.null.tolist(), exact, added):
            at, kept = 0, []
            for a, b, k in sorted((a, b, k) for k, a, b in [*base, *more]):
                if a >= at:
                    kept += [text[at:a], f"<{k}>"]
                at = max(at, b)
            out.append(None if null else "".join([*kept, text[at:]]))
        return [pa.array(out, pa.string())]

    order = docs.columns
    return annotate(docs, compute, [T.StructField(text_col, T.StringType())], text_col).select(*[F.col(f"`{c}`") for c in order])
