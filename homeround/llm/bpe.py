"""Byte-level BPE inside tasks: whole-token shortcut for counts, full ids for packing.

The vocabulary file is a parameter and is read where the task runs; every node has the package that
holds it. The pre-token pattern depends on a character only by its class: letter, number, space or other. The driver proves
for each assigned code point that ``regex``, ``tiktoken`` and ``tokenizers`` give it the same class; texts with any other
(:func:`exceptions`) go to ``tokenizers`` whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import regex
from tokenizers import Tokenizer

CACHE_ENTRIES = 400_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def load(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.cache
def load_plain(path: str) -> Tokenizer:
    """The same with the strings of special tokens as plain text."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    return tokenizer


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """Byte-level decoding of each id; empty for ids without one."""
    alphabet, vocab = byte_alphabet(), load(path).get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return out


@functools.cache
def specials(path: str) -> dict[str, int]:
    return {t.content: i for i, t in load(path).get_added_tokens_decoder().items()}


@functools.cache
def pre_tokens() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


@functools.cache
def exceptions(path: str) -> str:
    """The proof: a pattern of the code points whose class is not shown to be the same in all three libraries, unassigned ones included.

    A character joins a neighbour of its own class to one pre-token and no other: after ``a``, ``1``, ``!`` or a tab. For
    ``tiktoken`` an encoding shows that whose only merges are of these four with any byte.
    """
    import public_tokenizers
    import tiktoken

    tokenizer = load(path)
    if tokenizer.normalizer is not None or tokenizer.pre_tokenizer is None:
        return r"[\U00000000-\U0010ffff]"
    merges = [bytes([p, f]) for p in b"a1!\t" for f in range(256)]
    ranks = {token: i for i, token in enumerate([*(bytes([b]) for b in range(256)), *merges])}
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    letter, number, space = (regex.compile(x).match for x in (r"\p{L}", r"\p{N}", r"\s"))
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    runs: list[list[int]] = []
    for code in range(0x110000):
        c = chr(code)
        if unicodedata.category(c) not in ("Cn", "Cs", "Co"):
            pair = ("a" if letter(c) else "1" if number(c) else "\t" if space(c) else "!") + c
            if len(split(pair)) == 1 and probe.encode_ordinary(pair)[0] > 255:
                continue
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


@functools.cache
def _search(pattern: str):
    """Whether a text holds a character of the pattern. Those beyond U+FFFF are asked about by themselves: a class without them is one table look-up a character."""
    ranges = re.findall(r"\\U(.{8})-\\U(.{8})", pattern)
    low = re.compile("[" + "".join(f"\\U{a}-\\U{min(int(b, 16), 0xFFFF):08x}" for a, b in ranges if int(a, 16) <= 0xFFFF) + "]").search
    beyond, every = re.compile("[\U00010000-\U0010ffff]").search, re.compile(pattern).search
    return lambda text: bool(low(text)) or bool(beyond(text) and every(text))


@functools.cache
def whole_tokens(path: str) -> frozenset[str]:
    """The proof: vocabulary strings that are one pre-token and that the library encodes, alone, as that one token."""
    tokenizer, alphabet, find = load(path), byte_alphabet(), pre_tokens().findall
    plain = {}
    special = specials(path)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if token in special or any(c not in alphabet for c in token):
            continue
        try:
            text = bytes(alphabet[c] for c in token).decode()
        except UnicodeDecodeError:
            continue
        if text and find(text) == [text]:
            plain[text] = i
    texts = list(plain)
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, encoded) if e.ids == [plain[t]])


class Counter(dict):
    """Pre-token -> number of tokens: 1 for proven whole tokens, else the library's merges, remembered."""

    def __init__(self, path: str, whole: frozenset[str], outside: str):
        super().__init__(dict.fromkeys(whole, 1))
        self.path, self.whole, self.outside = path, whole, _search(outside)
        self.find, self.split = pre_tokens().findall, None
        if marks := specials(path):
            self.split = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True))))

    def __missing__(self, token: str) -> int:
        n = len(load(self.path).encode(token, add_special_tokens=False).ids)
        if len(self) > len(self.whole) + CACHE_ENTRIES:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        if len(token) <= 64:
            self[token] = n
        return n

    def count(self, text: str) -> int:
        if not text.isascii() and self.outside(text):
            return len(load(self.path).encode(text, add_special_tokens=False).ids)
        parts = self.split.split(text) if self.split is not None else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.find(p))) for p in parts)


_counters: dict[str, Counter] = {}


def counter(path: str, whole: frozenset[str], outside: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path, whole, outside)
    return _counters[path]


@functools.cache
def fast_encoder(path: str):
    """tiktoken over the merges of the same file; its ranks are the file's ids, so it gives the same ids."""
    import public_tokenizers
    import tiktoken

    alphabet = byte_alphabet()
    special = specials(path)
    ranks = {
        bytes(alphabet[c] for c in token): i
        for token, i in load(path).get_vocab(with_added_tokens=False).items()
        if token not in special
    }
    return tiktoken.Encoding(
        "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )


def ids(path: str, text: str, outside: str):
    """Token ids of a whole text as ``tokenizers`` gives them, without added special tokens; ``outside`` from :func:`exceptions`."""
    if not text.isascii() and _search(outside)(text):
        return load(path).encode(text, add_special_tokens=False).ids
    return fast_encoder(path).encode_to_numpy(text, allowed_special="all")


def has_exceptions(text: str, outside: str) -> bool:
    return not text.isascii() and _search(outside)(text)


def plain_ids(path: str, text: str, outside: str):
    """Token ids of a whole text in which special strings are plain text; ``outside`` from :func:`exceptions`."""
    if has_exceptions(text, outside):
        return load_plain(path).encode(text, add_special_tokens=False).ids
    return fast_encoder(path).encode_to_numpy(text, disallowed_special=())
