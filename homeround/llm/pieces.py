"""SentencePiece encoding with byte spans of the original text, and decoding.

The model's own normalisation runs here, so that each normalised byte keeps the place it came from; the library then encodes the
normalised text under the same model with its normalisation switched off, and each piece is projected back. A BPE model none of whose
pieces continues past a word's end into the next space encodes each word by itself, so words met before are looked up.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TextBlock, annotate

SPACE = "▁"
CACHE_ENTRIES = 200_000
LIST = pa.list_(pa.field("element", pa.int32()))


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, message[at : at + size]
            at += size


class CharMap:
    """A compiled character map: a double-array trie of UTF-8 keys, each with its replacement."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist()
        self.values = blob[4 + size :]
        self.root = self._offset(self.units[0])
        first = [b for b in range(1, 256) if self._step(self.root, b) is not None]
        #: Whether a key may begin with these two bytes, or is the first alone: other places need no walk.
        self.begins = np.zeros((256, 256), bool)
        for b in first:
            node = self._step(self.root, b)
            self.begins[b] = self.units[node] >> 8 & 1
            below = node ^ self._offset(self.units[node])
            for c in range(1, 256):
                if self._step(below, c) is not None:
                    self.begins[b, c] = True

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def _step(self, base: int, label: int) -> int | None:
        at = base ^ label
        return at if at < len(self.units) and self.units[at] & 0x800000FF == label else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key that begins at a place."""
        base, found = self.root, None
        for k in range(at, len(data)):
            node = self._step(base, data[k])
            if node is None:
                break
            unit = self.units[node]
            base = node ^ self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[base] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.values[found[1] : self.values.index(b"\0", found[1])]


class Words:
    """Parts of texts with their ids as bytes of 32-bit numbers. Of short parts, those met in the last or last but one 200,000 are remembered."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode, self.new, self.old = encode, {}, {}

    def of(self, parts: list[bytes]) -> list[bytes]:
        found = list(map(self.new.get, parts))
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = ids = self.old.get(part := parts[i])
                if ids is None:
                    missing.append(i)
                else:
                    self.new[part] = ids
        for i, ids in zip(missing, self.encode([parts[i].decode() for i in missing]) if missing else ()):
            ids = found[i] = array("i", ids).tobytes()
            if len(part := parts[i]) <= 64:
                self.new[part] = ids
        if len(self.new) > CACHE_ENTRIES:
            self.old, self.new = self.new, {}
        return found

    def ids(self, texts: list[bytes], cuts: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
        """Ids of each text from those of its parts; what the texts have in common is looked up once. ``cuts``: where parts begin in the joined texts, with two zero bytes after them."""
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=first[1:])
        if first[-1] > 2**31 - 1:  # beyond 32-bit offsets: by halves, one text whole
            if len(texts) == 1:
                return [np.array(self.encode([texts[0].decode()])[0], np.int32)]
            half = len(texts) // 2
            return self.ids(texts[:half], cuts) + self.ids(texts[half:], cuts)
        data = np.frombuffer(b"".join([*texts, b"\0\0"]), np.uint8)
        begins = np.sort(np.concatenate([cuts(data), first]))
        begins = begins[np.append(True, begins[1:] != begins[:-1])]
        parts = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        which = parts.indices.to_numpy()
        found = self.of(parts.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        counts = sizes[which]
        ends = np.cumsum(counts)
        ids = np.frombuffer(b"".join(found), np.int32)[np.repeat(starts[which] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[np.searchsorted(begins, first)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _before_spaces(data: np.ndarray) -> np.ndarray:
    """Where runs of the space mark begin."""
    space = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
    return space[np.append(True, np.diff(space) > 3)] if len(space) else space


class PieceModel:
    """A SentencePiece model in a task."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            raw = f.read()
        spec, trainer, names, kinds = {}, {}, [], []
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                names.append(bytes(piece[1]))
                kinds.append(piece.get(3, 1))
            elif number == 2:
                trainer |= dict(_fields(value))
            elif number == 3:
                spec |= dict(_fields(value))
        self.map = CharMap(spec[2]) if spec.get(2) else None
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        symbols = sorted((n for n, k in zip(names, kinds) if k == 4), key=len, reverse=True)
        self.symbols = re.compile(b"|".join(map(re.escape, symbols))) if symbols else None
        # normalisation off: later fields of a message override earlier ones
        off = b"\x12\x00\x18\x00\x20\x00\x28\x00"
        self.bare = SentencePieceProcessor(model_proto=raw + b"\x1a" + bytes([len(off)]) + off)
        self.library = SentencePieceProcessor(model_proto=raw)
        byte = [k == 6 for k in kinds]
        self.size = np.array([1 if b else len(n) for n, b in zip(names, byte)], np.int32)
        self.bytes = [bytes([int(n[3:5], 16)]) if b else n.replace(SPACE.encode(), b" ") for n, b in zip(names, byte)]
        self.unknown = None if trainer.get(35, 0) else self.bare.unk_id()
        #: The proof that words are encoded by themselves: no piece holds a space after another character, unknown ones become bytes.
        inside = re.compile(f"[^{SPACE}]{SPACE}")
        apart = trainer.get(3, 1) == 2 and self.escape and not symbols and self.unknown is None
        self.apart = apart and not any(inside.search(n.decode()) for n in names)
        self.words = Words(self._encode)
        self.plain = self.map is None and self.symbols is None and not self.squeeze and self.escape and not self.suffix

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the byte of ``text`` it came from."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int32)
        if self.plain:
            given = np.frombuffer(data, np.uint8)
            source = np.arange(len(given), dtype=np.int32)
            if not text.isascii():  # the later bytes of a character come from its first
                source[given & 0xC0 == 0x80] = 0
                source = np.maximum.accumulate(source)
            source = np.repeat(source, 1 + 2 * (given == 32))
            lead = np.zeros(3 if self.prefix else 0, np.int32)
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE), np.concatenate([lead, source, np.array([len(given)], np.int32)])
        return self._normalise(data)

    def _chunks(self, data: bytes) -> Iterator[tuple[bytes, int, int, bool]]:
        """(output, begin, end, whether it replaces the input as one unit) of stretches, longest prefixes of the map first."""
        given = np.frombuffer(data + b"\0", np.uint8)
        alive = np.zeros(len(data), bool)
        if self.map is not None:
            alive = self.map.begins[given[:-1], given[1:]] & (given[:-1] & 0xC0 != 0x80)
        if self.symbols is not None:
            starts = {p[0] for p in (bytes([b]) for b in range(256)) if re.match(b"(?s)" + re.escape(p), p)}
            alive |= np.isin(given[:-1], list(starts)) & (given[:-1] & 0xC0 != 0x80)
        done = 0
        for at in np.flatnonzero(alive).tolist():
            if at < done:
                continue
            if self.symbols is not None and (m := self.symbols.match(data, at)):
                n, out = m.end() - at, m[0]
            elif self.map is not None and (hit := self.map.longest(data, at)):
                n, out = hit
            else:
                continue
            if at > done:
                yield data[done:at], done, at, False
            yield out, at, at + n, True
            done = at + n
        if done < len(data):
            yield data[done:], done, len(data), False

    def _normalise(self, data: bytes) -> tuple[str, np.ndarray]:
        out, source, lead = [], [], []
        heading = None  # where the text begins: after units that are one space
        for piece, begin, end, unit in self._chunks(data):
            value = np.frombuffer(piece, np.uint8)
            if heading is None and piece != b" " and (unit or piece.strip(b" ")):
                heading = begin if unit else end - len(piece.lstrip(b" "))
            out.append(value)
            if unit:  # its bytes all come from where it begins
                source.append(np.full(len(value), begin, np.int32))
                lead.append(np.cumprod(value == 32).astype(bool))
            else:  # each character is a unit: its later bytes come from its first
                at = np.arange(begin, end, dtype=np.int32)
                source.append(np.maximum.accumulate(np.where(value & 0xC0 == 0x80, 0, at)))
                lead.append(value == 32)
        out, source, lead = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((out, np.uint8), (source, np.int32), (lead, bool)))
        end, first = len(data), 0
        if self.squeeze:
            # a unit's leading spaces go where what stands before it, if anything, ends with a space
            begins = np.append(True, source[1:] != source[:-1]) if len(out) else np.zeros(0, bool)
            before = np.append(True, out[:-1] == 32) if len(out) else begins
            unit = np.maximum.accumulate(np.where(begins, np.arange(len(out)), 0))
            kept = ~(lead & before[unit]) if len(out) else begins
            if heading is None:
                return "", np.zeros(1, np.int32)
            first, out, source = heading, out[kept], source[kept]
        mark = SPACE.encode() if self.escape else b" "
        spaces = np.where(out == 32, len(mark), 1)
        text = out.tobytes().replace(b" ", mark)
        source = np.repeat(source, spaces)
        if self.prefix and not self.suffix:
            text = mark + text
            source = np.concatenate([np.full(len(mark), first, np.int32), source])
        if self.squeeze:
            while text.endswith(mark):
                text = text[: -len(mark)]
                end = int(source[len(text)])
            source = source[: len(text)]
        if self.prefix and self.suffix:
            text += mark
            source = np.concatenate([source, np.full(len(mark), end, np.int32)])
        return text.decode(), np.append(source, np.int32(end)).astype(np.int32)

    def ids(self, normalised: list[str]) -> list[np.ndarray]:
        """Ids of each normalised text."""
        if not self.apart:
            return [np.array(i, np.int32) for i in self._encode(normalised)]
        return self.words.ids([t.encode() for t in normalised], _before_spaces)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return self.bare.encode(texts, num_threads=1)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first byte, byte after the last) of each text's pieces. Of a character given as byte pieces the last piece has the span."""
        normalised = list(map(self.normalise, texts))
        out = []
        for (text, source), ids in zip(normalised, self.ids([n for n, _ in normalised])):
            if self.unknown is not None and (ids == self.unknown).any():  # of unknown length
                pieces = self.bare.encode(text, return_type="proto").pieces
                ids = np.array([p.id for p in pieces], np.int32)
                edges = np.array([0, *(p.end for p in pieces)], np.int64)
            else:
                edges = np.concatenate([[0], np.cumsum(self.size[ids], dtype=np.int64)])
            out.append((ids, source[edges[:-1]], source[edges[1:]]))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@functools.cache
def load(path: str) -> PieceModel:
    return PieceModel(path)


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    """One list of 32-bit numbers a row."""
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    values = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32, copy=False)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), type=LIST)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (no begin or end ids), ``starts`` and ``ends`` of the pieces in the text's UTF-8 bytes, and ``decoded``; one pass, no shuffle.

    ``model_path``: a SentencePiece model. Its compiled character map is applied by longest prefixes, every output byte remembering
    where it came from, so spans hold after any normalisation: a piece covers the input that its characters replaced. Text that the
    normalisation drops belongs to no piece or to the one before it. ``decoded`` is the library's decoding of the ids.

    Null or empty text: empty lists and ''. Repeated rows each get their row. An input column named like an output column is
    replaced. Empty table: empty result. Very long texts are held one at a time.
    """
    array = T.ArrayType(T.IntegerType())
    fields = [T.StructField(n, array) for n in ("ids", "starts", "ends")] + [T.StructField("decoded", T.StringType())]

    def compute(block: TextBlock) -> list:
        model = load(model_path)
        found = model.encode(block.strings())
        return [lists([r[k] for r in found]) for k in range(3)] + [pa.array([model.decode(r[0].tolist()) for r in found], pa.string())]

    return annotate(docs, compute, fields, text_col, keep)


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of :func:`encode`'s lists: ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``end_byte``, where the last piece ends."""
    return encoded.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256),
            "decoded_sha256": F.sha2("decoded", 256),
            "end_byte": F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)),
        }
    ).drop("ids", "starts", "ends", "decoded")
