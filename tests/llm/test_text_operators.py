"""Collocations, piece encoding and alignment of tokenizers against plain versions and the libraries."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor
from tokenizers import Tokenizer

from homeround.llm import alignment, bpe, collocations, pieces, queries
from homeround.llm.common import written
from homeround.llm.queries import piece_model, tokenizer

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ATOMS = [
    "a", "b", "the", " ", "  ", "\t", "\n", "é", "é", "ﬁ", "①", "ｶﾞ", "한", "한", "😀", "​", " ",
    "　", "▁", "<s>", "</s>", "<unk>", "<|endoftext|>", "\x00", "\x7f", "\x1c", "\x85", "ß", "١", "中文", "Å", "Å", "…", "<0x41>", "hello",
    "ünïcode", "'s", "'S", "12", "!", "...", "͸",
]


def mixed(seed, n):
    rng = random.Random(seed)
    return ["", " ", "  ", "​", "​ ", "a ", " a", "▁", "a▁", "   x"] + ["".join(rng.choice(ATOMS) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, *mixed(1, 150), "again and again " * 30, "again and again " * 30, "x" * 30_000, "word " * 6_000, "der der Der, DER der"]
    rows = [(i, t, ["en", "de", None, ""][i % 4], "clash", 1, "y") for i, t in enumerate(texts)] + [(3, "again and again", "en", "clash", 2, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, block int, n_best string")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]


def _varint(n):
    return bytes([n & 127 | 128]) + _varint(n >> 7) if n > 127 else bytes([n])


def _message(number, body):
    return bytes([number << 3 | 2]) + _varint(len(body)) + body


@pytest.fixture(scope="module")
def models(tmp_path_factory):
    """The model, the same with a compiled character map and each way of treating spaces, and one whose unknown characters are not bytes."""
    with open(piece_model(), "rb") as f:
        raw = f.read()
    proto = SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto
    nfkc = next(v for n, v in pieces._fields(proto() if callable(proto) else proto) if n == 3)
    made = [raw + _message(3, nfkc + extra) for extra in (b"\x20\x01", b"\x20\x00", b"\x20\x01\x18\x00", b"\x20\x01\x28\x00")]
    unknown = b"".join(_message(n, v) for n, v in pieces._fields(raw) if not (n == 1 and dict(pieces._fields(v)).get(3) == 6))
    made.append(unknown + _message(2, b"\x98\x02\x00"))
    folder = tmp_path_factory.mktemp("models")
    paths = [piece_model()]
    for i, model in enumerate(made):
        (folder / f"{i}.model").write_bytes(model)
        paths.append(str(folder / f"{i}.model"))
    return paths


def test_pieces_and_their_byte_spans_are_those_of_the_library(models):
    for k, path in enumerate(models):
        model, library = pieces.load(path), SentencePieceProcessor(model_file=path)
        assert (model.map is not None) == (1 <= k <= 4) and model.apart == (k < 4)
        given = mixed(k, 1_500)
        for text, (ids, starts, ends) in zip(given, model.encode(given)):
            expected = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
            assert list(zip(ids.tolist(), starts.tolist(), ends.tolist())) == expected, (k, text)


def test_longest_prefix_of_the_character_map(models):
    model = pieces.load(models[1])
    assert model.map.longest("éx".encode(), 0) == (3, "é".encode())  # longer than the key e alone would be
    text, source = model.normalise("aﬁ ①")
    assert text == "▁afi▁1" and source.tolist() == [0, 0, 0, 0, 1, 1, 4, 4, 4, 5, 8]


def test_few_words_are_remembered(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 3)
    model = pieces.PieceModel(piece_model())
    for text in ("one two three four five six", "six one seven", "", "two two two eight nine ten", "long" * 40):
        assert model.encode([text, text])[1][0].tolist() == model.library.encode(text)
    assert len(model.words.new) <= 8


def test_encoding(docs, texts):
    library = SentencePieceProcessor(model_file=piece_model())
    got = pieces.digests(pieces.encode(docs, piece_model()))
    assert got.columns == ["doc_id", "text", "lang", "block", "n_best", "n_tokens", "ids_sha256", "decoded_sha256", "end_byte"]
    expected = []
    for i, t, _ in texts:
        ids = library.encode(t)
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len(t.encode())))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "end_byte").collect()) == sorted(expected)
    assert pieces.encode(docs.where("1 = 0"), piece_model()).count() == 0


def test_spans_cover_the_text(docs):
    for r in pieces.encode(docs, piece_model(), keep=["text"]).collect():
        data = (r.text or "").encode()
        assert b"".join(data[i:j] for i, j in zip(r.starts, r.ends)) == data


def plain_alignment(a, b, a_bytes, b_bytes):
    ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
    ea, eb = ends(a, a_bytes), ends(b, b_bytes)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        u, v = ea.index(cut) + 1, eb.index(cut) + 1
        groups.append(",".join(map(str, a[i:u])) + "|" + ",".join(map(str, b[j:v])))
        i, j = u, v
    links = [(a[p], b[q]) for p in range(len(a)) for q in range(len(b)) if ([0, *ea][p]) < eb[q] and ([0, *eb][q]) < ea[p]]
    return groups, links


def test_alignment(spark, docs, texts):
    path, library = tokenizer(), SentencePieceProcessor(model_file=piece_model())
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    a_bytes, b_bytes = bpe.token_bytes(path), pieces.load(piece_model()).bytes
    short = docs.where("length(text) < 1000 OR text IS NULL")
    expected = []
    for i, t, _ in texts:
        if len(t) >= 1000:
            continue
        a, b = (plain.encode(" " + t, add_special_tokens=False).ids, library.encode(t)) if t else ([], [])
        whole = (" " + t).encode()
        if b"".join(a_bytes[x] for x in a) != whole or b"".join(b_bytes[x] for x in b) != whole:
            a, b = [], []
        expected.append((i, a, b, *plain_alignment(a, b, a_bytes, b_bytes)))
    assert any(not e[1] for e in expected if e[0]) and sum(bool(e[1]) for e in expected) > 100
    held = collections.Counter(p for e in expected for p in set(e[4]))
    most = collections.defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    rows = [(i, len(a), len(b), len(g), len(k), ";".join(g), sum(held[p] == most[p[0]] for p in k), sum(held[p] for p in k)) for i, a, b, g, k in expected]
    got = alignment.link_counts(written(alignment.align(short, path, piece_model()), "aligned"))
    assert got.columns == ["doc_id", "text", "lang", "ids", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert sorted(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect()) == sorted(rows)
    nothing = alignment.link_counts(written(alignment.align(docs.where("1 = 0"), path, piece_model()), "aligned"))
    assert nothing.count() == 0
    long = alignment.align(docs.where("length(text) >= 1000"), path, piece_model()).select("text", "n_a", "n_b", "n_links").collect()
    assert all(r.n_a and r.n_links >= max(r.n_a, r.n_b) for r in long)


def test_runs_of_any_length_are_skipped_and_groups_are_whole():
    rng = np.random.default_rng(5)
    for n in (1, 2, 11, 12, 13, 400):
        for keep in (0.0, 0.3, 0.9, 0.99, 1.0):
            edges = np.cumsum(rng.integers(1, 5, n)).astype(np.int32)
            side = lambda: np.append(edges[:-1][rng.random(n - 1) < keep], edges[-1]).astype(np.int32)
            a, b = side(), side()
            runs, links, groups = alignment.diagonal_groups(a, b)
            ends = sorted([int(a[i + k]) for i, _, m in runs for k in range(m)] + [int(a[i - 1]) for i, _ in groups])
            assert ends == sorted(set(a.tolist()) & set(b.tolist()))
            assert all((a[i : i + m] == b[j : j + m]).all() for i, j, m in runs)
            low = lambda x, i: x[i - 1] if i else 0
            every = {(i, j) for i in range(len(a)) for j in range(len(b)) if low(a, i) < b[j] and low(b, j) < a[i]}
            found = [(int(i + k), int(j + k)) for i, j, m in runs for k in range(m)] + [tuple(x) for x in links.tolist()]
            assert len(found) == len(set(found)) and set(found) == every


def plain_phrases(texts, least, top, longest=5, cover=100):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in texts:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", text.translate(LOW)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f[lang].update(" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, longest + 1) if i + k <= len(w))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if a >= least and " " in p}
        rows = []
        for p, a in found.items():
            if any(len(q.split(" ")) > len(p.split(" ")) and f" {p} " in f" {q} " and 100 * b >= cover * a for q, b in found.items()):
                continue
            w = p.split(" ")
            cuts = []
            for k in range(1, len(w)):
                left, right = count[" ".join(w[:k])], count[" ".join(w[k:])]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            rows.append((-score, -a, p.encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return out


@pytest.mark.parametrize("bits", [4, 27])  # 4: all counters reach the threshold
@pytest.mark.parametrize("least, top, longest, cover", [(3, 50, 5, 100), (2, 5, 3, 60)])
def test_collocations(spark, docs, bits, least, top, longest, cover):
    rng = random.Random(9)
    made = [" ".join(rng.choice(["red", "Red", "green", "blue sky", "é", "n,o", "x\ty", "zz.z", "\x0b", "\x00"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    more = spark.createDataFrame([(t, ["en", "fr", None][i % 3]) for i, t in enumerate(made)], "text string, lang string")
    every = docs.select("text", "lang").unionByName(more)
    got = collocations.mine(every, least, top, longest, bits=bits, cover=cover)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes[3:]} == {"bigint"}
    expected = plain_phrases([(0, r.text or "", r.lang) for r in every.collect()], least, top, longest, cover)
    assert len(expected) > 15 and sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_products_beyond_64_bits(spark):
    counts = [("en", 0, "", 4 * 10**15), ("en", 1, "a", 3 * 10**15), ("en", 1, "b", 2 * 10**15 + 1), ("en", 2, "a b", 10**15 + 7)]
    got = collocations.score_phrases(spark.createDataFrame(counts, "lang string, size int, phrase string, f long")).collect()
    assert [r.score for r in got] == [1000 * (10**15 + 7) * 4 * 10**15 // (3 * 10**15 * (2 * 10**15 + 1))]


def test_collocations_of_an_empty_table(docs):
    assert collocations.mine(docs.where("1 = 0"), bits=12).count() == 0


def test_collocation_sql(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang").where("text NOT LIKE '%' || chr(0) || '%' OR text IS NULL").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_collocations(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = con.execute(queries.ORACLE_SQL["op11_collocations"]).fetchall()
    assert rows and sorted(tuple(r) for r in got) == sorted(rows)
