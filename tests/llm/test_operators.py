"""Each operator on small awkward tables against a plain version."""

import collections
import hashlib
import os
import re
import time
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from homeround.llm import bpe, decontaminate, graph_ann, language, licenses, near_copies, packing, pii, repeats, simhash, token_counts, url_filter
from homeround.llm.queries import tokenizer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = " ".join(f"passage{i}" for i in range(40))
ITEM = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    None, "", "   \n", "Hello, <|endoftext|> World ", "ÉTÉ naïve straße 日本語 ελληνικά",
    "under the MIT licence and Apache License, Version 2.0; CC-BY-NC", "Under the mit license. under the MIT License!",
    f"a {PASSAGE} b", f"zz {PASSAGE} yy", PASSAGE, PASSAGE, f"x {ITEM} y two three", "five six seven eight nine ten eleven twelve one two",
    "mail a.b@host.example.org now +1 (415) 555-0100 or 10.1.2.3.4 and 4111 1111 1111 1111 or 4111111111111112", "short item",
    "word " * 3000, "abc" * 400, "q" * 5000, "near copy " + " ".join(f"w{i}" for i in range(300)), "near copy " + " ".join(f"w{i}" for i in range(299)) + " zz",
]


def words(t):
    return WORD.findall((t or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None, "clash", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, "s", "clash", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens string, n_words int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_fast_ways_agree_with_the_library_on_each_assigned_character():
    path = tokenizer()
    outside = bpe.exceptions(path)
    count = bpe.counter(path, bpe.whole_tokens(path), outside).count
    safe = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cs", "Co", "Cn") and not re.search(outside, c)]
    assert len(safe) > 140_000 and {"é", "ж", "λ", "日", "ひ", "”", "—", "😀"} <= set(safe)
    for i in range(0, len(safe), 50):
        t = "".join(f"{c}a{c}b {c}{c} 1{c}!{c}\n{c}'s  {c}\n" for c in safe[i : i + 50])
        ids = bpe.load(path).encode(t, add_special_tokens=False).ids
        assert list(bpe.ids(path, t, outside)) == ids and count(t) == len(ids), repr(t)
    for t in ("\U000e0080", "a\u0378b", "x <|endoftext|> ж", "日本語の文。" * 50, "Привет, мир! Ещё раз"):
        ids = bpe.load(path).encode(t, add_special_tokens=False).ids
        assert list(bpe.ids(path, t, outside)) == ids and count(t) == len(ids), repr(t)


def test_token_counts(docs, empty):
    path = tokenizer()
    got = token_counts.over_limit(token_counts.count_tokens(docs, path), 1024)
    for r in got.collect():
        n = len(bpe.load(path).encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 1024)
    assert got.columns.count("n_tokens") == 1 and token_counts.count_tokens(empty, path).count() == 0


def test_license_scan(docs, empty):
    got = licenses.scan(docs, keep=["doc_id", "text"]).collect()
    for r in got:
        w = words(r.text)
        found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(found))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    fuzzy = next(r for r in got if r.doc_id == 5)
    assert "mit" in fuzzy.labels and 0.8 < fuzzy.score <= 1
    assert licenses.scan(empty).count() == 0


def test_license_search_finds_what_the_patterns_find_in_whole_texts(spark):
    rng = np.random.default_rng(7)
    letters = "abcdefgilmnoprstuy "
    texts = []
    for _ in range(600):
        notice, edits, after, _ = licenses.NOTICES[rng.integers(len(licenses.NOTICES))]
        t = list(notice + after)
        for _ in range(rng.integers(0, edits + 3)):
            at, how = int(rng.integers(len(t))), rng.integers(3)
            t[at : at + (how != 0)] = [] if how == 2 else [letters[rng.integers(len(letters))]]
        texts.append(" ".join(["the", *"".join(t).split(), "of", "x"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(docs, keep=["doc_id", "text"]).collect():
        joined = " ".join(words(r.text)).encode()
        want = {label for p, label in licenses.PHRASES.items() if f" {p} " in f" {joined.decode()} "}
        for _, pattern, _, _, label in licenses._fuzzy(licenses.NOTICES):
            if any(m.group().strip() for m in pattern.finditer(joined, overlapped=True)):
                want.add(label)
        assert r.labels == ",".join(sorted(want)), r.text


@pytest.mark.parametrize("parts", [1, 3])
def test_decontamination(spark, docs, empty, parts):
    items = [("a", ITEM), ("b", "Short  ITEM"), (None, "zz"), ("c", None), ("d", ""), ("a", ITEM), ("e", " ".join(ITEM.split()[::-1]))]
    table = spark.createDataFrame(items, "item_id string, text string")
    how = {} if parts == 1 else {"part_bytes": sum(len(t or "") for _, t in items) // parts, "pass_bytes": 1}
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    for r in decontaminate.find_items(docs, table, keep=["doc_id", "text"], **how).collect():
        w, ids = words(r.text), set()
        hit = np.zeros(len(w), bool)
        for g, own in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit[k : k + len(g)], ids = True, ids | own
        assert (r.n_words, r.n_hit, r.item_ids) == (len(w), hit.sum(), sorted(ids - {None})), r.doc_id
    clean = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, table, **how).collect()}
    assert 14 not in clean and clean[0] is None and ITEM not in clean.get(11, "")
    assert clean[9] == TEXTS[9] and decontaminate.find_items(empty, table).count() == 0
    assert decontaminate.find_items(docs, table.where("1 = 0")).where("n_hit > 0").count() == 0


def test_language(spark, empty):
    base = {"en": "the and of to in that was with have this", "de": "der die und das nicht mit sich auch werden für", "fr": "le la les des est dans une pour qui avec été"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(base[k].split(), 60)), k) for i, k in enumerate(np.repeat(list(base), 60).tolist())]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !!", "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    net = language.fit(table, "lang", language.fold("doc_id") != 2)
    got = language.predict(table.withColumn("held_out", language.fold("doc_id") == 2), net).collect()
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)[-3:]] == ["und"] * 3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert language.fit(empty) is None and language.predict(empty, None).count() == 0
    kept = language.keep_determined(table, net)
    assert kept.columns == table.columns and kept.where("doc_id >= 900").count() == 0
    copies = spark.range(1000, 6000).select(F.col("id").alias("doc_id"), F.lit(rows[0][1]).alias("text"), F.lit("en").alias("lang"), F.lit("clash").alias("score"))
    crowded = language.fit(table.union(copies), per_label=50)  # copies count once, so they do not push other texts out of the sample
    found = language.predict(table, crowded).where("doc_id < 900").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95


def test_network_is_a_convolution():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, language.CLASSES, (5, language.WINDOW)).astype(np.uint8)
    truth = np.array([0, 1, 2, 1, 0])
    net = language.train(windows, truth, ["a", "b", "c"], epochs=1, batch=5)

    def loss(n):
        out = []
        for x, y in zip(windows, truth):
            pooled = []
            for j, w in enumerate(language.WIDTHS):
                for f in range(language.FILTERS):
                    sums = [sum(n.tables[w][k][x[p + k], f] for k in range(w)) for p in range(language.WINDOW - 3)]
                    pooled.append(max(sums) + n.bias[j * language.FILTERS + f])
            z = np.maximum(pooled, 0) @ n.dense + n.out_bias
            out.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        return np.array(out)

    assert np.allclose(loss(net), net.probabilities(windows, net.pair_tables()), atol=1e-5)
    again = language.train(windows, truth, ["a", "b", "c"], epochs=30, batch=5)
    before, after = (-np.log(loss(n)[np.arange(5), truth]).mean() for n in (net, again))
    assert after < before / 3  # its gradient leads down
    assert len(set(language.BYTE_CLASS["ж".encode()[0]] for _ in "x") | {language.BYTE_CLASS[b] for b in "жи".encode()}) == 3


def test_letters_are_needed_for_a_language(spark):
    docs = spark.createDataFrame([(0, "½ ² Ⅷ ①"), (1, "٣ 12"), (2, "ж"), (3, "_")], "doc_id long, text string")
    rows = spark.createDataFrame([(9, "one two three", "en"), (8, "un deux trois", "fr")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, language.fit(rows)).collect()}
    assert [got[0], got[1], got[3]] == ["und"] * 3 and got[2] in ("en", "fr")


def test_packing(docs, empty):
    path, limit = tokenizer(), 64
    rows = packing.pack(docs, path, limit).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limit
    want = collections.Counter()
    for i, t in texts_of(docs):
        ids = np.array([*bpe.load(path).encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % limit + 1, len(ids) + 1, limit)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert len(by_sequence) <= sum(r.length for r in rows) / limit + 2
    assert packing.pack(empty, path).count() == 0


def test_graph_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0, None]), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = graph_ann.nearest(table, table.where("vec_id % 20 = 0"), 20, shard=256).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r.query_id].append((r.vec_id, r.score))
    recall = []
    for q in range(0, 600, 20):
        scores = x.astype(float) @ x[q].astype(float)
        scores[q] = -np.inf
        best = sorted(range(600), key=lambda i: (-scores[i], i))[:20]
        recall.append(len({i for i, _ in found[q]} & set(best)) / 20)
        assert len(found[q]) == 20 and all(abs(s - scores[i]) < 1e-9 for i, s in found[q])
    assert set(found) == set(range(0, 600, 20)) and np.mean(recall) >= 0.9
    assert [i for i, _ in found[100]][:3] == [101, 102, 103]
    assert graph_ann.nearest(table.where("1 = 0"), table, 5).count() == 0 and graph_ann.nearest(table, table.where("1 = 0"), 5).count() == 0


def test_graph_search_keeps_sizes_apart_and_takes_ids_of_any_kind(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i:03}", rng.normal(size=4 if i % 3 else 6).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(graph_ann.nearest(table, table, 7).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    for i, v in rows:
        best = sorted(((-float(np.dot(v, w)), j) for j, w in rows if j != i and len(w) == len(v)))[:7]
        assert [j for j, _ in got[i]] == [j for _, j in best] and np.allclose([s for _, s in got[i]], [-s for s, _ in best])


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.b.org", "/x", "block"), ("b.org", "/x/yy", "allow"), ("org", "/x", "allow"), ("org", "/x", "block")]
    hosts = ["net", "x.net", "Example.NET", "w.example.net", "notexample.net", "a.b.org", "z.a.b.org", "b.org", "org", "com", ""]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/1", "/en", "/x/yy/z?q#f", "?/en/", "#/x")] * 3 + [None, "", "nourl", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for r in url_filter.judge_urls(pages, table, rows_a_range=10).collect():
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.translate(LOW)
        fits = [(len(h) + len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[2], best[3]), u
    assert url_filter.judge_urls(pages.where("1 = 0"), table).count() == 0


def after_removal(rows, length):
    """(id, bytes, removed, runs, hash) of each row by counting every window."""
    raws = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + length] for t in raws for i in range(len(t) - length + 1))
    want = collections.Counter()
    for (i, _), t in zip(rows, raws):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        want[i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()] += 1
    return want


@pytest.mark.parametrize("group", [2048, 1])
def test_repeats(docs, empty, group):
    got = repeats.remove_repeats(docs, group=group).collect()
    assert collections.Counter(tuple(r) for r in got) == after_removal(texts_of(docs), 200)
    assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("length", [40, 1200])
def test_repeats_of_other_lengths(spark, length):
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = text(2368)
    rows = [(i, text(50) + shared[: 2368 - 100 * (i % 3)] + text(40)) for i in range(8)] + [(8, text(3000)), (9, shared[:1199]), (10, shared[5:1205])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.remove_repeats(table, length).collect()
    assert collections.Counter(tuple(r) for r in got) == after_removal(rows, length)
    with pytest.raises(ValueError):
        repeats.find_repeats(table, 20, 32)


def test_repeats_in_a_text_longer_than_a_stride(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRIDE", 1000)
    rng = np.random.default_rng(6)
    long = "".join(rng.choice(list("abcd"), 7000))
    rows = [(0, long + long[900:1300]), (1, long[1990:2200]), (2, long[:150])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in repeats.remove_repeats(table).collect()) == after_removal(rows, 200)


def test_run_length_index():
    index = repeats.RunLengthIndex([b"ab" * 100, b"ab" * 100, b"cd" * 50])
    assert index.runs < 30 and index.repeated(50)[:151].all() and not index.repeated(201).any()
    rng = np.random.default_rng(8)
    for _ in range(60):
        texts = [bytes(rng.choice(list(b"ab"), rng.integers(1, 40)).tolist()) for _ in range(rng.integers(1, 6))]
        texts += [texts[0][: rng.integers(1, 40)]]
        index = repeats.RunLengthIndex(texts)
        joined = b"".join(t + b"\0" for t in texts)
        neighbour, shared = index.matching_statistics()
        for at in range(index.n):
            a, b = (joined[p : joined.index(b"\0", p)] for p in (at, max(int(neighbour[at]), 0)))
            assert shared[at] == (len(os.path.commonprefix([a, b])) if neighbour[at] >= 0 else 0)
        for length in (2, 5, 9):
            seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
            want = [len(t[i : i + length]) == length and seen[t[i : i + length]] > 1 for t in texts for i in range(len(t) + 1)]
            assert index.repeated(length).tolist() == want


def test_simhash(docs, empty):
    rows = texts_of(docs)

    def fingerprint(t):
        from xxhash import xxh64_intdigest

        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    prints = [fingerprint(t) for _, t in rows]
    label = {i: i for i, _ in rows}
    for _ in rows:
        for (i, _), a in zip(rows, prints):
            label[i] = min([label[i], *(label[j] for (j, _), b in zip(rows, prints) if (a ^ b).bit_count() <= 3)])
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == sorted((i, p, label[i]) for (i, _), p in zip(rows, prints))
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v for v in label.values()}) and kept.columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0


def test_crowded_keys_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 63))
    values = {base}
    while len(values) < 400:
        v = base
        for b in rng.choice(64, 6, replace=False):
            v ^= 1 << int(b)
        values.add(v)
    values = np.array(sorted(values), np.uint64).view(np.int64)
    nodes = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "node long, fp long")
    edges = simhash.near_links(nodes, group=8).collect()

    def parts(pairs):
        up = list(range(len(values)))

        def find(a):
            while up[a] != a:
                a = up[a]
            return a

        for a, b in pairs:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(values))]

    v = values.view(np.uint64)
    close = [(i, j) for i in range(len(v)) for j in range(i) if np.bitwise_count(v[i] ^ v[j]) <= 3]
    assert parts([(r.a, r.b) for r in edges]) == parts(close)


def plain_spans(t):
    """The patterns as they are written, over the whole text."""
    number = lambda m: re.sub("[^0-9]", "", m.group())
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.group().split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(number(m)) <= 19 and luhn(number(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(number(m)) <= 15),
    }
    return [(k, *m.span()) for k, (pattern, fits) in kinds.items() for m in re.finditer(pattern, t) if fits(m)]


def plain_features(text, a, b):
    s = text[a:b]
    digits = "".join(c for c in s if c in "0123456789")
    n, dots, ats, letters = len(digits), s.count("."), s.count("@"), any(c.isalpha() for c in s)
    quad = len(s.split(".")) == 4 and all(p.isascii() and p.isdigit() and int(p) < 256 for p in s.split("."))
    left, right = text[a - 1 : a], text[b : b + 1]
    grouped = not letters and all(c in "0123456789 -" for c in s)
    return [
        1, 0 < n < 8, 8 <= n <= 15, 16 <= n <= 19, n > 19, ats == 1, ats > 1, ats == 1 and "." in pii.TOKEN.findall(s.rpartition("@")[2])[1:-1] and s[0] != "@", quad, dots == 3 and not quad,
        s[0] == "+", s[0] == "+" and 8 <= n <= 15 and not letters, s[0].isalnum(), s[-1].isalnum(), letters, letters and not ats, " " in s, "\t" in s, grouped, grouped and 16 <= n <= 19 and pii.luhn(digits),
        bool(left) and (left.isalnum() or left in "._%+-@"), right.isalnum() or right == "@", left == "+", s[0] in "(.-" or s[-1] in "(.-", not s.isascii(), "-" in s or "(" in s,
    ]


def test_spans_and_features_on_random_texts():
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(rng.choice(list("ab1234.@+-() \n\té_,:99"), rng.integers(1, 60)))
        assert pii.base_spans(text) == plain_spans(text), text
        lo = int(rng.integers(len(text)))
        spans = pii.Spans([("x@1", 0, 3, 3), (text, lo, len(text), len(text)), (text, 0, len(text), len(text))])
        i, j = spans.candidates()
        for piece, a, b, row in zip(spans.piece[i], spans.a[i], spans.b[j - 1], spans.rows(i, j).tolist()):
            a, b = int(a - spans.base[piece]), int(b - spans.base[piece])
            assert row == plain_features(text if piece else "x@1", a, b), (text, a, b)


def test_long_texts_take_linear_time_and_little_memory():
    weights = np.random.default_rng(0).normal(size=(4, pii.N_FEATURES))
    weights[:, 0] = -9
    for text in ("a" * 1_000_000 + "@ ", "a" * 1_000_000 + "@b.c", "a@" * 5_000, " ".join(str(k) for k in range(10_000))):
        tracemalloc.start()
        began = time.process_time()
        base = pii.base_spans(text)
        pii.learned_spans([text], weights, [base])
        assert time.process_time() - began < 30 and tracemalloc.get_traced_memory()[1] < 200_000_000
        tracemalloc.stop()
        assert base == ([("email", 0, 1_000_004)] if "b.c" in text else [])


def test_a_cut_region_gives_the_same_spans(monkeypatch):
    text = "x " + " ".join(f"mail{k}@host{k % 3}.org 10.0.{k}.1 +34 600 100 {k:03} 4111-1111-1111-1111" for k in range(60))
    weights = pii.train([(text[a - 5 : b + 5], [(k, 5, b - a + 5)]) for k, a, b in pii.base_spans(text)[::3] if a > 5])
    whole = pii.learned_spans([text], weights, [[]])
    monkeypatch.setattr(pii, "PART", 100)
    monkeypatch.setattr(pii, "STARTS", 7)
    assert pii.learned_spans([text], weights, [[]]) == whole and len(whole[0]) > 100


def test_personal_data(docs, empty):
    weights = pii.fit(docs)
    for r in pii.find_pii(docs, weights, keep=["doc_id", "text"]).collect():
        t = r.text or ""
        base = plain_spans(t)
        assert base == pii.base_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(r.spans.split(","))
        assert r.n_spans == len(list(filter(None, r.spans.split(","))))
    got = next(r for r in pii.find_pii(docs, None, keep=["doc_id"]).collect() if r.doc_id == 13)
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == (1, 1, 1, 1)
    clean = {r.doc_id: r.text for r in pii.redact(docs, weights).collect()}
    assert "<email>" in clean[13] and "@" not in clean[13] and clean[9] == TEXTS[9] and clean[0] is None
    assert pii.fit(empty) is None and pii.find_pii(empty, None).count() == 0


def test_field_is_a_distribution_over_segmentations():
    lattice = pii.Lattice("ab 12@x.y 34")
    weights = np.random.default_rng(2).normal(size=(4, pii.N_FEATURES))
    p, total = pii.expectation(lattice, weights)
    cover = np.zeros(lattice.n)
    for (i, j), row in zip(lattice.spans, p):
        cover[i:j] += row.sum()
    assert (p >= 0).all() and cover.max() <= 1 + 1e-9
    scores = lattice.rows @ weights.T
    best = np.full(lattice.n + 1, 0.0)  # over all spans, also those that score below 0
    for p in range(1, lattice.n + 1):
        best[p] = max([best[p - 1], *(best[i] + scores[k].max() for k, (i, j) in enumerate(lattice.spans.tolist()) if j == p)])
    decoder = pii.Decoder()
    for k, (i, j) in enumerate(lattice.spans.tolist()):
        if scores[k].max() > 0:
            decoder.add(lattice.starts[i], lattice.ends[j - 1], int(scores[k].argmax()), float(scores[k].max()))
    chosen = decoder.chosen()
    place = {(lattice.starts[i], lattice.ends[j - 1]): k for k, (i, j) in enumerate(lattice.spans.tolist())}
    assert sum(scores[place[a, b], kind] for kind, a, b in chosen) == pytest.approx(best[-1]) and best[-1] <= total + 1e-9


def test_near_copies_stage_agrees_with_brute_force(spark):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    line = "this very common line stands at the end of many of the texts that are here"
    texts = [None, "", " ", "one", "One ", "one two three four five six seven", "a b c d e f g h", "a b c d e f g h i", "x a b c d e f g h i"]
    for k in range(40):
        own = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(20, 160)))]
        for change in (0, 1, 2, 3, 4, 8):
            copy = list(own)
            for at in rng.integers(0, len(copy), change):
                copy[at] = f"new{rng.integers(0, 9999)}"
            texts.append(" ".join(copy) + (" " + line if k % 2 else ""))
    grown = [f"g{x}" for x in range(100)]  # a chain: its ends are not similar
    texts += [" ".join(grown[i : i + 50]) for i in range(0, 51, 3)]
    rows = [(int(i), t) for i, t in enumerate(rng.permutation(np.array(texts, object)).tolist())]

    def runs(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [runs(t) for _, t in rows]
    label = list(range(len(rows)))
    alike = [[j for j, b in enumerate(sets) if a == b or 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    for _ in rows:
        label = [min(label[j] for j in alike[i]) for i in range(len(rows))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.one_of_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label)) and kept.columns == docs.columns
    assert len(set(label)) < len(rows) - 60
    assert corpus_pipeline.one_of_near_copies(spark, docs.where("1 = 0"), "").count() == 0


def test_windows_stay_inside_their_text_where_an_item_has_one_word(spark):
    item = " ".join(f"k{i}" for i in range(12))
    items = spark.createDataFrame([("a", item), ("one", "zz"), ("three", "k9 zz k0")], "item_id string, text string")
    texts = [" ".join(item.split()[:6]), " ".join(item.split()[6:]), "zz", "zz k9", "zz", "k0 zz", None, "", "zz zz", item, "k9 zz k0", "plain zz"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.find_items(docs, items).collect()}
    assert [got[i][1] for i in range(12)] == [0, 0, 1, 1, 1, 1, 0, 0, 2, 12, 3, 1]
    assert [got[i][2] for i in (0, 1, 3, 9, 10)] == [[], [], ["one"], ["a"], ["one", "three"]]
    clean = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}
    assert clean[0] == texts[0] and clean[1] == texts[1] and clean[3] == " k9" and 2 not in clean and 10 not in clean


@pytest.mark.parametrize("keep_one", [simhash.keep_one, near_copies.keep_one])
def test_rows_without_or_with_one_id_lose_no_text(spark, keep_one):
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcd"]
    rows = [(None, texts[0], "x"), (None, texts[0], "x"), (None, texts[1], "x"), (7, texts[1], "x"), (8, texts[2], "x"), (8, texts[3], "x"), (8, texts[3], "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], rows[4], rows[5], rows[7]], key=str)
