"""The pipeline on a small awkward table: every row that a stage drops is accounted for by the stage's rule."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from homeround.llm import bpe, language, near_copies, pii
from homeround.llm.common import table, written
from homeround.llm.queries import tokenizer

WORDS = {
    "en": "the and of to in that was with have this from they will would there their what about which when".split(),
    "de": "der die und das nicht mit sich auch werden für ein eine ist dem den von zu auf im als".split(),
    "fr": "le la les des est dans une pour qui avec été sur pas plus par ce sont mais nous vous".split(),
}
ITEM = "what is the capital of the small country that lies beyond the seven hills and one river"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    text = lambda k, n: " ".join(rng.choice(WORDS[k], n))
    rows = [(i, text(k, 80), k, "web", 0) for i, k in enumerate(np.repeat(list(WORDS), 40).tolist())]
    base = text("en", 100).split()
    near = lambda *at: " ".join(w if i not in at else "changed" for i, w in enumerate(base))
    rows += [(200 + i, near(*at), "en", "web", 0) for i, at in enumerate([(), (), (40,), (10, 90), tuple(range(0, 100, 9))])]
    rows += [(300, None, "en", "web", 0), (301, "", None, "web", 0), (302, "123 456 !!", "de", "web", 0), (303, "½ ²", None, None, 0)]
    rows += [(None, text("de", 60), "de", None, 0), (None, text("de", 60), "de", None, 0), (7, text("fr", 70), "fr", "web", 0), (7, rows[7][1], "en", "web", 0)]
    rows += [(310, f"{text('en', 40)} {ITEM} {text('en', 40)}", "en", "web", 0), (311, f"{ITEM} {text('en', 3)}", "en", "web", 0)]
    rows += [(312, f"{text('fr', 50)} write to a.b@host.example.org or +34 600 100 200 {text('fr', 20)}", "fr", "web", 0), (313, " ".join([text("de", 60)] * 60), "de", "web", 0)]
    rows = [(*r[:4], None if r[1] is None else len(r[1])) for r in rows]
    path = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("a", ITEM), (None, None), ("b", "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def runs(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_account_for_every_row(spark, folder):
    docs = table(spark, folder, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near-copies", "benchmarks", "personal-data", "packing"]

    kept = written(stages["language"](spark, docs, folder), "t-language")
    network = language.fit(docs, "lang", language.fold("doc_id") != 2)
    found = language.predict(docs, network)
    known = found.where((found.lang_pred != "und") & (found.score >= 0.4)).select(*columns)
    assert kept.columns == columns and rows_of(kept) == rows_of(known)
    gone = rows_of(docs) - rows_of(kept)
    assert {r[0] for r in gone} == {300, 301, 302, 303}

    one = written(stages["near-copies"](spark, kept, folder), "t-near")
    rows = list(rows_of(kept).elements())
    sets, label = [runs(r[1]) for r in rows], list(range(len(rows)))
    alike = [[j for j, b in enumerate(sets) if a == b or 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    for _ in rows:
        label = [min(label[j] for j in alike[i]) for i in range(len(rows))]
    groups = collections.defaultdict(list)
    for i, k in enumerate(label):
        groups[k].append(rows[i])
    left = rows_of(one)
    assert one.columns == columns and sum(left.values()) == len(groups) < len(rows) - 3 and not left - rows_of(kept)
    for group in groups.values():
        (chosen,) = {r for r in group if r in left}
        assert chosen[0] == min((r[0] for r in group if r[0] is not None), default=None)

    clean = written(stages["benchmarks"](spark, one, folder), "t-clean")
    gone = left - rows_of(clean)
    assert clean.columns == columns and {r[0] for r in gone} == {310, 311}
    (cut,) = rows_of(clean) - left
    assert cut[0] == 310 and ITEM not in cut[1] and len(cut[1].split()) == 80 and cut[4] == len(cut[1])

    private = written(stages["personal-data"](spark, clean, folder), "t-private")
    before, after = {r[0]: r[1] for r in clean.collect()}, {r[0]: r[1] for r in private.collect()}
    assert private.columns == columns and private.count() == clean.count()
    assert {i for i in before if before[i] != after[i]} == {312} and "<email>" in after[312] and "<phone>" in after[312]
    assert not any(pii.base_spans(t or "") for t in after.values())

    packed = stages["packing"](spark, private, folder).collect()
    path = tokenizer()
    want = sum(len(bpe.load(path).encode(r.text or "", add_special_tokens=False).ids) + 1 for r in private.collect())
    assert sum(r.length for r in packed) == want and max(r.offset + r.length for r in packed) <= 2048


def test_near_copies_of_long_texts(spark):
    """Pairs about the border of 80 %, with fine bitmaps of one size and of two, all with passages in common."""
    rng = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    shared, texts = word(300), []
    for n in (200, 705, 715, 1735, 3500):
        base = shared + word(n)
        for changed in np.linspace(0, 0.06, 9):
            at = set(rng.choice(len(base), int(changed * len(base)), replace=False).tolist())
            texts.append([w if i not in at else "changed" for i, w in enumerate(base)] + word(int(rng.integers(0, 40))))
    texts = [" ".join(t) for t in texts]
    sets, label = [runs(t) for t in texts], list(range(len(texts)))
    alike = [[j for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    sizes = {tuple(len(near_copies.fine_bitmap(near_copies.shingle_set(texts[i].encode()))) for i in (k, j)) for k, a in enumerate(alike) for j in a}
    assert any(a != b for a, b in sizes) and 10 < sum(map(len, alike)) < 350
    for _ in texts:
        label = [min(label[j] for j in alike[i]) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = near_copies.keep_one(docs)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(label))


def test_fine_bitmaps_fold():
    for n in (0, 1, 512, 513, 1024, 1025, 5000):
        h = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
        fine = near_copies.fine_bitmap(h)
        assert len(fine) * 64 >= max(n, 512)
        while len(fine) > near_copies.BITMAP:
            fine = fine[: len(fine) // 2] ^ fine[len(fine) // 2 :]
            assert (fine == near_copies.bitmap(h, len(fine))).all()


def test_run_and_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 100
    docs = table(spark, folder, "documents").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "t-empty")
        assert docs.count() == 0
