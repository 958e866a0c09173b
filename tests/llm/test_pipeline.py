"""The pipeline's stages, one after another, against plain versions."""

import random
from collections import Counter

import pytest

import corpus_pipeline

from . import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    top = tmp_path_factory.mktemp("sf")
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "tu", "sa") for b in ("n", "ra", "so", "vi", "zel")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(line(rng.randrange(8, 25)) for _ in range(4))
        if i % 6 == 0:
            text = text.replace(" ", "### ")
        elif i % 7 == 0:
            text += "\nAll rights reserved by the owner"
        rows.append((i, text, "en", ("a", "b", "c", None)[i % 4], len(text)))
        labels.append((i, int(i % 6 != 0), 0))
    rows += [(1000 + i, rows[5][1], "en", "a", 1) for i in range(4)] + [(2000, None, None, None, None), (2001, "", "de", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, found = docs.columns, {}
    for label, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{label}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{label}")
        found[label] = (before.collect(), docs.collect())
        if label != "byte_bpe":
            assert docs.columns == columns

    before, after = found["quality_classifier"]
    kept = {r.doc_id for r in after}
    junk = {r.doc_id for r in before if r.doc_id < 240 and r.doc_id % 6 == 0}
    clean = {r.doc_id for r in before if r.doc_id < 240} - junk
    assert len(kept & junk) <= 0.05 * len(junk) and len(kept & clean) >= 0.95 * len(clean)

    before, after = found["line_dedup"]
    want = {i: t for i, _, _, t in brute.line_dedup([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = found["simhash_near_dedup"]
    want = sorted(i for i, _, c in brute.near_duplicates([(r.doc_id, r.text) for r in before]) if i == c)
    assert sorted(r.doc_id for r in after) == want

    before, after = found["source_mix"]
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(brute.words(r.text))
    copies = Counter(r.doc_id for r in after)
    assert max(copies.values()) <= 3
    by_source = Counter()
    for r in after:
        by_source[r.source] += len(brute.words(r.text))
    from gridloom.llm.source_mix import shares

    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = shares([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    longest = max(len(brute.words(r.text)) for r in before)
    assert all(abs(by_source[s] - t) <= longest for s, t in zip(names, targets, strict=True))

    before, after = found["byte_bpe"]
    assert sorted((r.doc_id, brute.sha(r.text)) for r in before) == sorted((r.doc_id, r.decoded_sha256) for r in after)


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.collect() == []


def test_null_and_repeated_ids_keep_a_row_of_each_group(spark, tmp_path):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "tu") for b in ("n", "ra", "so", "vi", "zel")]
    a, b, c, d, e, f, g, h = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(8))
    given = [(None, a), (None, b), (None, b), (None, b.upper()), (7, c), (7, d), (8, c), (None, e), (9, e), (10, f), (10, f)]
    given += [(3, g), (11, g), (11, h), (None, None), (None, "")]
    rows = [(i, t, "en", "a", 0) for i, t in given]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = Counter((r.doc_id, (r.text or "").lower()) for r in out.collect())
    assert got == Counter([(None, a), (None, b), (7, c), (7, d), (9, e), (10, f), (3, g), (11, h), (None, "")])


def test_awkward_rows_in_every_stage(spark, tmp_path):
    """Null and repeated ids, null texts, copies, and extra columns with names used inside."""
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "tu") for b in ("n", "ra", "so", "vi", "zel")]
    text = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(4))
    given = [(i, text()) for i in range(60)] + [(None, text()), (None, text()), (7, text()), (3, None), (None, ""), (61, "short")]
    given += [given[5], given[5], (None, given[9][1])]
    rows = [(i, t, "en", ("a", None)[k % 2], 0, k, "x", "y", 1.5, "z") for k, (i, t) in enumerate(given)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, id string, fp string, score double, size string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    others = lambda r: (r.doc_id, r.lang, r.source, r.row, r.id, r.fp, r.score, r.size)
    for name in ("quality_classifier", "line_dedup"):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert Counter(map(others, out.collect())) == Counter(map(others, docs.collect())), name  # all labels are 1
    kept = stages["simhash_near_dedup"](spark, docs, str(tmp_path)).collect()
    groups = {brute.fingerprint(t) for _, t in given}
    assert len(kept) == len(groups) and len({r.row for r in kept}) == len(kept)
    assert all(rows[r.row][0] == r.doc_id and rows[r.row][1] == r.text for r in kept)
    mixed = [stages["source_mix"](spark, docs.repartition(n), str(tmp_path)).collect() for n in (1, 4)]
    assert Counter(mixed[0]) == Counter(mixed[1])
    assert {r.row for r in mixed[0]} <= {k for k, (_, t) in enumerate(given) if t} and all(rows[r.row][1] == r.text for r in mixed[0])
    coded = stages["byte_bpe"](spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in coded) == Counter((i, brute.sha(t or "")) for i, t in given)
