"""Every registered query on the smallest given tables, against SQL or a plain version."""

import os
import re
import zlib

import pytest

import corpus_pipeline
from rowcensus.llm.packing import Encoder
from rowcensus.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.checking import differences

from . import brute


def rows_of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def docs(given):
    return given.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, given, name):
    assert differences(QUERIES[name](spark, sf_dir), given, ORACLES[name]) is None


def test_packing(spark, sf_dir, docs):
    rows = rows_of(spark, sf_dir, "op2_best_fit_packing")
    own, pieces, bins = Encoder(tokenizer_path()), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text, _ in docs:
        ids, at = own._whole(text or "") + (2).to_bytes(4, "little"), 0
        for r in sorted(pieces[i], key=lambda r: r.piece):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[4 * at : 4 * (at + r.length)]))
            at += r.length
        assert 4 * at == len(ids)
    for places in bins.values():
        assert [sum(n for o, n in places if o < offset) for offset, _ in places] == [offset for offset, _ in places]
    total = sum(r.length for r in rows)
    assert max(sum(n for _, n in p) for p in bins.values()) <= 1024
    assert len(bins) <= 1.02 * -(-total // 1024) + 1


def test_url_filter(spark, sf_dir, given):
    rows = rows_of(spark, sf_dir, "op3_url_filter")
    assert len(rows) == given.execute("SELECT count(*) FROM pages").fetchall()[0][0]
    marks = ("casino", "bets", "pills", "spam", "adult", "ads-")
    for r in rows:
        if r.rule is None:
            assert (r.verdict == "block") == any(m in r.host for m in marks), r


def test_embeddings(spark, sf_dir, given):
    want = brute.close_vectors(given.execute("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id").fetchall(), 0.93)
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows_of(spark, sf_dir, "op4_embedding_dedup")} == want


def test_near_copies(spark, sf_dir, docs):
    want = brute.near_copies([d[:2] for d in docs], 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows_of(spark, sf_dir, "op5_minhash_dedup")} == want


def test_mix(spark, sf_dir, docs):
    source = {i: s for i, _, s in docs}
    size, taken, target = {}, {}, {}
    for r in rows_of(spark, sf_dir, "op7_mix_sources"):
        s = source[r.doc_id]
        size[s], taken[s], target[s] = size.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(size))}
    assert target == pytest.approx(brute.targets(size, weights, 3))
    assert all(abs(taken[s] - target[s]) <= 64 for s in size)


def test_repeats(spark, sf_dir, docs):
    want = brute.without_repeats([d[:2] for d in docs], 20)
    rows = rows_of(spark, sf_dir, "op8_substring_dedup")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want


@pytest.mark.parametrize("name", ["op9_toxicity", "op10_quality_classifier"])
def test_classifiers(spark, sf_dir, docs, name):
    rows = rows_of(spark, sf_dir, name)
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_pipeline(spark, sf_dir, given, docs):
    """Each stage on its own input, against plain versions of it."""
    stages = dict(corpus_pipeline.STAGES)
    texts = {i: t for i, t, _ in docs}
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = stages["quality_classifier"](spark, frame, sf_dir)
    labels = dict(given.execute("SELECT doc_id, quality FROM labels").fetchall())
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == frame.columns
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.97 * len(labels)

    exact = stages["exact_dedup"](spark, good, sf_dir)
    first = {}
    for i in sorted(kept):
        first.setdefault(texts[i], i)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(first.values())

    near = stages["minhash_dedup"](spark, exact, sf_dir)
    want = brute.near_copies([(i, texts[i]) for i in sorted(first.values())], 5, 80)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in want.items() if c == i)

    mix = stages["mix_sources"](spark, near, sf_dir)
    assert mix.columns == frame.columns
    source, size, taken = {i: s for i, _, s in docs}, {}, {}
    for r in near.collect():
        size[r.source] = size.get(r.source, 0) + len(brute.words(r.text))
    for r in mix.collect():
        assert texts[r.doc_id] == r.text and r.n_chars == len(r.text) and r.source == source[r.doc_id]
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
    target = brute.targets(size, {s: k % 3 + 1 for k, s in enumerate(sorted(size))}, 3)
    longest = {s: max(len(brute.words(t)) for i, t in texts.items() if source[i] == s) for s in size}
    # One shard a source here; its last document is whole or absent.
    assert all(abs(taken.get(s, 0) - target[s]) <= 64 + longest[s] / 2 for s in size)

    packed = stages["best_fit_packing"](spark, mix, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mix.collect()}
    assert sum(r.length for r in packed) == sum(len(Encoder(tokenizer_path())._whole(r.text)) // 4 + 1 for r in mix.collect())
    assert len(corpus_pipeline.run(spark, sf_dir).collect()) == len(packed)


def test_empty_tables_run_through_the_pipeline(spark, tmp_path, sf_dir):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, long texts and columns named like a stage's own."""
    schema = "doc_id long, text string, source string, _id string, _times int, head int, whole int, kept string, taken long, size long, label int"
    texts = [None, "", "one", "a b c d e f g", "a b c d e f g", "word " * 30_000, "x" * 100_000, " \t\n"]
    made = [(k, t, ("s", None)[k % 2], "i", 1, 2, 3, "k", 4, 5, 6) for k, t in enumerate(texts)]
    made += [(3, texts[3], "s", "j", 1, 2, 3, "k", 4, 5, 6), (None, "of no id", "s", None, None, None, None, None, None, None, None)] * 2
    docs = spark.createDataFrame(made, schema)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality_classifier", "exact_dedup", "minhash_dedup", "mix_sources"):
        found = stages[name](spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        rows = found.collect()
        assert {(r.doc_id, r.text) for r in rows} <= {(r[0], r[1]) for r in made}, name
    exact = stages["exact_dedup"](spark, docs, "").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in exact) == [-1, -1, 0, 2, 3, 3, 3, 5, 6, 7]
    near = stages["minhash_dedup"](spark, docs, "").collect()
    assert {4} == {r[0] for r in made} - {r.doc_id for r in near}
    mix = stages["mix_sources"](spark, docs, "").collect()
    assert all(r.text for r in mix)
    assert stages["best_fit_packing"](spark, docs, "").select("doc_id").distinct().count() == 9
    none = docs.limit(0)
    assert [step(spark, none, str(tmp_path)).count() for _, step in corpus_pipeline.STAGES] == [0] * 5


def test_the_pipeline_keeps_only_its_stages(spark, sf_dir, monkeypatch):
    from rowcensus.sources import staging

    made = []
    monkeypatch.setattr(staging.Stage, "__init__", lambda self, *a, _own=staging.Stage.__init__, **k: (_own(self, *a, **k), made.append(self))[0])
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    left = [s for s in made if os.path.isdir(s.folder)]
    # The run's own folder, and that of the packing, whose result is read from it.
    assert len(made) >= 6 and len(left) == 2


def test_nothing_else_imports_the_package():
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    top = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    named = re.compile(r"^\s*(?:from|import)\s+(?:rowcensus|\.+)?\.?llm\b|^\s*(?:from|import)\s+corpus_pipeline|rowcensus\.llm", re.M)
    importing = set()
    for folder, _, names in os.walk(top):
        here = os.path.relpath(folder, top)
        if (here != "." and here.startswith(".")) or here in ("rowcensus/llm", "tests/llm"):
            continue
        importing |= {os.path.join(here, n) for n in names if n.endswith(".py") and named.search(open(os.path.join(folder, n)).read())}
    assert importing == {"./__spark_entry__.py", "./corpus_pipeline.py"}
