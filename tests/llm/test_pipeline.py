"""The pipeline's stages, each against its own input."""

from __future__ import annotations

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(base / str(i)))
        docs = spark.read.parquet(str(base / str(i)))
        out.append(docs)
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for df in stages[1:5]:
        assert df.columns == stages[0].columns
        known = {r.doc_id: r for r in stages[0].collect()}
        assert all(known[r.doc_id] == r for r in df.collect())


def test_quality_rejects_labelled_rows(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in stages[1].collect()}
    rows = {r.doc_id: r.text for r in stages[0].collect()}
    for r in labels.collect():
        if len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id])) < 50:
            assert r.doc_id not in kept
        elif r.quality == 0:
            assert r.doc_id not in kept


def test_dedup_leaves_one_of_each_group(stages):
    from tests.llm.test_pair_ops import _classes, _print
    rows = sorted((r.doc_id, _print(r.text)) for r in stages[1].collect())
    cls = _classes([p for _, p in rows], 4)
    want = {rows[c][0] for c in cls}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(want)


def test_no_benchmark_item_is_left(spark, sf_dir, stages):
    def plain(t):
        return " ".join(re.findall(r"\w+", t.lower()))
    items = [plain(r.text) for r in spark.read.parquet(
        f"{sf_dir}/benchmark.parquet").collect()]
    before = {r.doc_id: plain(r.text) for r in stages[2].collect()}
    after = {r.doc_id for r in stages[3].collect()}
    dirty = {i for i, t in before.items() if any(x in t for x in items)}
    assert dirty and not dirty & after
    assert len(before) - len(after) <= 1.2 * len(dirty)


def test_mix_follows_the_plan_and_tokens_its_order(stages):
    from tasklane.llm.mixing import plan
    want = sorted((p, r.doc_id) for r in plan(stages[3]).collect()
                  for p in r.positions)
    got = [r.doc_id for r in stages[5].orderBy("start").collect()]
    assert got == [i for _, i in want]


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = pipeline.run(spark, sf_dir)
    assert sorted(map(str, got.collect())) == sorted(
        map(str, stages[5].collect()))
    assert pipeline.ORACLE_SQL is None
