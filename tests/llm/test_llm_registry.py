"""The registered queries on whole tables, and the pipeline against its stages' plain versions."""

import brute
import pytest
from cases import SF
from oracle import compare

import corpus_pipeline
from shoebox.llm import byte_bpe, quality, registry


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert compare(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys() - {"pipeline", "op7_decontaminate"}))
def test_one_row_per_document(spark, name):
    got = [r.doc_id for r in registry.queries()[name](spark, SF).collect()]
    assert sorted(got) == sorted(r.doc_id for r in rows(spark, "documents").select("doc_id").collect())


def test_decontamination_query(spark):
    docs = [(r.doc_id, r.text) for r in rows(spark, "documents").collect()]
    items = [(r.item_id, r.text) for r in rows(spark, "benchmark").collect()]
    assert {(r.doc_id, r.item_id) for r in registry.queries()["op7_decontaminate"](spark, SF).collect()} == brute.leaks(docs, items)


def test_pipeline(spark, tmp_path):
    docs = rows(spark, "documents")
    model = quality.train(docs, rows(spark, "labels"))
    good = {r.doc_id for r in quality.score_documents(docs, model).where("score >= 0.5").collect()}
    state = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    df = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        if name == "line_dedup":
            want = {i: d for i, *_, d in brute.line_dedup(state)}
            state = [(r.doc_id, r.text) for r in df.collect()]
            assert {i: brute.sha(t) for i, t in state} == want
        elif name == "simhash":
            state = [(i, t) for (i, t), (_, _, c) in zip(state, brute.near_components(state)) if i == c]
        elif name == "decontaminate":
            bad = {i for i, _ in brute.leaks(state, [(r.item_id, r.text) for r in rows(spark, "benchmark").collect()])}
            state = [(i, t) for i, t in state if i not in bad]
        assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(i for i, _ in state)
    text = dict(state)
    path, pattern = byte_bpe.default_vocabulary()
    codec = byte_bpe.codec(byte_bpe.read_file(path), pattern)
    assert all(codec.decode(r.ids).decode() == text[r.doc_id] for r in df.collect())
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()} == {tuple(r) for r in df.select("doc_id", "ids_sha256").collect()}


def test_run_computes_each_stage_once(spark, monkeypatch):
    docs = rows(spark, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    seen = spark.sparkContext.accumulator(0)

    def first(spark, found, sf_dir):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return docs.mapInArrow(count, docs.schema)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", first), *corpus_pipeline.STAGES[1:]])
    corpus_pipeline.run(spark, SF).collect()
    assert seen.value == docs.count()
