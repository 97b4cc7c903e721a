"""The corpus pipeline against brute force on a small table."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_documents import SCHEMA, brute_components, lowered, rows_of


def test_stages_on_hard_rows(spark, tmp_path):
    docs = spark.createDataFrame(rows_of(), SCHEMA).selectExpr("doc_id", "text", "lang", "source", "n_chars", "7 as copy", "'r' as rate", "1 as text_sha256", "2 as _source", "3 as _n", "4 as _key", "5 as sig", "keep_id", "block")
    assert [name for name, _ in corpus_pipeline.STAGES][:2] == ["language ID", "exact dedup"]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs.collect()
        if k < 4:
            assert {tuple(r)[5:12] for r in seen[name]} == {(7, "r", 1, 2, 3, 4, 5)}
    texts = {lowered(t) for _, t, *_ in rows_of() if any(c.isalpha() for c in t or "")}
    assert Counter(lowered(r.text) for r in seen["exact dedup"]) == Counter(texts)
    pairs = [(r.doc_id, r.text) for r in seen["exact dedup"] if r.doc_id is not None]
    assert sorted(r.doc_id for r in seen["n-gram Jaccard join"] if r.doc_id is not None) == sorted(set(brute_components(pairs).values()))
    sources = {r.doc_id for r in seen["mixing sources to target weights"]}
    assert sources <= {r.doc_id for r in seen["n-gram Jaccard join"]}
    assert len(seen["BPE encoding and decoding"]) == len(seen["mixing sources to target weights"])
    assert all(len(r.ids) == r.n_tokens for r in seen["BPE encoding and decoding"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_run_computes_each_stage_once(spark, tmp_path, monkeypatch):
    """Rows read from the input by all steps of all stages, against those of the stages alone."""
    rows_of_text = [r for r in rows_of() if r[0] is not None]
    spark.createDataFrame(rows_of_text, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    calls = spark.sparkContext.accumulator(0)

    def counted(stage):
        def run(spark, docs, sf_dir):
            def mark(batches):
                for b in batches:
                    calls.add(b.num_rows)
                    yield b

            return stage(spark, docs, sf_dir).mapInArrow(mark, docs.schema)

        return run

    stages = [(n, counted(f) if i < 4 else f) for i, (n, f) in enumerate(corpus_pipeline.STAGES)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    out = corpus_pipeline.run(spark, str(tmp_path)).count()
    docs, total = spark.read.parquet(str(tmp_path / "documents.parquet")), 0
    monkeypatch.undo()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, "").write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        total += docs.count()
    assert calls.value == total and out == docs.count()
