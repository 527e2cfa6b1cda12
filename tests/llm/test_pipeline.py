import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_the_columns_and_decisions_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "mixing", "sentencepiece"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        if name != "mixing":
            assert out.count() <= before
            before = out.count()
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), sf).count()


def test_run_tokenizes_what_is_left(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)


def test_stages_take_hard_rows(spark, sf):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "a", 5), (1, words, "en", "a", 5), (2, words + " more", "en", None, 5), (3, None, None, "b", None), (4, "", "en", "b", 0), (None, "null id", "en", "b", 7), (1, "another text of one id", None, "c", 1), (5, "x " * 200_000, "en", "a", 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({x: F.lit("own") for x in ("size", "score", "copies", "shards", "__doc", "id", "predicted")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        found = out.collect()
        assert out.columns == docs.columns and all(r["size"] == r.score == r.copies == r.shards == "own" for r in found), name
        texts = [r.text for r in found]
        if name == "toxicity":
            assert len(found) == len(rows)
        if name == "line_dedup":
            assert "another text of one id" in texts and texts.count(words + " more") == 0 and texts.count(words) == 2 and None in texts
        if name == "minhash_near_dedup":
            assert "another text of one id" in texts and words + " more" not in texts and None in texts and "" in texts
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == len(rows) and all(r.round_trip for r in last)
