"""The pipeline's stages keep clean documents, and what they drop is what the operators say."""

import corpus_pipeline
from graphloom.llm import common, decontaminate, langid, neardup, toxicity


def test_stages_chain(spark, tables):
    docs = common.table(spark, tables, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, docs, tables), name)
        assert out.columns == names
        if name == "language_id":
            gone = docs.count() - out.count()
            assert gone == langid.identify(docs, langid.fit(docs)).filter("lang_pred = 'und'").count()
        if name == "toxicity":
            net = toxicity.fit(docs, common.table(spark, tables, "labels"))
            assert docs.count() - out.count() == toxicity.assess(docs, net).filter("tox_score >= 0.5").count()
        if name == "near_dedup":
            assert out.count() == neardup.near_duplicates(docs).select("class_id").distinct().count()
        if name == "decontamination":
            assert docs.count() - out.count() == decontaminate.find(docs, common.table(spark, tables, "benchmark")).filter("n_items >= 2 or n_hit >= 8").count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_odd_documents(spark, tmp_path):
    """Null ids and texts, repeated rows, ids on several texts, an empty table, columns with clashing names."""
    leak = "one two three four five six seven eight nine ten eleven twelve"
    clean = " ".join(f"word{k}" for k in range(40))
    rows = [(7, leak), (None, leak), (8, clean), (None, clean), (9, clean + " more"), (9, "another text of the same number here"), (8, clean), (1, None), (2, ""), (3, "!!!"), (4, "x " * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k", 0.5, "m") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, score double, lang_pred string").repartition(3)
    spark.createDataFrame([(1, leak), (2, "unseen words of an item that no document holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, docs, str(tmp_path)), name)
        got = sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect())
        assert out.columns == docs.columns
        if name == "language_id":
            assert not {1, 2, 3} & {i for i, _ in got} and len(got) == 8
        if name == "near_dedup":  # rows without id stay; of 8 and 9 the like text goes, 9's other text stays
            assert [i for i, t in got if t.startswith("word0")] == [-1, 8] and (9, "another text of the same number here") in got
        if name == "decontamination":  # the leak goes, with and without id
            assert not [t for _, t in got if t == leak] and (-1, clean) in got and (8, clean) in got
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
